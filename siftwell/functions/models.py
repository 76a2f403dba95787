"""Which kind of model a name stands for."""

from __future__ import annotations

AUTO = "auto"


def dense_backend(model: str, backend: str = AUTO) -> str:
    """bge or qwen by the name, unless one is given; other names are an error."""
    return _backend(model, backend, bge=lambda name: "bge" in name, flag="--dense_backend")


def reranker_backend(model: str, backend: str = AUTO) -> str:
    """As dense_backend, but a bge model must be named a reranker."""
    return _backend(model, backend, bge=lambda name: "bge" in name and "reranker" in name, flag="--reranker_backend")


def _backend(model: str, backend: str, bge, flag: str) -> str:
    if backend != AUTO:
        return backend
    name = model.lower()
    if bge(name):
        return "bge"
    if "qwen" in name:
        return "qwen"
    raise ValueError(f"can't tell the backend of {model}; give {flag} bge or {flag} qwen")
