"""What the tokenizers' steps hold beside their results is bounded, and what recurs is encoded once."""

import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from siftwell.llm import common, token_output
from siftwell.llm.pretokens import PieceIds


@pytest.mark.parametrize("gathered", [1, 7, 1000])
def test_ragged_by_brute_force(monkeypatch, gathered):
    monkeypatch.setattr(common, "GATHERED", gathered, raising=False)
    rng = np.random.default_rng(3)
    flat = rng.integers(0, 99, 200).astype(np.int32)
    starts, lengths = rng.integers(0, 150, 90), rng.integers(0, 20, 90)
    lengths[[0, 40, 41, 89]] = 0
    want = np.concatenate([flat[s : s + n] for s, n in zip(starts, lengths)])
    assert np.array_equal(common.ragged(flat, starts, lengths), want)
    assert len(common.ragged(flat, starts[:0], lengths[:0])) == 0 and len(common.ragged(flat, starts, lengths * 0)) == 0


def test_ragged_holds_little_beside_its_result():
    flat, starts, lengths = np.zeros(100, np.uint8), np.zeros(40_000, np.int64), np.full(40_000, 100)
    tracemalloc.start()
    out = common.ragged(flat, starts, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 4_000_000 and peak < 3 * out.nbytes


def test_what_recurs_is_encoded_once():
    asked = []
    coder = PieceIds(lambda pieces: asked.extend(pieces) or [np.array([len(p)], "<u4").tobytes() for p in pieces], most=20)
    for k in range(30):
        words = [b"often", *(b"w%03d" % (5 * k + j) for j in range(5))]
        ids, lengths = coder(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
        assert ids.tolist() == [len(w) for w in words] and lengths.tolist() == [1] * 6
        assert len(coder.known) + len(coder.before) <= 20 + 2 * 6
    assert asked.count(b"often") == 1 and len(asked) == 151


JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_what_recurs_after_400_000_others_is_encoded_once_by_token_output(monkeypatch):
    monkeypatch.setattr(token_output, "_coders", {})
    coder = token_output.library_coder(JSON, token_output.KEPT)
    asked = []
    coder.encode = lambda pieces: asked.append(len(pieces)) or [b"\0\0\0\0"] * len(pieces)
    for first in (0, 200_000, 400_000, 0):
        data = np.frombuffer(b"".join(b"%06d" % k for k in range(first, first + 200_000)), np.uint8)
        coder(data, np.arange(0, len(data) + 1, 6))
    assert asked == [200_000] * 3


def test_pretokens_of_all_kinds_are_encoded_as_by_the_library_alone(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "_coders", {})
    monkeypatch.setattr(token_output, "JOINED", 3)
    alone = Tokenizer.from_file(JSON)
    pieces = [" word", "word", "'s", "   ", "\n\n", " ", " 1234567", "99", " ß日本語", "日本", " \U0001f600!?", "<|", "endoftext", "|>", "\u00a0", " unbelievablyantidisestablishment", "\u0000"]
    coder = token_output.library_coder(JSON)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode([p.encode() for p in pieces])]
    assert got == [alone.encode(p, add_special_tokens=False).ids for p in pieces]
