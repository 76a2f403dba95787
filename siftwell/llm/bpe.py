"""Operator 10: byte-level BPE of long texts in overlapping chunks, and decoding.

A text longer than a chunk is cut into windows that overlap. Each window is pre-tokenised and encoded on its own, in
parallel; its first boundaries may be wrong, as it starts inside a token. Two neighbours are stitched at the first
boundary that both have: since a pre-token depends on nothing before it, they agree from there on. Where the overlap has
no such boundary (one token longer than the overlap), the text from the last sure boundary to the end of the next window
is pre-tokenised again. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, buffers, forget, lean, ragged, read, slices, with_key, worker_cache
from .pretokens import PieceIds, boundaries

CHUNK, OVERLAP = 32_768, 1_024
#: Boundaries so near to a window's end aren't sure: what follows could still change them.
GUARD = 16

_coders: dict[str, PieceIds] = worker_cache("bpe coders")
_tables: dict[str, tuple[list[bytes], np.ndarray]] = worker_cache("bpe tables")


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_coder(path: str) -> PieceIds:
    """Encoder of pre-tokens by a rank file."""
    if path not in _coders:
        import public_tokenizers
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        one = enc._core_bpe.encode_single_piece
        _coders[path] = PieceIds(lambda pieces: [array("I", one(p)).tobytes() for p in pieces])
    return _coders[path]


def id_tables(path: str) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each id, and its decimal name. Decoding needs no encoder, which would hold memory."""
    if path not in _tables:
        ranks = read_ranks(path)
        raw = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            raw[v] = k
        _tables[path] = raw, np.array([str(i) for i in range(len(raw))], object)
    return _tables[path]


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def windows(size: int, starts_char, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Windows (begin, end) over a text of so many bytes; starts_char moves an offset back to a character's start."""
    out, at = [], 0
    while True:
        end = min(at + chunk + overlap, size)
        out.append((at, starts_char(end) if end < size else size))
        if end == size:
            return out
        at = starts_char(at + chunk)


class Window:
    """A window's boundaries (absolute offsets), the ids of its pre-tokens, and how far the boundaries are sure."""

    def __init__(self, begin: int, data: np.ndarray, final: bool, begins: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.begin, self.data, self.final = begin, data, final
        self.at, self.ids, self.before = begins + begin, ids, np.concatenate([[0], np.cumsum(counts)])
        self.end = begin + len(data)
        self.sure = self.end if final else self.end - GUARD


def encode_window(coder: PieceIds, begin: int, data: np.ndarray, final: bool) -> Window:
    begins, _ = boundaries(data, np.array([0, len(data)]))
    ids, counts = coder(data, begins)
    return Window(begin, data, final, begins, ids, counts)


def stitch(parts: list[Window], coder: PieceIds) -> np.ndarray:
    """The ids of the whole text from the windows in order."""
    out, sure, now = [], 0, parts[0]
    for nxt in parts[1:]:
        a = now.at[(now.at >= max(sure, nxt.begin)) & (now.at <= now.sure)]
        both = a[np.isin(a, nxt.at[nxt.at <= nxt.sure])]
        if len(both):
            x = both[0]
            i, k = np.searchsorted(now.at, [sure, x])
            out.append(now.ids[now.before[i] : now.before[k]])
            sure, now = int(x), nxt
        else:  # again, from the last sure boundary over the next window
            data = np.concatenate([now.data[sure - now.begin :], nxt.data[now.end - nxt.begin :]])
            now = encode_window(coder, sure, data, nxt.final)
    i = int(np.searchsorted(now.at, sure))
    out.append(now.ids[now.before[i] :])
    return np.concatenate(out)


def digests(ids: np.ndarray, counts: np.ndarray, table: list[bytes], decimal: np.ndarray) -> tuple[list[str], list[str]]:
    """Per text: sha256 of the decimal ids joined by a space, and of the decoded bytes."""
    names, ends, coded, raw = decimal[ids].tolist(), np.cumsum(counts).tolist(), [], []
    lo = 0
    for hi in ends:
        coded.append(hashlib.sha256(" ".join(names[lo:hi]).encode()).hexdigest())
        raw.append(hashlib.sha256(decode(ids[lo:hi], table)).hexdigest())
        lo = hi
    return coded, raw


def id_rows(keys: pa.Array, docs: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of RESULT from the ids of some texts, one after another, and their numbers."""
    where = np.concatenate([[0], np.cumsum(counts)]) * 4
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
    return pa.RecordBatch.from_arrays([keys, docs, pa.array(counts), coded], ["row_key", "doc_id", "n_tokens", "ids"])


def digest_rows(ranks: str):
    """As id_rows(), with the digests of DIGESTS in place of the ids."""

    def rows(keys: pa.Array, docs: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        coded, raw = digests(ids, counts, *id_tables(ranks))
        return pa.RecordBatch.from_arrays([docs, pa.array(counts), pa.array(coded), pa.array(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows


RESULT = "row_key long, doc_id long, n_tokens long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
PARTS = "row_key long, doc_id long, chunk int, begin long, final boolean, data binary"
CODED = PARTS + ", begins binary, ids binary, counts binary"


def bpe_encode(docs: DataFrame, ranks: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row_key, doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text; null is empty.

    Rows that repeat a doc_id, or have none, each get a row. A text of one chunk at most is encoded where it is read;
    the windows of longer ones are dealt out over the cluster, then gathered per text for stitching.
    """
    return _encoded(docs, ranks, chunk, overlap, id_rows, RESULT)


def bpe_digests(docs: DataFrame, ranks: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of bpe_encode(), whose ids are decoded again, without keeping ids.

    Null texts are empty and have no ids; rows that repeat an id or a whole row have a row each; an empty table gives no
    row; other columns play no part.
    """
    return _encoded(docs, ranks, chunk, overlap, digest_rows(ranks), DIGESTS)


def _encoded(docs: DataFrame, ranks: str, chunk: int, overlap: int, rows_of, kind: str) -> DataFrame:
    arrow_limits(docs.sparkSession)
    keyed = with_key(docs)
    long = F.octet_length("text") > chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(ranks)
        for batch in batches:
            for lo, hi, off, data in slices(batch.column("text")):
                begins, first = boundaries(data, off)
                ids, lengths = coder(data, begins)
                counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[first])
                yield rows_of(batch.column("row_key").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), ids, counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = buffers(batch.column("text"))
            for r, (key, doc) in enumerate(zip(batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                text = data[off[r] : off[r + 1]]

                def char(i: int, text=text) -> int:
                    while i and text[i] & 0xC0 == 0x80:
                        i -= 1
                    return i

                cuts = windows(len(text), char, chunk, overlap)
                k = len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array([key] * k), pa.array([doc] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([a for a, _ in cuts]), pa.array([b == len(text) for _, b in cuts]), pa.array([text[a:b].tobytes() for a, b in cuts], pa.binary())], ["row_key", "doc_id", "chunk", "begin", "final", "data"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(ranks)
        for batch in batches:
            begins, ids, counts = [], [], []
            for data in batch.column("data"):
                w = encode_window(coder, 0, np.frombuffer(data.as_py(), np.uint8), False)
                begins.append(w.at.astype("<i8").tobytes())
                ids.append(w.ids.astype("<u4").tobytes())
                counts.append(np.diff(w.before).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.binary()) for x in (begins, ids, counts))], [*batch.schema.names, "begins", "ids", "counts"])

    def join(rows: pa.Table) -> pa.Table:
        forget(("bpe coders", "bpe tables"))
        rows = rows.sort_by("chunk")
        begin, final = rows.column("begin").to_pylist(), rows.column("final").to_pylist()
        raw = [[np.frombuffer(x.as_buffer(), t) for x in rows.column(c)] for c, t in (("data", np.uint8), ("begins", "<i8"), ("ids", "<u4"), ("counts", "<i8"))]
        ids = stitch([Window(*x) for x in zip(begin, raw[0], final, *raw[1:], strict=True)], rank_coder(ranks))
        one = [rows.column(c).slice(0, 1).combine_chunks() for c in ("row_key", "doc_id")]
        return pa.Table.from_batches([rows_of(*one, ids, np.array([len(ids)]))])

    one = keyed.where(~long).mapInArrow(lean(short, "bpe coders", "bpe tables"), kind)
    parts = keyed.where(long).mapInArrow(lean(cut), PARTS).repartition("row_key", "chunk").mapInArrow(lean(encode, "bpe coders"), CODED)
    return one.unionByName(parts.groupBy("row_key").applyInArrow(join, kind))


def bpe_decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """row_key, doc_id and the decoded bytes."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = id_tables(ranks)
        for batch in batches:
            raw = [decode(np.frombuffer(x.as_py() or b"", "<u4"), table) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(raw, pa.binary())], ["row_key", "doc_id", "data"])

    return encoded.select("row_key", "doc_id", "ids").mapInArrow(lean(back, "bpe tables"), "row_key long, doc_id long, data binary")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_digests(read(spark, sf_dir, "documents"), ranks)
