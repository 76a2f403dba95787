"""Operator 13: alignment of two tokenizers' tokens over the same bytes, by interval joins in DuckDB within each task.

Both tokenizers encode a space and the text. A task works on slices of some MB of text (one text at least); a slice's
tokens are two interval tables over the bytes of its texts put one after another. In DuckDB
- ASOF joins find, for each token, the other tokenizer's token that its first byte lies in; a token overlaps those that
  its start lies in and those that start in it, so two such joins, the second one cut to the token's range, give every
  overlapping pair once (a link);
- byte offsets where both have an end cut the tokens into groups, numbered by window sums over them;
- links are summed up by document and pair of ids, then documents by pair (partial counts).
The partial counts of all slices are merged in Spark, and each slice gets the counts of its own pairs back.
Texts longer than CHUNK_BYTES are joined in pieces, cut where both tokenizers have an end, so no link crosses a cut.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, lean, ragged, read, scratch, settled, slices, with_key, worker_cache
from .pretokens import PieceIds, boundaries
from .token_output import library_coder

#: Bytes of text in a slice; a slice's different pairs are counted together.
SLICE_TEXT = 2 << 20
#: Bytes that one round of joins covers, where the tokens' ends allow a cut.
CHUNK_BYTES = 1 << 19

SLICED = (
    "slice long, row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary, pair_a binary, pair_b binary, pair_docs binary"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

_coders: dict[str, PieceIds] = worker_cache("piece coders")
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = worker_cache("token bytes")

LINKS = """
WITH linked AS (
  SELECT a.doc AS doc, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.lo >= b.lo
  UNION ALL
  SELECT a.doc, a.id, b.id FROM b ASOF JOIN a ON b.lo > a.lo WHERE b.lo < a.hi)
SELECT doc, a, b, count(*) AS times FROM linked GROUP BY doc, a, b
"""

# a group's number: the common ends before it, summed up over the tokens in order
GROUPS = """
SELECT id, lo, (count(CASE WHEN common THEN 1 END) OVER ({order} ROWS UNBOUNDED PRECEDING) - common::INT)::INT AS part FROM {side}
"""

PARTIAL = "SELECT a, b, count(*) AS docs FROM links GROUP BY a, b ORDER BY a, b"
WHOLE = "SELECT doc, a, b, sum(times)::BIGINT AS times FROM links GROUP BY doc, a, b"


def table_of(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after another, and each one's length."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level_tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """table_of() a byte-level vocabulary. What isn't written in its signs (special tokens) has no bytes."""
    if path not in _tables:
        from tokenizers import Tokenizer

        t, signs = Tokenizer.from_file(path), byte_signs()
        tokens = [b""] * t.get_vocab_size()
        for token, k in t.get_vocab().items():
            if all(c in signs for c in token):
                tokens[k] = bytes(signs[c] for c in token)
        _tables[path] = table_of(tokens)
    return _tables[path]


def pieces_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """table_of() a piece vocabulary: U+2581 is a space, <0xHH> the byte HH."""
    if path not in _tables:
        sp = pieces_of(path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        _tables[path] = table_of([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
    return _tables[path]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As boundaries(), for the piece model: each run of spaces begins a part, with the word after it."""
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    start[begin] = True
    begins = np.append(np.flatnonzero(start), len(data)).astype(np.int64)
    return begins, np.searchsorted(begins, offsets).astype(np.int64)


def piece_coder(path: str) -> PieceIds:
    """The sentencepiece library's encoder for parts that begin with a space, which the library itself puts in front.

    No piece of the model has a space after another sign, which is checked, so that parts are encoded as in the text.
    """
    if path not in _coders:
        sp = pieces_of(path)
        if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())):
            raise ValueError("the model has pieces of more than one word")
        lone = np.array([sp.piece_to_id("▁")], "<u4").tobytes()  # the library gives no ids for an empty text

        def encode(parts: list[bytes]) -> list[bytes]:
            found = sp.encode([p[1:].decode() for p in parts], num_threads=1)
            return [lone if len(p) == 1 else array("I", ids).tobytes() for p, ids in zip(parts, found, strict=True)]

        _coders[path] = PieceIds(encode)
    return _coders[path]


def led_by_space(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that aren't empty, each with a space in front; offsets for all texts."""
    sizes = np.diff(off)
    sizes = np.where(sizes > 0, sizes + 1, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    led = np.ones(len(out), bool)
    led[ends[:-1][sizes > 0]] = False
    out[led] = data
    return ends, out


class Tokens:
    """One tokenizer's tokens of some texts: ids, byte lengths, and the number of tokens of each text."""

    def __init__(self, coder: PieceIds, parts: tuple[np.ndarray, np.ndarray], data: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        begins, first = parts
        ids, lengths = coder(data, begins)
        total = np.concatenate([[0], np.cumsum(lengths)])
        self.ids, self.counts = ids.astype(np.int32), np.diff(total[first])
        self.flat, self.all_sizes = table
        self.sizes = self.all_sizes[self.ids]

    def same(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which texts the tokens' bytes give again."""
        joined = ragged(self.flat, (np.cumsum(self.all_sizes) - self.all_sizes)[self.ids], self.sizes)
        ends = np.concatenate([[0], np.cumsum(self.sizes)])[np.concatenate([[0], np.cumsum(self.counts)])]
        return np.array([np.array_equal(joined[a:b], data[c:d]) for a, b, c, d in zip(ends, ends[1:], off, off[1:], strict=False)], bool)

    def intervals(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id, lo and hi of the tokens of kept texts, put one after another."""
        held = np.repeat(kept, self.counts)
        hi = np.cumsum(self.sizes[held])
        return self.ids[held], (hi - self.sizes[held]).astype(np.int32), hi.astype(np.int32)


@cache
def names(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of each number below size in decimal, with nothing, a comma, a bar, a semicolon after it."""
    flat, lengths = table_of([f"{i}{sep}".encode() for sep in ("", ",", "|", ";") for i in range(size)])
    return flat, np.cumsum(lengths) - lengths, lengths


def spelt(part: np.ndarray, side: np.ndarray, ids: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups' text, and where each token's share of it ends; last: a document's last tokens."""
    after = np.full(len(ids), 3)
    after[:-1][part[1:] == part[:-1]] = 2
    after[:-1][(part[1:] == part[:-1]) & (side[1:] == side[:-1])] = 1
    after[last] = 0
    flat, starts, lengths = names(size)
    which = after * size + ids
    return ragged(flat, starts[which], lengths[which]), np.cumsum(lengths[which])


def numbered_groups(con, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and place of a side's tokens in order: a group's number is the common ends before its tokens."""
    for order in ("", "ORDER BY lo"):  # the table is in order, and windows without one keep it; if not, it is sorted
        found = con.execute(GROUPS.format(side=side, order=order)).fetchnumpy()
        part, ids, place = (np.asarray(found[c]) for c in ("part", "id", "lo"))
        if (place[1:] > place[:-1]).all():
            return part, ids, place
    order = np.argsort(place)
    return part[order], ids[order], place[order]


def merged(a: tuple, b: tuple) -> list[np.ndarray]:
    """part, id, place and side of both sides' tokens, by group, first a's."""
    at_a = np.arange(len(a[0])) + np.searchsorted(b[0], a[0], "left")
    at_b = np.arange(len(b[0])) + np.searchsorted(a[0], b[0], "right")
    out = []
    for x, y in [*zip(a, b, strict=True), (np.int8(0), np.int8(1))]:
        column = np.empty(len(at_a) + len(at_b), x.dtype)
        column[at_a], column[at_b] = x, y
        out.append(column)
    return out


def common_ends(a_hi: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side end where one of the other side does."""
    out = []
    for mine, others in ((a_hi, b_hi), (b_hi, a_hi)):
        ends = np.zeros(int(max(mine[-1], others[-1])) + 1 if len(mine) and len(others) else 1, bool)
        ends[others] = True
        out.append(ends[mine])
    return out[0], out[1]


def cuts(common: np.ndarray, doc_ends: np.ndarray, chunk: int) -> list[int]:
    """Places to cut at, chunk bytes apart or more: ends of documents, or in long ones ends that both have; the last end
    among them."""
    if not len(doc_ends):
        return []
    out = [0]
    while out[-1] < doc_ends[-1]:
        least = min(out[-1] + chunk, int(doc_ends[-1]))
        doc, any_ = int(doc_ends[np.searchsorted(doc_ends, least)]), int(common[np.searchsorted(common, least)])
        out.append(doc if doc < least + chunk else any_)
    return out[1:]


def aligned(con, a: tuple, b: tuple, doc_ends: np.ndarray, size: int, chunk: int = CHUNK_BYTES) -> tuple[dict, np.ndarray, list[str]]:
    """Links (doc, a, b, times) of documents that lie one after another, their numbers of groups and their digests."""
    n = len(doc_ends)
    groups, hashes = np.zeros(n, np.int64), [hashlib.sha256() for _ in range(n)]
    links, lo, split = [], 0, False
    both = common_ends(a[2], b[2])
    for hi in cuts(b[2][both[1]], doc_ends, chunk):
        sides = []
        for (ids, los, his), common in zip((a, b), both, strict=True):
            k, m = np.searchsorted(los, [lo, hi])
            sides.append({"id": ids[k:m], "lo": los[k:m], "hi": his[k:m], "common": common[k:m]})
        con.register("a", pa.table(sides[0] | {"doc": np.searchsorted(doc_ends, sides[0]["lo"], "right").astype(np.int32)}))
        con.register("b", pa.table(sides[1]))
        links.append(con.sql(LINKS).to_arrow_table())
        part, ids, place, side = merged(numbered_groups(con, "a"), numbered_groups(con, "b"))
        doc = np.searchsorted(doc_ends, place, "right")
        new = np.concatenate([[True], part[1:] != part[:-1]])
        groups += np.bincount(doc[new], minlength=n)
        whole = hi == doc_ends[doc[-1]]
        split |= not whole
        text, ends = spelt(part, side, ids, np.concatenate([doc[1:] != doc[:-1], [whole]]), size)
        raw, at = memoryview(text), 0
        for k in np.flatnonzero(np.concatenate([doc[1:] != doc[:-1], [True]])).tolist():
            hashes[doc[k]].update(raw[at : ends[k]])
            at = int(ends[k])
        lo = hi
    con.register("links", pa.concat_tables(links) if links else pa.table({c: np.zeros(0, np.int64) for c in ("doc", "a", "b", "times")}))
    if split:  # a document's pairs of two chunks are one
        con.register("links", con.sql(WHOLE).to_arrow_table())
    found = con.execute("FROM links").fetchnumpy()
    order = np.argsort(found["doc"], kind="stable")
    return {"whole": {c: np.asarray(v)[order] for c, v in found.items()}, "partial": con.execute(PARTIAL).fetchnumpy()}, groups, [h.hexdigest() for h in hashes]


def sliced(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """A row (SLICED) per document, and one per slice with its pairs of ids and in how many documents each is linked.

    docs has row_key, doc_id and text. A slice is named by its first row_key; a document's pairs are places among its
    slice's.
    """
    schema = pa.schema([(n, KINDS[t]) for n, t in (f.split() for f in SLICED.split(", "))])

    def rows(con, keys: list, ids: list, off: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        off, data = led_by_space(off, data)
        a = Tokens(library_coder(tokenizer), boundaries(data, off), data, byte_level_tokens(tokenizer))
        b = Tokens(piece_coder(pieces), word_starts(data, off), data, piece_tokens(pieces))
        kept = (np.diff(off) > 0) & a.same(off, data) & b.same(off, data)
        where = np.flatnonzero(kept)
        tables, groups, digests = aligned(con, a.intervals(kept), b.intervals(kept), np.cumsum(np.diff(off)[kept]), max(len(a.all_sizes), len(b.all_sizes)))
        whole, partial = tables["whole"], tables["partial"]
        pair = np.asarray(whole["a"], np.int64) << 32 | np.asarray(whole["b"], np.int64)
        every = np.asarray(partial["a"], np.int64) << 32 | np.asarray(partial["b"], np.int64)
        place, times = np.searchsorted(every, pair).astype("<u4"), np.asarray(whole["times"]).astype("<u4")
        limits = np.searchsorted(np.asarray(whole["doc"]), np.arange(len(where) + 1))
        n = len(ids)
        out = {f.name: [None] * (n + 1) for f in schema} | {"slice": [keys[0]] * (n + 1), "row_key": [*keys, None], "doc_id": [*ids, None]}
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            out[name] = [0] * n + [None]
        out["groups_sha256"], out["pairs"], out["times"] = [""] * n + [None], [b""] * n + [None], [b""] * n + [None]
        for k, d in enumerate(where.tolist()):
            x, y = limits[k], limits[k + 1]
            out["n_a"][d], out["n_b"][d], out["n_groups"][d], out["groups_sha256"][d] = int(a.counts[d]), int(b.counts[d]), int(groups[k]), digests[k]
            out["n_links"][d], out["pairs"][d], out["times"][d] = int(times[x:y].sum(dtype=np.int64)), place[x:y].tobytes(), times[x:y].tobytes()
        for name, column in (("pair_a", "a"), ("pair_b", "b"), ("pair_docs", "docs")):
            out[name][n] = np.asarray(partial[column]).astype("<u4").tobytes()
        return pa.RecordBatch.from_pydict(out, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # no folder to spill to: a round of joins covers CHUNK_BYTES of text
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys, ids = table["row_key"].to_pylist(), table["doc_id"].to_pylist()
            for chunk in table["text"].chunks:
                for lo, hi, off, data in slices(chunk, SLICE_TEXT):
                    yield rows(con, keys[lo:hi], ids[lo:hi], off, data)

        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= SLICE_TEXT:
                yield from flush()
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield from flush()
        con.close()

    return docs.select("row_key", "doc_id", "text").mapInArrow(lean(work, "token coders", "piece coders", "token bytes"), SLICED)


def slice_pairs(cut: DataFrame) -> DataFrame:
    """slice, place, a, b and n (documents of the slice) of each slice's pairs."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b, n = (np.frombuffer(row[c], "<u4").astype(np.int32) for c in ("pair_a", "pair_b", "pair_docs"))
                for k in range(0, len(a), 100_000):
                    part = slice(k, k + 100_000)
                    count = len(a[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(count, row["slice"])), pa.array(np.arange(k, k + count, dtype=np.int32)), pa.array(a[part]), pa.array(b[part]), pa.array(n[part])], ["slice", "place", "a", "b", "n"])

    packed = cut.where("pair_a IS NOT NULL").select("slice", "pair_a", "pair_b", "pair_docs")
    return packed.mapInArrow(lean(unpack), "slice long, place int, a int, b int, n int")


def pair_counts(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """a, b and n_docs: how many documents hold the pair of ids linked."""
    arrow_limits(docs.sparkSession)
    cut = scratch(sliced(with_key(settled(docs)), tokenizer, pieces), "sliced")
    return slice_pairs(cut).groupBy("a", "b").agg(F.sum("n").alias("n_docs"))


def align(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """ALIGNED: numbers of tokens, groups and links of each row, and what its links' pairs count corpus-wide.

    Null and empty texts, and those that one tokenizer's bytes don't give again, have zeros and an empty digest. Rows
    that repeat a doc_id, and null doc_ids, are documents of their own. An empty table gives an empty result; other
    columns play no part. A slice has at most SLICE_TEXT bytes of text, or one text.
    """
    arrow_limits(docs.sparkSession)
    cut = scratch(sliced(with_key(settled(docs)), tokenizer, pieces), "sliced")
    # a pair has one row per slice, whatever texts repeat; those of a slice come back together
    counted = slice_pairs(cut).withColumn("total", F.sum("n").over(Window.partitionBy("a", "b")))
    best = counted.groupBy("a").agg(F.max("total").alias("most"))  # a row per id of the vocabulary at most
    back = counted.join(F.broadcast(best), "a").select("slice", "place", "total", (F.col("total") == F.col("most")).alias("best"))
    schema = pa.schema([(n, KINDS[t]) for n, t in (f.split() for f in ALIGNED.split(", "))])

    def scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
        total, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
        place = counts["place"].to_numpy()
        total[place], best[place] = counts["total"].to_numpy(), counts["best"].to_numpy()
        n_best, count_sum = [], []
        for pairs, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist(), strict=True):
            at, m = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(m[best[at]].sum()))
            count_sum.append(int((m * total[at]).sum()))
        known = {"n_best": n_best, "count_sum": count_sum}
        return pa.table([known[f.name] if f.name in known else docs[f.name] for f in schema], schema=schema)

    texts = cut.where("row_key IS NOT NULL").select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return texts.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(scored, ALIGNED)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
