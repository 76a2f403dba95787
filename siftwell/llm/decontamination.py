"""Operator 1: benchmark decontamination by Wu-Manber multi-pattern search.

A pattern is a window of a benchmark item: so many consecutive words of it, or all of them where it has fewer. Patterns
of one length form a search table. Its signs are words: the shift table tells, for a block of two words at the end of
the search window, how far the window may move on without missing a pattern; where it may not move, the block's bucket
has the patterns that end in it, and a direct comparison of the words confirms an occurrence.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, arrow_limits, lean, read, with_key

WINDOW_WORDS = 10
#: Search tables are built, and sent to the tasks, for so many bytes of benchmark words at a time; they take about 125
#: times as much memory on the driver, and in each worker.
BLOCK_BYTES = 4 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(UPPER, UPPER.lower())

FOUND = "row_key long, doc_id long, n_words long, spans array<int>, items array<string>"


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


class Table:
    """Patterns of one length: shift by the last block of words, and buckets of patterns by it."""

    def __init__(self, length: int, patterns: dict[tuple[str, ...], int]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket = defaultdict(list)
        for pattern, number in patterns.items():
            for end in range(self.block, length + 1):
                b = self.key(pattern, end)
                move = length - end
                if move < self.shift.get(b, self.default):
                    self.shift[b] = move
            self.bucket[self.key(pattern, length)].append((pattern, number))
        self.bucket = dict(self.bucket)

    def key(self, w, end: int):
        return (w[end - 2], w[end - 1]) if self.block == 2 else w[end - 1]

    def search(self, w: list[str]) -> Iterator[tuple[int, int]]:
        """Start and number of each occurrence in the words w."""
        n, m, default, shift = len(w), self.length, self.default, self.shift.get
        end = m
        two = self.block == 2
        while end <= n:
            b = (w[end - 2], w[end - 1]) if two else w[end - 1]
            move = shift(b, default)
            if move:
                end += move
                continue
            found = tuple(w[end - m : end])
            for pattern, number in self.bucket[b]:
                if pattern == found:
                    yield end - m, number
            end += 1


class Patterns:
    """The search tables of some items, by length, and the items of each pattern."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        numbers: dict[tuple[str, ...], int] = {}
        self.items: list[set[str]] = []
        for name, text in items:
            w = words(text)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                p = tuple(w[k : k + window])
                if p not in numbers:
                    numbers[p] = len(numbers)
                    self.items.append(set())
                self.items[numbers[p]].add(name)
        by_length = defaultdict(dict)
        for p, k in numbers.items():
            by_length[len(p)][p] = k
        self.tables = [Table(n, ps) for n, ps in sorted(by_length.items())]

    def search(self, w: list[str]) -> tuple[list[int], set[str]]:
        """Starts and ends of the hit runs of words, joined where they touch, and the items found."""
        hits = [(start, start + t.length, k) for t in self.tables for start, k in t.search(w)]
        if not hits:
            return [], set()
        return merge((a, b) for a, b, _ in hits), set().union(*(self.items[k] for _, _, k in hits))


def merge(runs) -> list[int]:
    """Runs (start, end) joined where they touch, flat and in order."""
    out: list[int] = []
    for a, b in sorted(runs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items (id as text, text), so many bytes at a time, by a streaming read on the driver."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).toLocalIterator():
        held.append((r["item_id"] or "", r["text"]))
        size += len(r["text"]) + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row_key, doc_id, n_words, spans (starts and ends of hit runs of words, in order) and items found of every row.

    The benchmark is the query set: its items are searched for in all documents, block by block, and what the blocks
    find is joined per document. Null texts have no words; items without words find nothing; a null item_id is ''.
    Rows that repeat a doc_id each get a row.
    """
    arrow_limits(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    keyed = with_key(docs)

    def scan(number: int, block: list[tuple[str, str]]) -> DataFrame:
        sent = context.broadcast(pickle.dumps(Patterns(block, window)))
        first = number == 0

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = pickle.loads(sent.value)
            for batch in batches:
                rows = []
                for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row_key", "doc_id", "text")), strict=True):
                    w = words(text)
                    spans, items = patterns.search(w)
                    if first or spans:  # the first block has a row for each document, the others for what they find
                        rows.append((key, doc, len(w), spans, sorted(items)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["row_key", "doc_id", "n_words", "spans", "items"])

        return keyed.mapInArrow(lean(find), FOUND)

    parts = [scan(k, b) for k, b in enumerate(blocks(benchmark, block_bytes))] or [scan(0, [])]
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("spans") - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("a"), F.get("spans", i + 1).alias("b")))
    pairs = F.filter(pairs, lambda x: x["a"].isNotNull())
    joined = every.groupBy("row_key", "doc_id", "n_words").agg(F.flatten(F.collect_list(pairs)).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    # runs of different blocks may touch
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merge((r["a"], r["b"]) for r in runs) for runs in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_key", "doc_id", "n_words")), pa.array(spans, pa.list_(pa.int32())), batch.column("items")], ["row_key", "doc_id", "n_words", "spans", "items"])

    return joined.select("row_key", "doc_id", "n_words", "runs", "items").mapInArrow(lean(tidy), FOUND)


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window occurs; block by block, without a shuffle.

    Null and empty texts have no words and stay, each repeated row stays or goes like the first, an empty table or
    benchmark changes nothing, other columns may have any names.
    """
    arrow_limits(docs.sparkSession)
    for block in blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Patterns(block, window)))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            patterns = pickle.loads(sent.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not patterns.search(words(t or ""))[0] for t in texts], pa.bool_()))

        docs = docs.mapInArrow(lean(clean), docs.schema)
    return docs


def report(found: DataFrame) -> DataFrame:
    """Digest columns of search()."""
    spans = F.col("spans")
    hit = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(spans) - 2, F.lit(0)), F.lit(2)), F.lit(0).cast("bigint"), lambda acc, i: acc + F.coalesce(F.get(spans, i + 1) - F.get(spans, i), F.lit(0)))
    out = found.withColumn("n_hit", hit)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = WINDOW_WORDS) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items by comparing every place with every window; for tests."""
    w = words(text or "")
    hit, found = set(), set()
    for name, other in items:
        o = words(other or "")
        for k in range(max(1, len(o) - window + 1) if o else 0):
            p = o[k : k + window]
            for at in range(len(w) - len(p) + 1):
                if w[at : at + len(p)] == p:
                    hit.update(range(at, at + len(p)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(w[k:k + {WINDOW_WORDS - 1}], ' ') AS p, least(len(w), {WINDOW_WORDS}) AS m FROM item, unnest(range(1, greatest(len(w) - {WINDOW_WORDS - 2}, 2))) AS t(k) WHERE len(w) > 0),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT m FROM win),
spot AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS p FROM doc, size, unnest(range(1, len(w) - m + 2)) AS t(k)),
hit AS (SELECT s.doc_id, s.k, s.m, win.item_id FROM spot s JOIN win ON s.p = win.p AND s.m = win.m),
word AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS j FROM hit) GROUP BY doc_id),
item_of AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc.doc_id, len(doc.w) AS n_words, coalesce(word.n_hit, 0) AS n_hit, coalesce(item_of.n_items, 0) AS n_items, sha256(coalesce(item_of.ids, '')) AS items_sha256, coalesce(word.n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN item_of USING (doc_id)
"""
