"""Operator 3: exact deduplication by an extendible-hash index on shared files.

Texts equal but for the case of A-Z are copies. Each distinct text has an entry in a bucket, found by the first bits of
its key (a hash). A directory maps the first d bits of a key to a bucket; an overfull bucket is split on its next bit,
and when it already uses all d bits the directory doubles first. Owner tasks each hold a range of buckets of about the
same size: they chain the texts of a key, compare their bytes, and write their buckets' entries to a shared file, sorted
by bucket. Rows are then looked up by bucket, key and digest. A bucket that is overfull at the directory's full depth is
an overflow chain: entries are streamed in the order of their keys, so only one key's chain is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, arrow_limits, buffers, lean, only_rows, read, scratch, settled, with_key

#: A bucket splits beyond so many bytes of texts, or more where the directory would have more than so many buckets.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 16
#: Keys have so many bits; the directory doubles up to so many; texts one task combines before sending.
KEY_BITS, MOST_DEPTH, COMBINE_BYTES = 62, 30, 16 << 20
#: Groups of one in so many rows or more (so no more groups than that) are looked up apart from the others.
HOT_PART = 1000

ENTRY = "owner int, bucket int, key long, sha binary, norm binary, last_doc long, last_row long, copies long"
INDEX = "bucket int, key long, chain int, sha binary, n_bytes long, keep_id long, keep_row long, group_size long"


def normal(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def key_of(sha: bytes, bits: int) -> int:
    return int.from_bytes(sha[:8], "big") >> (64 - bits)


class Directory:
    """Buckets by their first bits. depth: bits that the directory uses; a bucket with the prefix p of its own (local)
    depth l has the 2 ** (depth - l) slots that begin with p, so a doubling needs no copy of the slots."""

    def __init__(self, bits: int = KEY_BITS):
        self.bits, self.depth, self.prefix, self.local, self.size = bits, 0, [0], [0], [0]

    def split(self, bucket: int) -> int:
        """Split a bucket on its next bit, doubling the directory where it has none left; the new half's number."""
        if self.local[bucket] == self.depth:
            self.depth += 1
        self.local[bucket] += 1
        self.prefix[bucket] *= 2
        self.local.append(self.local[bucket])
        self.prefix.append(self.prefix[bucket] + 1)
        self.size.append(0)
        return len(self.local) - 1

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The first key of each bucket, sorted, and the buckets' numbers in that order."""
        first = np.array([p << (self.bits - n) for p, n in zip(self.prefix, self.local, strict=True)], np.int64)
        order = np.argsort(first)
        return first[order], order.astype(np.int32)

    def owners(self, tasks: int) -> np.ndarray:
        """The owner task of each bucket: ranges of the directory of about the same size in bytes."""
        _, order = self.table()
        size = np.array(self.size, np.float64)[order] + 1
        out = np.empty(len(order), np.int32)
        out[order] = np.minimum((np.cumsum(size) - size) / size.sum() * tasks, tasks - 1)
        return out


def grow_directory(weights: DataFrame, bits: int, bucket_bytes: int, most: int = MOST_BUCKETS) -> Directory:
    """Split buckets until none holds more than bucket_bytes (or a most-th of all, if that is more), or all bits are used.

    weights has key and bytes. Bytes are summed by the first bits of the keys, some bits more than an even spread needs;
    what is overfull then is summed by further bits alone. The driver gets a few times as many sums as buckets.
    """
    directory = Directory(bits)
    total = weights.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bucket_bytes = max(bucket_bytes, total // most)
    deepest = min(bits, MOST_DEPTH)
    used = min(deepest, max(0, total // bucket_bytes).bit_length() + 2)
    heads, full = weights.withColumn("head", F.shiftright("key", bits - used)), {0: 0}
    while True:
        sums = {r["head"]: r["n"] for r in heads.groupBy("head").agg(F.sum("bytes").alias("n")).collect()}
        levels = [sums]  # sums by ever fewer bits
        while len(levels) <= used:
            upper: dict[int, int] = {}
            for head, n in levels[-1].items():
                upper[head >> 1] = upper.get(head >> 1, 0) + n
            levels.append(upper)
        stack, full = list(full), {}
        while stack:
            bucket = stack.pop()
            n = directory.size[bucket] = levels[used - directory.local[bucket]].get(directory.prefix[bucket], 0)
            if n <= bucket_bytes:
                continue
            if directory.local[bucket] == used:
                full[bucket] = directory.prefix[bucket]
                continue
            stack += [bucket, directory.split(bucket)]
        if not full or used == deepest:
            return directory
        older, used = used, min(deepest, used + 6)
        over = weights.sparkSession.createDataFrame([(p,) for p in full.values()], "older long")  # few, as keys are hashes
        heads = weights.withColumn("older", F.shiftright("key", bits - older)).join(F.broadcast(over), "older").withColumn("head", F.shiftright("key", bits - used))


def finder(directory: Directory, tasks: int):
    """A function from keys to their buckets and owner tasks."""
    (first, order), owners = directory.table(), directory.owners(tasks)

    def find(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buckets = order[np.searchsorted(first, keys, "right") - 1]
        return buckets, owners[buckets]

    return find


def combined(docs: DataFrame, directory: Directory, tasks: int) -> DataFrame:
    """Each task's distinct texts with their copies, last row, bucket and owner: a hot text is one row a task and flush."""
    bits, find = directory.bits, docs.sparkSession.sparkContext.broadcast((directory, tasks))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}  # by the text itself, so bytes decide
        place = finder(*find.value)
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            shas = [hashlib.sha256(t).digest() for t in held]
            rows = list(held.values())
            keys = np.array([key_of(s, bits) for s in shas], np.int64)
            buckets, owners = place(keys)
            out = pa.RecordBatch.from_arrays([pa.array(owners), pa.array(buckets), pa.array(keys), pa.array(shas, pa.binary()), pa.array(list(held), pa.binary()), pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows]), pa.array([r[1] for r in rows])], ["owner", "bucket", "key", "sha", "norm", "last_doc", "last_row", "copies"])
            held, size = {}, 0
            return out

        for batch in batches:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            for k, last in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), strict=True)):
                text = normal(raw[off[k] : off[k + 1]])
                row = held.get(text)
                if row is None:
                    held[text] = [last, 1]
                    size += len(text) + 100
                else:
                    row[:] = later(row[0], last), row[1] + 1
                if size > COMBINE_BYTES:
                    yield flush()
        if held:
            yield flush()

    arrow_limits(docs.sparkSession)
    return with_key(docs).mapInArrow(lean(combine), ENTRY)


def later(a: tuple, b: tuple) -> tuple:
    """The larger (doc_id, row_key); a null doc_id is least."""
    return max(a, b, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def keyed(docs: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """row_key, doc_id, key, sha256 and size of every row's normalised text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            shas = [hashlib.sha256(normal(raw[a:b])).digest() for a, b in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array([key_of(s, bits) for s in shas], pa.int64()), pa.array(shas, pa.binary()), pa.array(np.diff(off), pa.int64())], ["row_key", "doc_id", "key", "sha", "bytes"])

    arrow_limits(docs.sparkSession)
    return with_key(docs).mapInArrow(lean(sums), "row_key long, doc_id long, key long, sha binary, bytes long")


def build_index(docs: DataFrame, directory: Directory) -> DataFrame:
    """The index: a row per distinct text, each owner task's buckets in a file of their own."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and key; one key's chain is held at a time."""
        now, chain = None, []

        def close() -> list[tuple]:
            seen = set()
            for e in chain:
                if (e[0], len(e[1])) in seen:
                    raise ValueError("two texts of one length have the same sha256")
                seen.add((e[0], len(e[1])))
            return [(*now, k, e[0], len(e[1]), *e[2], e[3]) for k, e in enumerate(chain)]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["bucket"], row["key"]) != now:
                    if now is not None:
                        out += close()
                    now, chain = (row["bucket"], row["key"]), []
                last = row["last_doc"], row["last_row"]
                for e in chain:
                    if e[1] == row["norm"]:
                        e[2:] = later(e[2], last), e[3] + row["copies"]
                        break
                else:
                    chain.append([row["sha"], row["norm"], last, row["copies"]])
            yield _index_batch(out)
        if now is not None:
            yield _index_batch(close())

    dealt = combined(docs, directory, tasks).repartitionById(tasks, "owner").sortWithinPartitions("bucket", "key", "sha")
    return scratch(dealt.select("bucket", "key", "sha", "norm", "last_doc", "last_row", "copies").mapInArrow(lean(own), INDEX), "dedup-index")


def bucketed(rows: DataFrame, directory: Directory) -> DataFrame:
    """rows with the bucket of their key, as the directory has it."""
    sent = rows.sparkSession.sparkContext.broadcast((directory, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(*sent.value)
        for batch in batches:
            yield batch.append_column("bucket", pa.array(find(batch.column("key").to_numpy())[0]))

    return rows.mapInArrow(lean(place), "row_key long, doc_id long, key long, sha binary, bytes long, bucket int")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["bucket", "key", "chain", "sha", "n_bytes", "keep_id", "keep_row", "group_size"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def exact_dedup(docs: DataFrame, bits: int = KEY_BITS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """row_key, doc_id, keep_id, group_size, kept and text_sha256 of every row.

    A null text is an empty one. Of equal texts the row with the largest doc_id stays; a null doc_id is less than any
    other. Where rows repeat a doc_id with one text, the last of them in the table stays. An empty table gives no row.
    """
    docs = settled(docs)
    rows = scratch(keyed(docs, bits), "dedup-keys")
    directory = grow_directory(rows.groupBy("key", "sha").agg(F.first("bytes").alias("bytes")), bits, bucket_bytes)
    index = build_index(docs, directory).select("bucket", "key", "sha", F.col("n_bytes").alias("bytes"), "keep_id", "keep_row", "group_size")
    by = ["bucket", "key", "sha", "bytes"]
    hot = F.col("group_size") * HOT_PART >= max(rows.count(), HOT_PART * 100)
    few = F.broadcast(index.where(hot))  # HOT_PART entries at most
    placed = bucketed(rows, directory)
    found = placed.join(few, by).unionByName(placed.join(few.select(by), by, "left_anti").join(index.where(~hot), by))
    return found.select("row_key", "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup() keeps."""
    docs = settled(docs)
    return only_rows(docs, exact_dedup(docs).where("kept"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("row_key")


ORACLE = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
