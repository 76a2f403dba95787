"""Operator 9: reproducible shuffle and sharding by a Feistel permutation over global row numbers. DataFrame code only.

Rows are numbered 0 to n-1 in the order of doc_id (then checksum and size). A keyed permutation of 0..n-1 gives each row
its place in the shuffled order; place mod shards is the shard and place div shards the slot, so shard sizes differ by
one row at most (law "rows"). The permutation is a Feistel network over a grid of a x b cells just larger than n; a
value that falls outside 0..n-1 walks on along its cycle until it is inside.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_dir

SHARDS, SEED, ROUNDS = 16, 20_240_613, 8


def grid(n: int) -> tuple[int, int]:
    """Sides a and b of the smallest grid with a near the square root of n: fewer than a cells too many."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(df: DataFrame, column: str, n: int, seed: int, out: str, rounds: int = ROUNDS) -> DataFrame:
    """Add the permuted value of column, whose values are in 0..n-1.

    A walk has at most as many steps as there are cells outside 0..n-1, which are fewer than the square root of n;
    about one row in sqrt(n) walks at all.
    """
    a, b = grid(n)

    def once(x: Column) -> Column:
        # the fold keeps each half's expression from being copied into both halves of the next round
        start = F.struct(((x - F.pmod(x, F.lit(b))) / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).alias("r"))
        end = F.aggregate(
            F.sequence(F.lit(0), F.lit(rounds - 1)),
            start,
            lambda s, k: F.when(
                k % 2 == 0,
                F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), k, s["r"]), F.lit(a)), F.lit(a)).alias("l"), s["r"].alias("r")),
            ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), k, s["l"]), F.lit(b)), F.lit(b)).alias("r"))),
        )
        return end["l"] * F.lit(b) + end["r"]

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col(out), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    df = df.withColumn(out, once(F.col(column)))
    df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walk))
    # a walk of over 64 steps has a probability of about n ** -32; it is reported, never passed on
    return df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("a walk of over 64 steps: choose another seed")).cast("bigint")))


def place_of(row_number: int, n: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """The same permutation for a single row number, computed without Spark, to find a row's shard and slot."""
    a, b = grid(n)

    def mix(seed: int, k: int, half: int, side: int) -> int:
        # as Spark chains the hash over its arguments: each one's hash seeds the next; ints are 4 bytes, longs 8
        h = 42
        for v, size in ((seed, 4), (k, 4), (half, 8)):
            h = _spark_hash(v, size, h)
        signed = h - (1 << 64) if h >> 63 else h
        return signed % side

    x = row_number
    while True:
        left, right = divmod(x, b)
        for k in range(rounds):
            if k % 2:
                right = (right + mix(seed, k, left, b)) % b
            else:
                left = (left + mix(seed, k, right, a)) % a
        x = left * b + right
        if x < n:
            return x


def _spark_hash(value: int, size: int, seed: int) -> int:
    """XXH64 of a 4-byte or 8-byte little-endian number, as Spark's xxhash64 has it."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest((value & ((1 << 8 * size) - 1)).to_bytes(size, "little"), seed)


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add a row number from 0 without gaps, in the order of the given columns, which need a fixed content.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the sizes of the partitions
    before. Only these sizes (one row per partition) meet in one task. The last column of order must tell rows with
    equal keys apart, so that no key, however frequent, has to fit in one partition.
    """
    shared_dir(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size_of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size_of_part").over(before), F.lit(0)).alias("base"))
    joined = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.withColumn(out, F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "place", "base")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard and slot of every row.

    size is the UTF-8 bytes of the text plus 1; a null text has none and the checksum of nothing. Rows with null
    doc_id are numbered first; equal rows are interchangeable, so the shuffle is the same for the same rows. An empty
    table gives an empty result. Other columns play no part. Only ids, sizes and checksums are shuffled, not texts.
    """
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    small = small.checkpoint()
    rows = numbered(small.withColumn("tie", F.monotonically_increasing_id()), ["doc_id", "text_crc32", "size", "tie"], "row_number").drop("tie")
    n = small.count()
    placed = permuted(rows, "row_number", n, seed, "place")
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("bigint"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
