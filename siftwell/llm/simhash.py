"""Operator 5: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority vote of the hashes of a text's word shingles. For radius r each bit gets a
nonzero vector of r + 1 bits. Each nonzero vector v of r + 1 bits makes a table, keyed by those fingerprint bits whose
vector has an odd product with v. Whatever r bits two fingerprints differ in, some v is orthogonal to their r vectors,
so in its table the key leaves these bits out and the two meet: no pair within the radius is missed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, buffers, drop, lean, read, scratch, settled, with_key

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
#: A bucket of more fingerprints is dealt out again by a second covering of the bits that its key leaves out.
BUCKET = 32768


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """As an unsigned number. Words are what white space (0x09-0x0D, 0x20) parts, lower-cased in A-Z."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    whole = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(w)) - 1 :]
    votes = np.zeros(64, np.int64)
    step = 65_536
    del w
    for k in range(0, n, step):
        h = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begins[k : min(k + step, n)].tolist(), last[k : k + step].tolist(), strict=True)), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """row_key, doc_id and fp (the fingerprint's bits as a signed number) of every whole text; null is empty."""
    arrow_limits(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(off, off[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(fps.view(np.int64))], ["row_key", "doc_id", "fp"])

    return with_key(docs).mapInArrow(lean(sign), "row_key long, doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit positions: any radius of them are all left out by some mask.

    That holds for any nonzero vectors. Where there are fewer bits than vectors, those are taken whose least mask is
    largest, as a mask of few bits would make few, large buckets.
    """
    size = (1 << (radius + 1)) - 1

    def masks(vectors: list[int]) -> list[int]:
        return [sum(1 << b for b, u in zip(bits, vectors, strict=True) if (u & v).bit_count() % 2) for v in range(1, size + 1)]

    choices = [[k % size + 1 for k in range(len(bits))]]
    if len(bits) < size:
        rng = random.Random(SEED)
        choices += [rng.sample(range(1, size + 1), len(bits)) for _ in range(8)]
        if len(bits) == 1 << radius:  # all with the first bit set: each mask but one has half of the bits
            choices.append([len(bits) + k for k in range(len(bits))])
    return max(map(masks, choices), key=lambda ms: min(m.bit_count() for m in ms))


def links_in(fps: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of roots that chains of links between a bucket's fingerprints connect: each but a chain's least, with it.

    Fingerprints with one root are connected already. Buckets that hold the same rows give the same pairs.
    """
    names, own = np.unique(roots, return_inverse=True)
    if len(names) == 1:
        return names[:0], names[:0]
    rows = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))[:-1])
    rest = np.ones(len(fps), bool)
    left, right = [], []
    for seed in range(len(names)):
        if not rest[rows[seed][0]]:
            continue
        rest[rows[seed]] = False
        front = rows[seed].tolist()
        others = np.flatnonzero(rest)
        while front and len(others):
            k = front.pop()
            near = np.unique(own[others[np.bitwise_count(fps[others] ^ fps[k]) <= radius]])
            if len(near):
                for m in near.tolist():
                    rest[rows[m]] = False
                    front += rows[m].tolist()
                left += [seed] * len(near)
                right += near.tolist()
                others = others[rest[others]]
    return names[np.array(left, np.int64)], names[np.array(right, np.int64)]


def link_groups(dealt: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Links (a, b) of roots within each group of rows (fp, root) that agree in keys."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = links_in(rows["fp"].to_numpy().view(np.uint64), rows["root"].to_numpy(), radius)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy(*keys).applyInPandas(link, "a long, b long")


def link_sorted(dealt: DataFrame, key, radius: int, bucket: int) -> DataFrame:
    """As link_groups by t and key (a column of t and fp), for many small groups: a task takes group after group.

    Rows come sorted. A group of more than bucket fingerprints isn't linked, but gives one row with large set, t in a
    and the key in b; no more than that many fingerprints are held.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: list[np.ndarray], b: list[np.ndarray], large: bool) -> pa.RecordBatch:
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], ["a", "b", "large"])

        def close(t: np.ndarray, key: np.ndarray, fp: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            begins = np.concatenate([[0], edge, [len(t)]])
            sizes = np.diff(begins)
            two = begins[:-1][sizes == 2]  # pairs, all at once
            near = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & (root[two] != root[two + 1])]
            a, b = [np.minimum(root[near], root[near + 1])], [np.maximum(root[near], root[near + 1])]
            for k in np.flatnonzero((sizes > 2) & (sizes <= bucket)).tolist():
                x, y = links_in(fp[begins[k] : begins[k + 1]], root[begins[k] : begins[k + 1]], radius)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):  # what repeats within the task goes once
                a, b = np.unique(np.stack([a, b]), axis=1)
            yield out([a], [b], False)
            many = begins[:-1][sizes > bucket]
            if len(many):
                yield out([t[many].astype(np.int64)], [key[many]], True)

        held: tuple[np.ndarray, ...] = ()
        over = None  # the group that goes on, too large to hold
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp", "root")]
            if over:
                skip = int(np.count_nonzero((now[0] == over[0]) & (now[1] == over[1])))
                now = [x[skip:] for x in now]
            if not len(now[0]):
                continue
            over = None
            now[2] = now[2].view(np.uint64)
            t, key, fp, root = (np.concatenate(x) for x in zip(held, now, strict=True)) if held else (x.copy() for x in now)
            other = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from close(t[:cut], key[:cut], fp[:cut], root[:cut])
            held = (t[cut:], key[cut:], fp[cut:], root[cut:])
            if len(t) - cut > bucket:
                over = (t[-1], key[-1])
                yield from close(*held)
                held = ()
        if held:
            yield from close(*held)

    return dealt.repartition("t", key).withColumn("key", key).sortWithinPartitions("t", "key").select("t", "key", "fp", "root").mapInArrow(lean(link), "a long, b long, large boolean")


def bucket_links(prints: DataFrame, tables: list[tuple[int, int]], radius: int, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of roots that chains of links connect, of prints (j, fp, root) in some tables (j, mask).

    j tells apart kinds of fingerprints; of one kind, each occurs once. Buckets that aren't too large are linked in one
    task, all by one shuffle of a table's number, a fingerprint and its root. A larger one is dealt out by a second
    covering, of the bits that its table's key leaves out, whose groups hold 2 ** 16 fingerprints at most or so.
    """
    spark = prints.sparkSession
    constants = F.array(*(F.lit(signed(m)) for _, m in tables))
    kinds = sorted({j for j, _ in tables})
    of_kind = F.create_map(*(x for j in kinds for x in (F.lit(j), F.array(*(F.lit(t) for t, (i, _) in enumerate(tables) if i == j)))))
    dealt = prints.select(F.explode(F.element_at(of_kind, F.col("j"))).alias("t"), "fp", "root")
    key = F.col("fp").bitwiseAND(F.get(constants, F.col("t")))
    found = scratch(link_sorted(dealt, key, radius, bucket), "bucket-links")
    small, large = found.where("NOT large").select("a", "b"), found.where("large").select(F.col("a").cast("int").alias("t"), F.col("b").alias("key"))
    small.scratch_path = found.scratch_path
    if large.isEmpty():
        return small
    second = [(t, s, signed(m2)) for t, (_, m) in enumerate(tables) for s, m2 in enumerate(covering(radius, [b for b in range(64) if not m >> b & 1]))]
    again = spark.createDataFrame(second, "t int, s int, m long")
    hot = dealt.withColumn("key", key).join(large, ["t", "key"], "left_semi")
    hot = hot.join(F.broadcast(again), "t").select("t", "key", "s", F.col("fp").bitwiseAND(F.col("m")).alias("key2"), "fp", "root")
    out = small.unionByName(link_groups(hot, radius, ["t", "key", "s", "key2"]))
    out.scratch_path = found.scratch_path
    return out


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that chains of links within the radius connect; none is missed."""
    prints = distinct.select(F.lit(0).alias("j"), "fp", F.col("fp").alias("root"))
    return bucket_links(prints, [(0, m) for m in covering(radius, list(range(64)))], radius, bucket)


def components(edges: DataFrame) -> DataFrame:
    """node and root (least node of its component) of every node of the edges (a, b), by alternating stars.

    A large star points a node's larger neighbours at its least one, a small star its smaller ones; both keep what is
    connected, and the depth of the trees falls by a factor each round. Nothing is collected but two numbers a round.
    """
    edges = scratch(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))  # here b < a throughout
        small = big.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        done, edges = edges, scratch(small, "links")
        drop(done)
        before, now = now, state(edges)
        if before == now:
            break
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.scratch_path = edges.scratch_path
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """row_key, doc_id, fp, component_id (least doc_id reachable by links) and keep_row (the component's row to keep).

    Texts with one fingerprint are linked, so the empty ones are, too; beyond that only distinct fingerprints are
    compared. The kept row is the one with the least doc_id (a null one comes last), or the first of the table of those.
    Null texts are empty; an empty table gives no row; texts may have any length, other columns any names.
    """
    rows = scratch(fingerprints(settled(docs), shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    distinct = scratch(rows.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    label = rooted.join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.row_key").alias("keep_row"))
    return rows.join(label, "fp").select("row_key", "doc_id", "fp", "component_id", "keep_row")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
