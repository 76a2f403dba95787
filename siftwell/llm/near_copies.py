"""Near copies of whole texts: candidates by covering locality-sensitive hashing of SimHash, confirmed by their shingles.

Copies have a Jaccard similarity of five-word shingles of 0.8 or more. An edit changes fewer two-word shingles, so the
fingerprints vote over these: a text has PRINTS independent fingerprints of 64 bits, and two texts are candidates where
one of them differs in RADIUS bits or fewer, which the covering masks of simhash.py never miss. At a similarity of 0.8
a fingerprint differs in 6 bits in the mean, so one of five is within 5 bits for 95 of 100 pairs; closer pairs more often.
Chains of candidates make components, and an exact join by shingle prefixes within these finds all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, buffers, clean_up, drop, lean, scratch, settled, with_key, without_rows
from .simhash import SEED, bucket_links, components, covering

PRINT_WORDS, PRINTS, RADIUS = 2, 5, 5
#: Two texts are copies if their shingles of so many words have this Jaccard similarity.
CONFIRM_WORDS, CONFIRM_LEAST = 5, 0.8
#: Before the exact join rows are compared with one row each of some groups, in so many rounds of so many groups a row; a
#: row compared with more than FIRST_ROWS others is dealt out.
CONFIRM_ROUNDS, CONFIRM_GROUPS, FIRST_ROWS = 2, 6, 512
#: Tables linked at once. After each of the first sets what it connects is one node, so that a large group makes few
#: links: most of it is connected by equal fingerprints and a few tables, whose links are stars.
TABLE_SETS, MOST_TABLES = (4,), 96
#: Steps of the exact join: one in so many blocks, each dealt out to parts of so many rows, and at last all whole blocks.
#: A row meets a bounded number of others until the last step, and a large group of copies is connected before that.
BLOCK_STEPS = ((8, 8), (4, 32), (2, 256), (1, None))
#: 256 bits a row, each the parity of the number of its hashes with some last bits: two rows differ in no more of these
#: bits than in hashes.
SKETCH = ("p0", "p1", "p2", "p3")
#: Rows, about, in which shingles are counted to put common ones last, and from how many rows on one is common.
COMMON_ROWS, COMMON_LEAST = 20_000, 8

_MIX = np.uint64(0xD6E8FEB86659FD93)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words; what was seen is kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxh64_intdigest(word, SEED)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(29)


def word_hashes(text: bytes, known: WordHashes, step: int = 1 << 20) -> np.ndarray:
    """Of each word of a text; a long one is split step bytes at a time, where a word ends."""
    out, at = [], 0
    while at < len(text):
        end = at + step
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        w = text[at:end].lower().split()
        out.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingled(words: np.ndarray, shingle: int) -> np.ndarray:
    """A number for each run of so many words; for fewer words one of all, for none none."""
    n = len(words)
    if not n:
        return words
    size = min(shingle, n)
    out = words[: n - size + 1]
    for k in range(1, size):
        out = mixed(out) + words[k : n - size + 1 + k]
    return mixed(out)


def prints_of(texts: list[np.ndarray], prints: int = PRINTS, step: int = 32_768) -> np.ndarray:
    """Fingerprints (rows by texts) from the shingles of each: bits set in over half of them; 0 for no shingle."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    votes = np.zeros((prints, len(texts), 64), np.int64)
    for lo in range(0, len(flat), step):
        hi = min(lo + step, len(flat))
        own = np.flatnonzero((begins < hi) & (ends > lo) & (sizes > 0))
        starts = np.maximum(begins[own], lo) - lo
        for j in range(prints):
            h = mixed(flat[lo:hi] * (_ODD + np.uint64(2 * j)))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[j, own] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > sizes[None, :, None], axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def fingerprint_rows(docs: DataFrame, shingle: int = PRINT_WORDS, prints: int = PRINTS) -> DataFrame:
    """row_key, doc_id and f0, f1, ...: the fingerprints of every whole text, as signed numbers."""
    names = [f"f{j}" for j in range(prints)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            got = [np.zeros((prints, 0), np.uint64)]
            texts, size = [], 0
            for a, b in zip(off, off[1:], strict=False):
                texts.append(shingled(word_hashes(raw[a:b], known), shingle))
                size += len(texts[-1])
                if size > 200_000:
                    got.append(prints_of(texts, prints))
                    texts, size = [], 0
            got.append(prints_of(texts, prints))
            fps = np.concatenate(got, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), *map(pa.array, fps)], ["row_key", "doc_id", *names])

    return with_key(docs).mapInArrow(lean(sign), "row_key long, doc_id long, " + ", ".join(f"{n} long" for n in names))


def relabelled(table: DataFrame, roots: DataFrame, label: str) -> DataFrame:
    """table with its column root replaced by that root's new root, where roots (node, root) has one."""
    new = roots.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return scratch(table.join(new, "root", "left").withColumn("root", F.coalesce("new", "root")).select(*table.columns), label)


def candidate_components(rows: DataFrame, prints: int = PRINTS, radius: int = RADIUS) -> DataFrame:
    """row_key and part of each row whose component has several rows; part is the component's least row_key.

    rows is fingerprint_rows(). Rows that agree in all fingerprints are one node. Each set of tables is one shuffle with
    a written result; after the first sets links are merged, so that buckets of what is connected already make no more.
    """
    names = [f"f{j}" for j in range(prints)]
    nodes = scratch(rows.groupBy(*names).agg(F.min("row_key").alias("node")), "near-nodes")
    own = nodes.select("node", F.col("node").alias("root"))
    each = nodes.select("node", F.posexplode(F.array(*names)).alias("j", "fp"))
    state = scratch(each.groupBy("j", "fp").agg(F.min("node").alias("root")), "near-prints")
    edges = [each.join(state, ["j", "fp"]).where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))]
    masks = covering(radius, list(range(64)))
    tables = [(j, m) for m in masks for j in range(prints)]
    sets, at = [], 0
    for n in [*TABLE_SETS, *[MOST_TABLES] * (len(tables) // MOST_TABLES + 1)]:
        sets.append(tables[at : at + n])
        at += n
    sets = [s for k, s in enumerate(sets) if s or not k]
    for k, now in enumerate(sets):
        if now:
            edges.append(bucket_links(state, now, radius))
        if k < len(TABLE_SETS) or k == len(sets) - 1:
            union = edges[0]
            for e in edges[1:]:
                union = union.unionByName(e)
            roots = components(union)
            done, own = [own, *edges], relabelled(own, roots, "near-roots")
            edges = []
            if k < len(sets) - 1:
                done.append(state)
                state = relabelled(state, roots, "near-prints")
            drop(roots, *done)
            clean_up(rows.sparkSession)
    parts = rows.join(nodes, names).join(own, "node").select("row_key", "root")
    counted = scratch(parts, "near-parts")
    drop(state, own, nodes)
    several = counted.groupBy("root").agg(F.count("*").alias("n"), F.min("row_key").alias("part")).where("n > 1")
    members = scratch(counted.join(several, "root").select("row_key", "part"), "near-members")
    drop(counted)
    return members


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted; a text of fewer words has one, of all of them, and an empty one none."""
    return np.unique(shingled(word_hashes(text, WordHashes()), shingle)).view(np.int64)


def least_hash(hashes: np.ndarray, number: int) -> int:
    """The least of the hashes, 0 for none, as the number-th mixing of their bits orders them."""
    x = hashes.view(np.uint64) * np.uint64((2 * number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return int(x.min(initial=np.uint64((1 << 64) - 1))) >> 1


def alike(a: str, b: str, least: float):
    """Whether two columns of distinct hashes have a Jaccard similarity of least or more."""
    both = F.size(F.array_intersect(a, b))
    return both >= (F.size(a) + F.size(b) - both) * least


def clustered(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the cluster of each: its root in roots (node, root), or itself."""
    return rows.join(roots.withColumnRenamed("node", "row_key"), "row_key", "left").withColumn("cluster", F.coalesce("root", "row_key")).drop("root")


def common_hashes(rows: DataFrame) -> np.ndarray:
    """Hashes, sorted, that COMMON_LEAST rows or more have of about COMMON_ROWS of rows (row_key, hashes)."""
    part = max(1, rows.count() // COMMON_ROWS)
    sample = rows.where(F.pmod(F.xxhash64("row_key"), F.lit(part)) == 0).select(F.explode("hashes").alias("h"))
    return np.sort(sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_LEAST).select("h").toArrow().column("h").to_numpy())


def is_common(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    return common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)


def with_rare(rows: DataFrame, sent) -> DataFrame:
    """part, row_key, sigs and rare, the number of the row's hashes that aren't common. In a group of copies of one text
    the row with the fewest is the most like that text, so it's alike with more of the others than most rows are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for batch in batches:
            off = batch.column("hashes").offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(~is_common(batch.column("hashes").values.to_numpy(), common))])
            rare = (sums[off[1:]] - sums[off[:-1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "row_key", "sigs")), pa.array(rare)], ["part", "row_key", "sigs", "rare"])

    return rows.select("part", "row_key", "sigs", "hashes").mapInArrow(lean(count), "part long, row_key long, sigs array<long>, rare int")


def first_links(slim: DataFrame, rows: DataFrame, roots: DataFrame, places: list[int], least: float) -> DataFrame:
    """Links (a, b) of rows (row_key, hashes) that are alike, each with one row of a group; only of rows that roots
    (node, root) doesn't connect. slim is with_rare() of them.

    A group is a part's rows with one number at one of the places of sigs; its row is the one with the fewest rare
    hashes, the first one of these, of its largest cluster. Groups are made of slim rows; a row's hashes are dealt out
    FIRST_ROWS comparisons at a time, so those of a large group don't meet in one task.
    """
    slim = clustered(slim.select("part", "row_key", "rare", F.array(*(F.get("sigs", F.lit(k)) for k in places)).alias("sigs")), roots)
    sigs = scratch(slim.select("part", "row_key", "rare", "cluster", F.posexplode("sigs").alias("k", "sig")), "near-sigs")
    by = ["part", "k", "sig"]
    each = sigs.groupBy(*by, "cluster").agg(F.min(F.struct("rare", F.col("row_key").alias("b"))).alias("x"), F.count("*").alias("n")).select(*by, "cluster", "x.*", "n")
    groups = each.groupBy(*by).agg(F.max_by(F.struct("b", "cluster"), F.struct("n", -F.col("rare"), -F.col("b"))).alias("x"), F.sum("n").alias("n"), F.count("*").alias("clusters"))
    groups = scratch(groups.where("clusters > 1").select(*by, F.col("x.b").alias("b"), F.col("x.cluster").alias("other_cluster"), "n"), "near-firsts")
    shares = groups.groupBy("b").agg(F.ceil(F.max("n") / FIRST_ROWS).cast("int").alias("shares"))
    dealt = groups.join(shares, "b").select(*by, "b", "other_cluster", "shares", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("s"))
    pairs = sigs.withColumn("s", F.pmod(F.xxhash64("row_key"), F.lit(16)).cast("int")).join(dealt, [*by, "s"]).where("cluster <> other_cluster")
    pairs = scratch(pairs.select(F.col("row_key").alias("a"), "b", F.pmod(F.xxhash64("row_key"), F.col("shares")).cast("int").alias("share")).distinct(), "near-compared")
    others = rows.select(F.col("row_key").alias("b"), F.col("hashes").alias("other")).join(shares, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "other")
    mine = rows.select(F.col("row_key").alias("a"), F.col("hashes").alias("own"))
    judged = scratch(pairs.join(mine, "a").join(others, ["b", "share"]).where(alike("own", "other", least)).select("a", "b"), "near-judged")
    drop(sigs, groups, pairs)
    return judged


def prefixes(rows: DataFrame, sent, least: float) -> DataFrame:
    """Of each of rows (part, row_key, hashes) the first hashes, common ones last, as exact_pairs needs them."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for batch in batches:
            keys: list[np.ndarray] = []
            previous: list[np.ndarray] = []
            places: list[np.ndarray] = []
            early: list[np.ndarray] = []
            sizes, lengths, sketches = [], [], []
            off = batch.column("hashes").offsets.to_numpy()
            flat = batch.column("hashes").values.to_numpy()
            for p, a, b in zip(batch.column("part").to_numpy(), off, off[1:], strict=False):
                h, n = flat[a:b], int(b - a)
                take = n - ceil(least * n - 1e-9) + 1 if n else 0
                h = h[np.argsort(is_common(h, common), kind="stable")][:take]  # hashes are sorted
                keys.append(h ^ (np.array([p]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                previous.append(np.concatenate([keys[-1][:1], keys[-1][:-1]]))
                places.append(np.arange(take, dtype=np.int32))
                early.append(np.arange(take) <= n - ceil(2 * least / (1 + least) * n - 1e-9))
                sizes.append(n)
                lengths.append(take)
                sketches.append(np.packbits(np.bincount(flat[a:b] & 255, minlength=256) & 1).view(np.int64))
            if sizes:
                out = [np.concatenate(keys), np.concatenate(previous), np.repeat(batch.column("row_key").to_numpy(), lengths)]
                out += [np.repeat(np.array(sizes, np.int32), lengths), np.concatenate(places), np.concatenate(early)]
                out += [np.repeat(x, lengths) for x in np.stack(sketches, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "previous", "row_key", "n", "place", "early", *SKETCH])

    kind = "key long, previous long, row_key long, n int, place int, early boolean, " + ", ".join(f"{c} long" for c in SKETCH)
    return scratch(rows.select("part", "row_key", "hashes").mapInArrow(lean(prefix), kind), "near-prefixes")


def exact_pairs(starts: DataFrame, rows: DataFrame, roots: DataFrame, least: float, share: int = 1, size: int | None = None) -> DataFrame:
    """Links (a, b) between rows (part, row_key, hashes) of one part, but for those that roots (node, root) connects.

    An exact join by prefixes; starts is prefixes() of the rows. With the hashes of all rows in one order, two rows that
    are alike have a hash in common among the first n - ceil(least * n) + 1 of the larger one's n and the first
    n - ceil(2 * least / (1 + least) * n) + 1 of the smaller one's. Hashes that are common in a part of the rows come last
    in the order, so what many texts share makes no block of candidates, unless it is most of each. A block whose rows
    are all connected is left out, and in others the rows outside of the block's largest cluster are paired with the
    rest, so that a large group of copies isn't paired with itself. Rows that had the hash before in common, too, met in
    that one's block. Pairs whose parity bits (SKETCH) differ in more places than their hashes may are left out before
    any hashes are joined.

    With a share of more than 1 only one in so many blocks is taken, and with a size a block is dealt out to parts of
    about so many rows, which are joined each on its own: that makes some of the links only, in pairs that grow with the
    number of rows. What they connect needs no pairs when all whole blocks are joined, which finds all others.
    """
    starts = clustered(starts.where(F.pmod("key", F.lit(share)) == 0), roots).withColumnRenamed("row_key", "row")
    mixed = starts.groupBy("key").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.bool_or("early").alias("any"), F.count("*").alias("rows")).where("lo <> hi AND any")
    deal = F.lit(0) if size is None else F.pmod(F.xxhash64("row", F.lit(size)), F.ceil(F.col("rows") / size)).cast("int")
    starts = scratch(starts.join(mixed.select("key", "rows"), "key").withColumn("deal", deal).drop("rows"), "near-blocks")
    by = ["key", "deal"]
    most = starts.groupBy(*by, "cluster").agg(F.count("*").alias("k")).groupBy(*by).agg(F.max_by("cluster", F.struct("k", "cluster")).alias("most"))
    few = starts.join(most, by).where("cluster <> most").drop("most")
    a, b = few.alias("a"), starts.alias("b")
    needed = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(least / (1 + least)) - 1e-9)
    smaller_early = F.when(F.struct("a.n", "a.row") > F.struct("b.n", "b.row"), F.col("b.early")).otherwise(F.col("a.early"))
    reach = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.deal") == F.col("b.deal")) & (F.col("a.cluster") != F.col("b.cluster")) & smaller_early & (reach >= needed)
    if size is None and share == 1:
        near = near & ~((F.col("a.place") > 0) & (F.col("b.place") > 0) & (F.col("a.previous") == F.col("b.previous")))
    apart = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in SKETCH), F.lit(0))
    near = near & (apart <= F.floor((F.col("a.n") + F.col("b.n")) * F.lit((1 - least) / (1 + least)) + 1e-9))
    pairs = scratch(a.join(b, near).select(F.least("a.row", "b.row").alias("a"), F.greatest("a.row", "b.row").alias("b")).distinct(), "near-pairs")
    one = rows.select(F.col("row_key").alias("a"), F.col("part").alias("part_a"), F.col("hashes").alias("own"))
    two = rows.select(F.col("row_key").alias("b"), F.col("part").alias("part_b"), F.col("hashes").alias("other"))
    found = scratch(pairs.join(one, "a").join(two, "b").where((F.col("part_a") == F.col("part_b")) & alike("own", "other", least)).select("a", "b"), "near-exact")
    drop(starts, pairs)
    return found


def confirmed_copies(docs: DataFrame, members: DataFrame, shingle: int = CONFIRM_WORDS, least: float = CONFIRM_LEAST, rounds: int = CONFIRM_ROUNDS) -> DataFrame:
    """row_key of the rows to drop: all but one of each group that chains of links connect, where a link is a Jaccard
    similarity of word shingles of least or more within a part of members (row_key, part). The row with the least doc_id
    stays (the first place in the table, for equal ones; a null one is largest). Two texts without words are alike.

    Comparisons with one row each of some groups (all of a part, then those with a least shingle in common, by several
    orders) connect most rows cheaply, round by round; then exact_pairs compares all rows of a part that aren't
    connected yet. docs is settled() and has the places that members names.
    """
    arrow_limits(docs.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            found = [shingle_hashes(raw[a:b], shingle) for a, b in zip(off, off[1:], strict=False)]
            sigs = [[0] + [least_hash(h, k) for k in range(1, rounds * CONFIRM_GROUPS)] for h in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "row_key")), pa.array(sigs, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["part", "doc_id", "row_key", "sigs", "hashes"])

    kind = "part long, doc_id long, row_key long, sigs array<long>, hashes array<long>"
    rows = scratch(with_key(docs).join(members, "row_key").select("part", "doc_id", "row_key", "text").mapInArrow(lean(hashes), kind), "near-shingles")
    sent = docs.sparkSession.sparkContext.broadcast(common_hashes(rows))
    slim, starts = scratch(with_rare(rows, sent), "near-slim"), prefixes(rows, sent, least)
    roots = members.select(F.col("row_key").alias("node"), F.col("row_key").alias("root")).where("false")

    def joined(found: DataFrame) -> DataFrame:
        out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        drop(roots, found)
        clean_up(docs.sparkSession)
        return out

    for k in range(rounds):
        roots = joined(first_links(slim, rows, roots, list(range(k * CONFIRM_GROUPS, (k + 1) * CONFIRM_GROUPS)), least))
    drop(slim)
    for share, size in BLOCK_STEPS:
        more = exact_pairs(starts, rows, roots, least, share, size)
        if more.isEmpty():
            drop(more)
        else:
            roots = joined(more)
    ends = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    nodes = scratch(rows.select("row_key", "doc_id").join(ends, F.col("row_key") == F.col("node")).select("root", "doc_id", "row_key"), "near-groups")
    kept = nodes.groupBy("root").agg(best.alias("best")).select(F.col("best.row_key").alias("row_key"))
    copies = scratch(nodes.join(kept, "row_key", "left_anti").select("row_key"), "near-copies")
    drop(rows, starts, roots, nodes)
    return copies


def near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each group that links connect, the row with the least
    doc_id stays (a null one is largest, the first place in the table counts for equal ones).

    Texts without words are copies of each other. An empty table gives no row. Other columns may have any names.
    """
    docs = settled(docs)
    arrow_limits(docs.sparkSession)
    prints = scratch(fingerprint_rows(docs), "near-fingerprints")
    members = candidate_components(prints)
    drop(prints)
    copies = confirmed_copies(docs, members)
    drop(members)
    return without_rows(docs, copies)
