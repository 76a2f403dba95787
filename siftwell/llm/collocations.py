"""Operator 11: phrase collocations from generalised suffix automata of bounded depth, one per shard and language.

A shard is some MB of text; its pieces are runs of words between marks. A suffix automaton's states are the classes of
substrings that end at the same places; bounded to DEPTH words they follow from the piece's positions sorted by the words
before them, read backwards: a class is a run of positions, the run's length its count (endpos), and the next shorter
string with more places is its suffix link. Each state stands for all its suffixes that are longer than its link.

Counts of the shards are summed up in Spark, in three steps, each of which prunes what can't reach LEAST: words; then
pairs of frequent words; then phrases of 3 and 4 words whose pairs are all frequent. No phrase of LEAST occurrences is
lost, since each part of it occurs as often. In between each shard gets back which of its own words and pairs are
frequent, so nothing of the corpus has to fit in one place. A frequent word has a number, and a phrase two integers with
two words each (0: none), so they are compared exactly.

A phrase is dropped for longer ones along two links: its own automaton's suffix link leads from a phrase to that without
the first word, and the transition that made it, backwards, to that without the last. Any longer phrase that holds
another one's words reaches it over phrases in between, which are candidates too and occur at least as often, so one
step of both links decides.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, arrow_limits, buffers, drop, lean, look_up, ragged, read, scratch, settled
from .sharding import numbered

DEPTH, LEAST, TOP = 4, 30, 2000
#: Bytes of text in a shard; a longer text makes a longer shard.
SHARD_BYTES = 16 << 20
#: A phrase goes where a longer one has so many per cent of its occurrences.
SUBSUMED = 80
SCALE = 2_000_000

MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(UPPER.encode() + MARKS, UPPER.lower().encode() + b"\n" * len(MARKS))

SHARDS = "shard long, lang string, n long, words binary, ids binary"
OUT_ROWS = 100_000


@dataclass(frozen=True)
class Automaton:
    """States of a truncated generalised suffix automaton, in the order of their reversed strings.

    reversed_words: each state's longest string backwards, -1 after its end; length, and link_length, the length of its
    suffix link's string; ends: how many positions its strings end at.
    """

    reversed_words: np.ndarray
    length: np.ndarray
    link_length: np.ndarray
    ends: np.ndarray

    def substrings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """All different strings of k words, as rows of word numbers, and how often each occurs."""
        held = (self.link_length < k) & (k <= self.length)
        return self.reversed_words[held, :k][:, ::-1], self.ends[held]


def automaton(ids: np.ndarray, depth: int = DEPTH) -> Automaton:
    """The automaton of runs of word numbers (0 and more) that are set apart by -1."""
    places = np.flatnonzero(ids >= 0)
    before = [ids[places].astype(np.int64)]
    for d in range(1, depth):
        at = places - d
        before.append(np.where((at >= 0) & (before[-1] >= 0), ids[np.maximum(at, 0)], -1).astype(np.int64))
    keys = [(before[k] + 1) << 32 | (before[k + 1] + 1 if k + 1 < depth else 0) for k in range(0, depth, 2)]
    order = np.lexsort(keys[::-1])
    before = [b[order] for b in before]
    n = len(order)
    new = np.zeros(n, bool)
    new[:1] = True
    runs = []  # of each length: the first place and the number of places of each string
    for column in before:
        new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        held = column[starts] >= 0
        runs.append((starts[held], np.diff(np.append(starts, n))[held]))
    states, least = [], np.ones(len(runs[0][0]), np.int8)  # least: the shortest string of the class
    for k, (starts, sizes) in enumerate(runs, 1):
        if k < depth:
            longer, longer_sizes = runs[k]
            at = np.minimum(np.searchsorted(longer, starts), max(len(longer) - 1, 0))
            same = (longer[at] == starts) & (longer_sizes[at] == sizes) if len(longer) else np.zeros(len(starts), bool)
            parent = np.searchsorted(starts, longer, "right") - 1
            after = np.where(same[parent], least[parent], k + 1).astype(np.int8)
        else:
            same, after = np.zeros(len(starts), bool), least
        states.append((starts[~same], np.full(int((~same).sum()), k, np.int8), least[~same] - 1, sizes[~same]))
        least = after
    start, length, link, ends = (np.concatenate(x) for x in zip(*states, strict=True))
    order = np.lexsort((length, start))
    start, length = start[order], length[order]
    words = np.stack([np.where(length > k, b[start], -1) for k, b in enumerate(before)], 1)
    return Automaton(words, length, link[order], ends[order])


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row (SHARDS) per shard and language of docs (row_key, lang, text): its different words, one on a line, and the
    numbers of its words in order, -1 between pieces. A shard is named by the first row_key of its language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, dict[bytes, int], array]] = {}
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            for lang, (key, known, ids) in held.items():
                ids = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)
                row = [key], [lang], [int((ids >= 0).sum())], [b"\n".join(known)], [pack(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "lang", "n", "words", "ids"])

        for batch in batches:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            for a, b, lang, key in zip(off, off[1:], batch.column("lang").to_pylist(), batch.column("row_key").to_pylist(), strict=False):
                if lang not in held:
                    held[lang] = key, defaultdict(count().__next__), array("i")
                _, known, ids = held[lang]
                for piece in raw[a:b].translate(TABLE).split(b"\n"):
                    words = piece.split()
                    if words:
                        ids.extend(map(known.__getitem__, words))
                        ids.append(-1)
                size += b - a
                if size >= shard_bytes:
                    yield from close()
                    held, size = {}, 0
        yield from close()

    return docs.select("row_key", "lang", "text").mapInArrow(lean(work), SHARDS)


def chunks(columns: dict[str, np.ndarray | pa.Array], constants: dict) -> Iterator[pa.RecordBatch]:
    """Arrow batches of columns of one length, and of constants."""
    n = len(next(iter(columns.values())))
    for k in range(0, n, OUT_ROWS):
        part = {c: v[k : k + OUT_ROWS] for c, v in columns.items()}
        m = min(OUT_ROWS, n - k)
        arrays = [pa.array([v] * m) if isinstance(v, str) else pa.array(np.full(m, v)) for v in constants.values()]
        yield pa.RecordBatch.from_arrays(arrays + [v if isinstance(v, pa.Array) else pa.array(v) for v in part.values()], [*constants, *part])


def shard_words(cut: DataFrame) -> DataFrame:
    """shard, lang, place, word and n of each shard's different words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["ids"])
                words = pa.array(row["words"].decode().split("\n") if row["words"] else [], pa.string())
                n = np.bincount(ids[ids >= 0], minlength=len(words))
                yield from chunks({"place": np.arange(len(words), dtype=np.int32), "word": words, "n": n.astype(np.int64)}, {"shard": row["shard"], "lang": row["lang"]})

    return cut.select("shard", "lang", "words", "ids").mapInArrow(lean(work), "shard long, lang string, place int, word string, n long")


def kept_runs(ids: np.ndarray, least: int) -> np.ndarray:
    """Runs of at least so many numbers, each with -1 after it."""
    inside = np.concatenate([[False], ids >= 0, [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    long = end - start >= least
    lengths = (end - start)[long]
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int32)
    out[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = ragged(ids, start[long], lengths)
    return out


def renumbered(cut: DataFrame, known: DataFrame) -> DataFrame:
    """shard, lang and ids with the corpus's numbers of frequent words; others end a run. known: shard, place, number."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("ids", pa.binary())])

    def work(shard: pa.Table, words: pa.Table) -> pa.Table:
        rows = shard.to_pylist()
        out = []
        for row in rows:
            ids = unpack(row["ids"])
            number = np.full(int(ids.max(initial=-1)) + 2, -1, np.int32)  # the last one is that of -1
            number[words["place"].to_numpy()] = words["number"].to_numpy()
            out.append({"shard": row["shard"], "lang": row["lang"], "ids": pack(kept_runs(number[ids], 2))})
        return pa.Table.from_pylist(out, schema)

    return cut.select("shard", "lang", "ids").groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(work, "shard long, lang string, ids binary")


def shard_pairs(cut: DataFrame) -> DataFrame:
    """shard, lang, pair and n of each shard's different pairs of words that follow one another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, n = automaton(unpack(row["ids"]), 2).substrings(2)
                yield from chunks({"pair": (words[:, 0] + 1) << 32 | (words[:, 1] + 1), "n": n}, {"shard": row["shard"], "lang": row["lang"]})

    return cut.mapInArrow(lean(work), "shard long, lang string, pair long, n long")


def cut_at(ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Runs in which all pairs are among those given (sorted), of 3 words or more."""
    pair = (ids[:-1].astype(np.int64) + 1) << 32 | (ids[1:].astype(np.int64) + 1)
    at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
    good = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
    apart = np.concatenate([[0], np.cumsum(~good)])
    out = np.full(len(ids) + int(apart[-1]), -1, np.int32)
    out[np.arange(len(ids)) + apart] = ids
    return kept_runs(out, 3)


def shard_phrases(cut: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, k1, k2 and n of each shard's phrases of 3 to DEPTH words without a rare pair. pairs: shard, pair."""
    schema = pa.schema([("lang", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64())])

    def work(shard: pa.Table, frequent: pa.Table) -> pa.Table:
        tables = [schema.empty_table()]
        for row in shard.to_pylist():
            ids = unpack(row["ids"])
            states = automaton(cut_at(ids, np.sort(frequent["pair"].to_numpy())) if len(ids) else ids)
            for k in range(3, DEPTH + 1):
                words, n = states.substrings(k)
                words = np.pad(words + 1, ((0, 0), (0, DEPTH - k)))
                tables.append(pa.table({"lang": pa.array([row["lang"]] * len(n), pa.string()), "k1": words[:, 0] << 32 | words[:, 1], "k2": words[:, 2] << 32 | words[:, 3], "n": n}, schema))
        return pa.concat_tables(tables).combine_chunks()

    return cut.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInArrow(work, "lang string, k1 long, k2 long, n long")


def high(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def low(c: Column) -> Column:
    return c.bitwiseAND(0xFFFFFFFF)


def first(c: Column) -> Column:
    """The first of two words, alone."""
    return c.bitwiseAND(F.lit(-1 << 32))


def key(k1: Column, k2: Column | None = None) -> Column:
    return F.struct(k1.alias("k1"), (F.lit(0).cast("long") if k2 is None else k2).alias("k2"))


def without_first(k1: Column, k2: Column) -> Column:
    """Where the suffix link leads: the phrase without its first word."""
    return key(F.shiftleft(low(k1), 32) + high(k2), F.shiftleft(low(k2), 32))


def without_last(k1: Column, k2: Column) -> Column:
    """The phrase of 3 or 4 words without its last word."""
    return F.when(low(k2) > 0, key(k1, first(k2))).otherwise(key(k1))


def frequent_phrases(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of 1 to DEPTH words with least occurrences or more: (lang, k1, k2, a); the frequent words (number,
    word); and n, the number of all words, of each lang. docs: row_key, lang, text."""
    cut = scratch(shards(docs, shard_bytes), "shards")
    totals = scratch(cut.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    # a word, or a pair, has one row per shard: windows need no salt, and tell each shard what is frequent
    every = F.sum("n").over(Window.partitionBy("word", "lang"))
    words = scratch(shard_words(cut).withColumn("a", every).where(F.col("a") >= least).drop("n"), "words")
    named = words.groupBy("word", "lang").agg(F.first("a").alias("a")).withColumn("rare", -F.col("a"))
    named = scratch(numbered(named, ["rare", "word", "lang"], "number").select("word", "lang", "a", fits(F.col("number")).alias("number")), "numbers")
    known = words.join(named.select("word", "lang", "number"), ["word", "lang"]).select("shard", "place", "number")
    pruned = scratch(renumbered(cut, known), "renumbered")
    drop(cut, words)
    every = F.sum("n").over(Window.partitionBy("pair"))
    pairs = scratch(shard_pairs(pruned).withColumn("a", every).where(F.col("a") >= least).drop("n"), "pairs")
    longer = shard_phrases(pruned, pairs.select("shard", "pair")).groupBy("lang", "k1", "k2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    none = F.lit(0).cast("long").alias("k2")
    ones = named.select("lang", F.shiftleft(F.col("number") + 1, 32).alias("k1"), none, "a")
    twos = pairs.groupBy("pair").agg(F.first("lang").alias("lang"), F.first("a").alias("a")).select("lang", F.col("pair").alias("k1"), none, "a")
    phrases = scratch(ones.unionByName(twos).unionByName(longer), "phrases")
    drop(pruned, pairs)
    return phrases, named.select("number", "word"), totals


def fits(number: Column) -> Column:
    return F.when(number < (1 << 31) - 2, number).otherwise(F.raise_error(F.lit("more than 2^31 frequent words")).cast("long"))


def unsubsumed(phrases: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """The phrases of 2 words or more of which no longer one has share per cent of the occurrences."""
    k1, k2, wide = F.col("k1"), F.col("k2"), "decimal(25,0)"
    links = phrases.where("k2 > 0").select(F.explode(F.array(without_first(k1, k2), without_last(k1, k2))).alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    found = phrases.where(low(k1) > 0).withColumn("key", key(k1, k2)).join(links, "key", "left")
    return found.where(F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("a").cast(wide) * share)).drop("longer")


def scored(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """Candidates (lang, k1, k2, key, a) with l, r and score of their lowest-scoring cut."""
    k1, k2 = F.col("k1"), F.col("k2")
    pieces = [
        F.struct(F.lit(1).alias("cut"), key(first(k1)).alias("l_key"), without_first(k1, k2).alias("r_key")),
        F.when(k2 > 0, F.struct(F.lit(2).alias("cut"), key(k1).alias("l_key"), key(k2).alias("r_key"))),
        F.when(low(k2) > 0, F.struct(F.lit(3).alias("cut"), key(k1, first(k2)).alias("l_key"), key(F.shiftleft(low(k2), 32)).alias("r_key"))),
    ]
    rows = candidates.select("*", F.explode(F.array_compact(F.array(*pieces))).alias("c")).select("lang", "key", "a", "c.*")
    counts = phrases.select(key(k1, k2).alias("of"), F.col("a").alias("f"))
    # a word may begin or end any share of the phrases
    for side in ("l", "r"):
        rows = look_up(scratch(rows, f"{side}-parts"), counts.select(F.col("of").alias(f"{side}_key"), F.col("f").alias(side)), f"{side}_key").drop(f"{side}_key")
    rows = rows.withColumn("score", F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("c")
    return rows.groupBy("lang", "key", "a").agg(lowest).select("lang", "key", "a", "c.l", "c.r", "c.score")


def with_phrases(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with key, and the phrase that it stands for. words: number, word."""
    k1, k2 = F.col("key.k1"), F.col("key.k2")
    numbers = F.filter(F.array(high(k1), low(k1), high(k2), low(k2)), lambda x: x > 0)
    spread = rows.select("key", F.posexplode(numbers).alias("pos", "number")).withColumn("number", F.col("number") - 1)
    found = look_up(scratch(spread, "positions"), words, "number")
    texts = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")).select("key", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    return rows.join(texts, "key")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the top phrases of each lang.

    Null texts are empty, null langs count as `und`. All rows count, whatever ids or rows repeat. An empty table, and a
    lang without a phrase of least occurrences, give no rows; other columns play no part. Ties of score and a are settled
    by the phrases' UTF-8 bytes.
    """
    arrow_limits(docs.sparkSession)
    rows = settled(docs).select(F.monotonically_increasing_id().alias("row_key"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    phrases, words, totals = frequent_phrases(rows, least, shard_bytes)
    every = scored(unsubsumed(phrases), phrases)
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scratch(every.withColumn("place", F.rank().over(place)).where(F.col("place") <= top).drop("place"), "best")
    named = with_phrases(best, words)
    named = named.withColumn("rank", F.row_number().over(place.orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))).where(F.col("rank") <= top)
    return named.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH pieces AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\n\x0b\x0c\r]')) AS p FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED ({" UNION ALL ".join(f"SELECT lang, {k} AS k, phrase, count(*) AS a FROM (SELECT lang, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) AS phrase FROM pieces) GROUP BY ALL HAVING count(*) >= {LEAST}" for k in range(1, DEPTH + 1))}),
cand AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
longer AS (SELECT lang, part, max(a) AS la FROM ({" UNION ALL ".join(f"SELECT lang, a, array_to_string(w[{i}:{i + m - 1}], ' ') AS part FROM cand WHERE k = {k}" for k in range(3, DEPTH + 1) for m in range(2, k) for i in range(1, k - m + 2))}) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer x ON c.lang = x.lang AND c.phrase = x.part WHERE x.la IS NULL OR 100 * x.la < {SUBSUMED} * c.a),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
scored AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts) WHERE o = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
