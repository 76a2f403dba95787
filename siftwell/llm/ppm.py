"""Operator 8: language-model scores by prediction by partial matching (PPM) with a pretrained byte-context trie.

The trie holds every run of up to ORDER + 1 bytes of all training documents; nothing is left out of it, so it grows with
the corpus. It is a set of tables, one for each context length, that are summed and joined in Spark and never meet in
one place. In a context c with T occurrences and q different symbols, a symbol seen n times has the probability
n / (T + q), and the escape q / (T + q). After an escape the next shorter context leaves out the symbols that the longer
one has (symbol exclusion); as these are a subset of its own, each context needs only one sum over its suffix's counts.
Below order 0 the symbols left share the rest evenly. From the shortest context on, a join with the table before gives
each run's code length, whether as the first context's symbol or after escapes.

Documents are scored a slice (a partition of the scan) at a time: a slice lists its different windows of ORDER + 1
bytes, whose code lengths are joined and come back to it together with its texts. So a task holds a table of its own
slice's windows, as large as its texts at most, however large the trie is.

A text is modelled as its tokens joined by one space, A-Z lower-cased, and an end sign.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, buffers, crc_mod, lean, read, scratch, settled, with_key

ORDER = 5
#: Tokens that make up one in so many (so no more than that) are looked up in each task's memory; all others, and all
#: of more bytes, are joined.
FREQUENT, FREQUENT_BYTES = 1 << 20, 64

END, PAD = 0xFF, 0xFE  # bytes that UTF-8 never has; PAD stands before a text's first byte
SYMBOLS = 257
END_TOKEN = "\n"  # no word has white space

STEP_BYTES = 2 << 20


def runs(tokens: list[bytes]) -> bytes:
    return b" ".join(tokens)


def sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    return run_sums(keys[order], counts[order])


def run_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def windows(texts: list[bytes], order: int) -> np.ndarray:
    """For each byte of the texts and each end, that byte and the order bytes before it, as one number."""
    front = bytes([PAD]) * order
    data = np.frombuffer(b"".join(x for t in texts for x in (front, t, bytes([END]))), np.uint8)
    n = max(0, len(data) - order)
    keys = np.zeros(n, np.uint64)
    for k in range(order + 1):
        keys = (keys << np.uint64(8)) | data[k : k + n]
    return keys[data[order:] != PAD]


def slice_windows(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """slice, window and n: each slice's different windows, and how often they are in its documents to learn from.

    docs has row_key, text and learn. A slice is the part of the table that one task scans.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        parts: tuple[list[bytes], list[bytes]] = [], []
        size, number = 0, 0

        def step() -> None:
            nonlocal parts, size, held
            for learnt, texts in enumerate(parts):
                keys, n = np.unique(windows(texts, order), return_counts=True)
                held.append((keys, n.astype(np.int64) * learnt))
            if len(held) > 8:
                held = [sums(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            parts, size = ([], []), 0

        for batch in batches:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            for a, b, learn in zip(off, off[1:], batch.column("learn").to_pylist(), strict=False):
                text = runs(raw[a:b].lower().split())
                parts[bool(learn)].append(text)
                size += len(text) + order + 1
                if size > STEP_BYTES:
                    step()
            if batch.num_rows:
                number = batch.column("row_key")[0].as_py() >> 33
        step()
        keys, n = sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number, np.int32)), pa.array(part.view(np.int64)), pa.array(n[i : i + 100_000])], ["slice", "window", "n"])

    return docs.select("row_key", "text", "learn").mapInArrow(lean(count), "slice int, window long, n long")


def code_lengths(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """window and logp (log10 of the symbol's probability after its context) of each window of counted (window, n)."""
    whole = scratch(counted.groupBy("window").agg(F.sum("n").alias("n")), "windows")

    def byte(k: int):
        return F.shiftright("window", 8 * k).bitwiseAND(0xFF)

    def last(column: str, size: int):
        return F.col(column).bitwiseAND((1 << 8 * size) - 1)

    levels = {order: whole.where(byte(order) != PAD).select(F.col("window").alias("run"), "n", F.lit(False).alias("short"))}
    for k in range(order - 1, -1, -1):
        short = whole.where((byte(k) != PAD) & (byte(k + 1) == PAD)).select(last("window", k + 1).alias("run"), "n", F.lit(True).alias("short"))
        both = levels[k + 1].select(last("run", k + 1).alias("run"), "n", F.lit(False).alias("short")).unionByName(short)
        levels[k] = scratch(both.groupBy("run").agg(F.sum("n").alias("n"), F.bool_or("short").alias("short")), "runs")
    out, before = None, None
    for k in range(order + 1):
        now = levels[k]
        if before is None:
            now = now.withColumns({"p_n": F.lit(0), "p_total": F.lit(0), "p_kinds": F.lit(SYMBOLS), "p_logp": F.lit(-log10(SYMBOLS)), "p_rest": F.lit(0.0)})
        else:
            upper = before.select(F.col("run").alias("suffix"), F.col("n").alias("p_n"), F.col("total").alias("p_total"), F.col("kinds").alias("p_kinds"), F.col("logp").alias("p_logp"), F.col("rest").alias("p_rest"))
            now = now.join(upper, last("run", k) == F.col("suffix")).drop("suffix")
        of = Window.partitionBy(F.shiftright("run", 8))  # 257 rows at most
        now = now.withColumns({"total": F.sum("n").over(of), "kinds": F.count_if(F.col("n") > 0).over(of), "shut": F.sum(F.when(F.col("n") > 0, F.col("p_n")).otherwise(0)).over(of)})
        if before is None:  # below order 0: an even share of the symbols left
            rest = -F.log10(SYMBOLS - F.col("kinds"))
        else:
            left = F.col("p_kinds") - F.col("kinds")  # symbols of the suffix that aren't this context's
            everything = F.col("p_total") - F.col("shut") + left
            rest = F.when(F.col("p_n") > 0, F.log10(F.try_divide("p_n", everything))).otherwise(F.when(left > 0, F.log10(F.try_divide(left, everything))).otherwise(0.0) + F.col("p_rest"))
        now = now.withColumn("rest", F.when((F.col("n") == 0) & (F.col("total") > 0), rest))
        sum_ = F.col("total") + F.col("kinds")
        logp = F.when(F.col("total") == 0, F.col("p_logp")).when(F.col("n") > 0, F.log10(F.try_divide("n", sum_))).otherwise(F.log10(F.try_divide("kinds", sum_)) + F.col("rest"))
        before = scratch(now.withColumn("logp", logp).select("run", "n", "short", "total", "kinds", "logp", "rest"), "lengths")
        front = sum(PAD << 8 * i for i in range(k + 1, order + 1))
        mine = (before if k == order else before.where("short")).select(F.col("run").bitwiseOR(F.lit(front)).alias("window"), F.col("logp").cast("float").alias("logp"))
        out = mine if out is None else out.unionByName(mine)
    return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """token and n, over all documents; each has one end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        ends = 0

        def emit() -> pa.RecordBatch:
            nonlocal seen, ends
            if ends:
                seen[END_TOKEN.encode()] = ends
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
            seen, ends = Counter(), 0
            return out

        for batch in batches:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            for a, b in zip(off, off[1:], strict=False):
                seen.update(raw[a:b].lower().split())
                ends += 1
                if len(seen) > 400_000:
                    yield emit()
        yield emit()

    arrow_limits(docs.sparkSession)
    return docs.select("text").mapInArrow(lean(count), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


SCORED = "row_key long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<struct<token:string,n:int>>"


def lm_scores(docs: DataFrame, training, order: int = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """row_key, doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    training is a condition on the columns of texts() that picks the documents to learn from. Null is an empty text,
    which has its end token only. With nothing to learn from, all counts are 0. Rows that repeat a doc_id each count.
    A very long text is scored in one piece. An empty table gives no row. Other columns may have any names.
    """
    docs = settled(docs)
    spark = docs.sparkSession
    arrow_limits(spark)
    keyed = with_key(docs)
    learn = keyed.where(training)
    vocabulary = scratch(count_tokens(learn), "vocabulary")
    distinct, tokens = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    denominator = tokens + distinct + 1
    known = vocabulary.where((F.octet_length("token") <= FREQUENT_BYTES) & (F.col("token") != END_TOKEN) & (F.col("n") * frequent >= tokens)).collect()
    ends = vocabulary.where(F.col("token") == END_TOKEN).first()
    sent = spark.sparkContext.broadcast(({r["token"].encode(): log10((r["n"] + 1) / denominator) for r in known}, ends["n"] if ends else 0))
    counted = scratch(slice_windows(keyed.withColumn("learn", F.coalesce(F.expr(training) if isinstance(training, str) else training, F.lit(False))), order), "slice-windows")
    lengths = counted.select("slice", "window").join(code_lengths(counted.select("window", "n"), order), "window")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, end = sent.value
        end_log = log10((end + 1) / denominator)
        now, table = None, []  # the slice, and its windows and code lengths
        keys, values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

        def code(texts: list[bytes]) -> np.ndarray:
            w = windows(texts, order)
            at = np.minimum(np.searchsorted(keys, w), max(len(keys) - 1, 0))
            if not len(keys) or (keys[at] != w).any():
                raise RuntimeError("a slice's rows have changed between two jobs")
            sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
            return np.add.reduceat(values[at].astype(np.float64), np.cumsum(sizes) - sizes)

        def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            off, data = buffers(batch.column("text"))
            raw, off = data.tobytes(), off.tolist()
            rows, texts, size, done = [], [], 0, 0
            for i, (a, b) in enumerate(zip(off, off[1:], strict=False)):
                w = raw[a:b].lower().split()
                found = list(map(logs.get, w))
                rare = Counter(t for t, v in zip(w, found, strict=True) if v is None) if None in found else {}
                hits = [v for v in found if v is not None]
                rows.append((len(w) + 1, len(hits) + (end > 0), sum(hits) + end_log, [{"token": t.decode(), "n": n} for t, n in rare.items()]))
                texts.append(runs(w))
                size += len(texts[-1])
                if size > STEP_BYTES or i == len(off) - 2:
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row_key").slice(done, n), batch.column("doc_id").slice(done, n), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), pa.array(code(texts)), pa.array([r[3] for r in rows], pa.list_(pa.struct([("token", pa.string()), ("n", pa.int32())])))],
                        ["row_key", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
                    )
                    rows, texts, size, done = [], [], 0, i + 1

        for batch in batches:  # sorted by slice; a slice's windows come before its texts
            slices, texts = batch.column("slice").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(slices) != 0) | (np.diff(texts) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(slices)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if slices[a] != now:
                    now, table = slices[a], []
                if texts[a] == 0:
                    table.append((part.column("window").to_numpy().view(np.uint64), part.column("logp").to_numpy()))
                    continue
                if table:
                    keys, values = (np.concatenate(x) for x in zip(*table, strict=True))
                    order_ = np.argsort(keys)
                    keys, values, table = keys[order_], values[order_], []
                yield from scored(part)

    none = F.lit(None)
    rows = lengths.select("slice", F.lit(0).alias("kind"), "window", "logp", none.cast("long").alias("row_key"), none.cast("long").alias("doc_id"), none.cast("string").alias("text"))
    rows = rows.unionByName(keyed.select(F.shiftright("row_key", 33).cast("int").alias("slice"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("window"), F.lit(0).cast("float").alias("logp"), "row_key", "doc_id", "text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionById(tasks, F.pmod("slice", F.lit(tasks))).sortWithinPartitions("slice", "kind")
    scored = scratch(dealt.mapInArrow(lean(score), SCORED), "scored")
    rare = scored.select("row_key", F.explode("rare").alias("x")).select("row_key", F.col("x.token").alias("token"), F.col("x.n").alias("k"))
    seen = F.coalesce("n", F.lit(0))
    joined = rare.join(vocabulary, "token", "left").groupBy("row_key").agg(F.sum(F.col("k") * F.log10((seen + 1) / F.lit(float(denominator)))).alias("more_score"), F.sum(F.when(seen > 0, F.col("k")).otherwise(0)).alias("more_known"))
    out = scored.drop("rare").join(joined, "row_key", "left")
    return out.select("row_key", "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_score", F.lit(0.0))).alias("base_score"), "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(read(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
