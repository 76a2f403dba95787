"""Operator 4: toxicity by a factorization machine over hashed terms.

The terms of a text are its words and the words' beginnings, hashed into buckets; only their presence counts. The
machine adds a weight for each term and, for each pair of terms, the product of their factors: so an insult can weigh
more beside the mention of a group than alone. It is fitted on a bounded sample of labelled rows; the buckets that tell
the classes apart best in the sample are its inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, clean_up, crc_mod, lean, read, scratch, trim, with_key

#: Labelled rows that the machine is fitted on, at most; buckets of hashed terms; buckets that it uses; factors.
SAMPLE_ROWS, BUCKETS, USED, FACTORS = 20_000, 1 << 20, 4096, 8
THRESHOLD = 0.7

WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)


class Terms(dict):
    """Buckets of a word and its beginnings; what was seen is kept, up to a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        names = [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]
        out = self[word] = tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)
        return out


def buckets_of(text: str, terms: Terms) -> np.ndarray:
    found: set[int] = set()
    for w in set(WORD.findall(text.lower())):
        found.update(terms[w])
    return np.array(sorted(found), np.int32)


class Machine:
    """bias + sum of weights + half of (square of summed factors - sum of squared factors), through a sigmoid."""

    def __init__(self, used: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, buckets: np.ndarray) -> float:
        at = self.place[buckets]
        at = at[at >= 0]
        v = self.factors[at]
        s = v.sum(0)
        z = self.bias + self.weights[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(inputs: list[np.ndarray], labels: np.ndarray, used: np.ndarray, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """By Adam over mini-batches on the log loss; inputs holds each row's places in used, the machine's buckets.

    Without both classes the score is the labels' share, or 0 if none.
    """
    labels = labels.astype(np.float64)
    positive = labels.sum()
    negative = len(labels) - positive
    if not 0 < positive < len(labels):
        share = float(labels.mean()) if len(labels) else 0.0
        return Machine(np.zeros(0, np.int64), 30.0 if share == 1 else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    state = {"b": np.array([np.log(positive / negative)]), "w": np.zeros(len(used)), "v": rng.normal(0, 0.01, (len(used), FACTORS))}
    first, second = ({k: np.zeros_like(x) for k, x in state.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(inputs))
        for lo in range(0, len(order), 256):
            pick = order[lo : lo + 256]
            x = np.zeros((len(pick), len(used)), np.float32)
            for i, k in enumerate(pick):
                x[i, inputs[k]] = 1
            s = x @ state["v"]
            out = state["b"] + x @ state["w"] + 0.5 * ((s * s).sum(1) - x @ (state["v"] ** 2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[pick]) / len(pick)
            ex = x.T @ error
            grads = {"b": np.array([error.sum()]), "w": ex + decay * state["w"], "v": x.T @ (error[:, None] * s) - ex[:, None] * state["v"] + decay * state["v"]}
            t += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                state[k] = state[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(used, float(state["b"][0]), state["w"], state["v"])


def train(docs: DataFrame, labels: DataFrame, allowed=None, rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most rows labelled documents: those with the least hash of doc_id.

    allowed is a condition on doc_id. Rows with a null doc_id or label teach nothing; of labels that repeat a doc_id the
    largest holds, of documents that do, one row.
    """
    arrow_limits(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Terms()
        for batch in batches:
            found = [buckets_of(t, seen).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "buckets"])

    picked = with_key(docs).join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    found = picked.mapInArrow(lean(terms), "doc_id long, toxic int, buckets binary").groupBy("doc_id").agg(F.max(F.struct("toxic", "buckets")).alias("x"))
    sample = scratch(found.select("doc_id", "x.*"), "toxicity-sample")
    used = telling_buckets(sample)
    sent = docs.sparkSession.sparkContext.broadcast(used)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = sent.value
        for batch in batches:
            each = [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column("buckets")]
            own = [np.searchsorted(used, r[np.isin(r, used, assume_unique=True)]).astype(np.int16).tobytes() for r in each]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.binary())], ["doc_id", "toxic", "places"])

    clean_up(docs.sparkSession)
    got = sample.mapInArrow(lean(places), "doc_id long, toxic int, places binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    own, toxic = got.column("places").combine_chunks(), got.column("toxic").to_numpy()[order]
    del got
    machine = fit([np.frombuffer(own[k].as_buffer(), np.int16) for k in order.tolist()], toxic, used)  # views, no copies
    del own
    trim()
    return machine


def telling_buckets(sample: DataFrame, most: int = USED) -> np.ndarray:
    """The buckets, sorted, that tell the classes of sample (toxic, buckets) apart best: those whose log odds ratio is
    more than twice its standard error, most of them at most, the least buckets of equal ones.

    They are counted and chosen where the rows are, so that the driver gets no more than most numbers.
    """
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("positive")).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for label, b in zip(batch.column("toxic").to_pylist(), batch.column("buckets"), strict=True):
                seen[int(label != 0), np.frombuffer(b.as_buffer(), np.int32)] += 1  # a row has no bucket twice
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(n[at].astype(np.int64)) for n in seen)], ["bucket", "n0", "n1"])

    counts = sample.select("toxic", "buckets").mapInArrow(lean(count), "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = F.col("n0") + 0.5, F.col("n1") + 0.5
    odds = F.log(n1 / (total.positive - F.col("n1") + 0.5)) - F.log(n0 / (total.n - total.positive - F.col("n0") + 0.5))
    z = F.abs(odds) / F.sqrt(1 / n1 + 1 / n0)
    return np.sort(counts.select("bucket", z.alias("z")).where("z > 2").orderBy(F.desc("z"), "bucket").limit(most).select("bucket").toArrow().column("bucket").to_numpy())


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """row_key, doc_id and score (0 to 1) of every whole text; null is an empty text, which has the bias for its score.

    Every row has a score, whatever ids or rows repeat; an empty table gives no row, other columns may have any names. A
    text of any length is scored by the set of its words' buckets.
    """
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = Terms(), sent.value
        for batch in batches:
            scores = [machine.score(buckets_of(t, terms)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(scores, pa.float64())], ["row_key", "doc_id", "score"])

    return with_key(docs).mapInArrow(lean(score), "row_key long, doc_id long, score double")


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is less than threshold; a row stays or goes by its own text alone.

    Null and empty texts, repeated rows, empty tables and other columns are as in toxicity().
    """
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = Terms(), sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([machine.score(buckets_of(t or "", terms)) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(lean(clean), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = train(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    out = toxicity(docs, machine)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
