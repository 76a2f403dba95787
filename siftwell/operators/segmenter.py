"""Words of unspaced scripts: a lexicon learnt from the corpus in Spark, and the most probable path through a word graph.

A string of signs counts as a word where it is frequent, holds together (its count is high against that of any two parts,
were they independent) and stands freely (what comes before and after it varies, measured as entropy). The lexicon is
a trie; a run of signs spans a graph of the lexicon's words that begin at each place, and the path with the greatest sum
of log probabilities, found from the end by dynamic programming, gives its words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import HAN, normalize_text
from ..shipping import ship_package

LONGEST, LEAST_COUNT, LEAST_COHESION, LEAST_ENTROPY = 4, 5, 2.0, 1.0
#: Words of a lexicon, which every task holds: the most frequent ones.
MOST_WORDS = 500_000
HAN_RUN = f"{HAN}+"
EDGE = ""

# How text is cut beside Han words. Older profile: words, numbers with a fraction or a per cent sign, signs.
OTHER_OLDER = r"[a-zA-Z0-9]+(?:\.[0-9]+)?%?|[^\s]"
OTHER = r"[a-z0-9]+|[^\W_]"


def learn(docs: DataFrame, text: str = "text", run: str = HAN_RUN, longest: int = LONGEST, least_count: int = LEAST_COUNT, least_cohesion: float = LEAST_COHESION, least_entropy: float = LEAST_ENTROPY) -> DataFrame:
    """word, n, cohesion and entropy of the words of docs, single signs among them (with null cohesion and entropy).

    run: the pattern whose matches are cut. cohesion: the least log of how much more often the word occurs than two
    parts side by side would by chance. entropy: the lesser one of those of its neighbours before and after; each end of a
    run counts as a neighbour of its own. Null texts have no runs; no runs give an empty lexicon.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(run), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("times"))
    size = F.length("run")
    spans = runs.select("run", "times", F.explode(F.sequence(F.lit(1), size)).alias("at")).select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at") + 1))).alias("k"))
    sign = lambda at: F.when((at < 1) | (at > size), F.lit(EDGE)).otherwise(F.substring("run", at, F.lit(1)))
    grams = spans.select(F.substring("run", F.col("at"), F.col("k")).alias("word"), "times", sign(F.col("at") - 1).alias("before"), sign(F.col("at") + F.col("k")).alias("after"))
    counts = grams.groupBy("word").agg(F.sum("times").alias("n")).where(F.col("n") >= F.when(F.length("word") > 1, least_count).otherwise(1))

    def branching(side: str) -> DataFrame:
        """Entropy of the signs beside each string, each edge being a different one."""
        each = grams.where(F.length("word") > 1).groupBy("word", side).agg(F.sum("times").alias("m"))
        spread = F.when(F.col(side) == EDGE, 0.0).otherwise(F.col("m") * F.log("m"))
        return each.groupBy("word").agg((F.log(F.sum("m")) - F.sum(spread) / F.sum("m")).alias(f"{side}_entropy"))

    total = counts.where(F.length("word") == 1).agg(F.sum("n").alias("total"))
    long = counts.where(F.length("word") > 1)
    cuts = long.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("cut")).select("word", "n", F.substring("word", F.lit(1), F.col("cut")).alias("left"), F.substring("word", F.col("cut") + 1, F.lit(longest)).alias("right"))
    part = lambda side: counts.select(F.col("word").alias(side), F.col("n").alias(f"{side}_n"))
    held = cuts.join(part("left"), "left").join(part("right"), "right").crossJoin(F.broadcast(total))
    cohesion = held.groupBy("word").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("left_n") * F.col("right_n")))).alias("cohesion"))
    found = long.join(cohesion, "word").where(F.round("cohesion", 9) >= least_cohesion).join(branching("before"), "word").join(branching("after"), "word")
    found = found.select("word", "n", "cohesion", F.least("before_entropy", "after_entropy").alias("entropy")).where(F.round("entropy", 9) >= least_entropy)
    none = F.lit(None).cast("double")
    return counts.where(F.length("word") == 1).select("word", "n", none.alias("cohesion"), none.alias("entropy")).unionByName(found)


@dataclass
class Segmenter:
    """Cuts runs by a lexicon of counted words; picklable, so tasks can hold it."""

    counts: dict[str, int]
    trie: dict = field(init=False, repr=False)

    def __post_init__(self):
        self.total = max(sum(self.counts.values()), 1)
        self.trie = {}
        for word, n in self.counts.items():
            node = self.trie
            for sign in word:
                node = node.setdefault(sign, {})
            node[EDGE] = math.log(n / self.total)
        self.unknown = -math.log(self.total) - 1.0  # less than a word that occurs once

    def words_at(self, run: str, at: int) -> Iterator[tuple[int, float]]:
        """Ends and log probabilities of the words that begin at a place; its single sign is always one."""
        node, end = self.trie.get(run[at]), at + 1
        yield end, self.unknown if node is None else node.get(EDGE, self.unknown)
        while node is not None and end < len(run):
            node, end = node.get(run[end]), end + 1
            if node is not None and EDGE in node:
                yield end, node[EDGE]

    def path(self, run: str) -> tuple[float, list[str]]:
        """The most probable words of a run; of equal paths the one with the longer first word."""
        best = [(0.0, 0)] * (len(run) + 1)
        for at in range(len(run) - 1, -1, -1):
            best[at] = max((p + best[end][0], end) for end, p in self.words_at(run, at))
        words, at = [], 0
        while at < len(run):
            end = best[at][1]
            words.append(run[at:end])
            at = end
        return best[0][0], words

    def cut(self, text: str) -> list[str]:
        """Words of Han runs, other words and numbers, and all other signs singly; no white space."""
        return [w for m in re.finditer(f"({HAN_PYTHON}+)|{OTHER_OLDER}", text) for w in (self.path(m[1])[1] if m[1] else [m[0]])]

    def terms(self, text: str) -> list[str]:
        """Retrieval terms: lower case, each Han word as its pairs of signs and its signs."""
        out = []
        for m in re.finditer(f"({HAN_PYTHON}+)|{OTHER}", text.lower()):
            for w in self.path(m[1])[1] if m[1] else [m[0]]:
                out += [w] if len(w) == 1 or not m[1] else [*(w[i : i + 2] for i in range(len(w) - 1)), *w]
        return out


HAN_PYTHON = "[一-鿿]"


def segmenter(lexicon: DataFrame, most: int = MOST_WORDS) -> Segmenter:
    """A Segmenter of the lexicon's words, the most frequent ones if there are more than `most`."""
    rows = lexicon.orderBy(F.desc("n"), "word").limit(most).select("word", "n").collect()
    return Segmenter({r.word: r.n for r in rows})


def _column(spark, cut):
    ship_package(spark)

    @F.pandas_udf(ArrayType(StringType()))
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return words


def with_terms(df: DataFrame, cutter: Segmenter, text: str = "text", out: str = "tokens") -> DataFrame:
    """Retrieval terms of the normalised text, as tokens() but with pairs within words only; null texts have none."""
    return df.withColumn(out, _column(df.sparkSession, cutter.terms)(normalize_text(F.coalesce(F.col(text), F.lit("")))))


def with_words(df: DataFrame, cutter: Segmenter, text: str = "text", out: str = "tokens") -> DataFrame:
    """The older profile: words as they stand, signs among them."""
    return df.withColumn(out, _column(df.sparkSession, cutter.cut)(normalize_text(F.coalesce(F.col(text), F.lit("")))))


