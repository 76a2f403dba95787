"""The learnt lexicon against plain counting, paths against all paths, keywords by a segmenter, case folding."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import bm25, expansion, postings, segmenter

WORDS = ["頭痛", "醫師", "檢查", "高血壓", "的", "我", "治療", "門診部"]


def sentences(n=120, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choices(WORDS, k=rng.randint(1, 7))) + rng.choice(["", "。", " abc ", "，"]) + rng.choice(WORDS) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_index long, text string")


def plain_lexicon(texts, longest, least_count, least_cohesion, least_entropy):
    import re

    n, before, after = Counter(), defaultdict(Counter), defaultdict(Counter)
    edge = itertools.count()
    for run in (r for t in texts for r in re.findall("[一-鿿]+", t or "")):
        for k in range(1, longest + 1):
            for i in range(len(run) - k + 1):
                w = run[i : i + k]
                n[w] += 1
                before[w][run[i - 1] if i else next(edge)] += 1
                after[w][run[i + k] if i + k < len(run) else next(edge)] += 1
    total = sum(c for w, c in n.items() if len(w) == 1)
    entropy = lambda c: -sum(m / sum(c.values()) * math.log(m / sum(c.values())) for m in c.values())
    out = {w: (c, None, None) for w, c in n.items() if len(w) == 1}
    for w, c in n.items():
        if len(w) > 1 and c >= least_count:
            cohesion = min(math.log(c * total / (n[w[:i]] * n[w[i:]])) for i in range(1, len(w)))
            free = min(entropy(before[w]), entropy(after[w]))
            if cohesion >= least_cohesion and free >= least_entropy:
                out[w] = (c, round(cohesion, 9), round(free, 9))
    return out


@pytest.mark.parametrize("limits", [(4, 5, 1.0, 1.0), (3, 1, -9.0, 0.0), (2, 10, 0.5, 1.5)])
def test_lexicon(spark, limits):
    texts = [*sentences(), None, "", "no signs"]
    got = {r.word: (r.n, r.cohesion and round(r.cohesion, 9), r.entropy if r.entropy is None else round(r.entropy, 9)) for r in segmenter.learn(table(spark, texts), longest=limits[0], least_count=limits[1], least_cohesion=limits[2], least_entropy=limits[3]).collect()}
    want = plain_lexicon(texts, *limits)
    assert got.keys() == want.keys()
    for w, values in want.items():
        assert got[w] == pytest.approx(values, abs=1e-6)


def test_words_are_found(spark):
    cutter = segmenter.segmenter(segmenter.learn(table(spark, sentences()), least_cohesion=1.0))
    assert {"頭痛", "醫師", "高血壓"} <= cutter.counts.keys()
    assert cutter.cut("我的頭痛 MRI 3.5% 檢查，高血壓") == ["我", "的", "頭痛", "MRI", "3.5%", "檢查", "，", "高血壓"]
    assert segmenter.learn(table(spark, ["abc", None])).count() == 0
    assert segmenter.segmenter(segmenter.learn(table(spark, ["abc"]))).cut("頭痛") == ["頭", "痛"]


def test_path_is_the_best_of_all():
    rng = random.Random(7)
    signs = "甲乙丙丁"
    for _ in range(150):
        counts = {"".join(rng.choices(signs, k=rng.randint(1, 3))): rng.randint(1, 40) for _ in range(rng.randint(0, 12))}
        cutter = segmenter.Segmenter(counts)
        run = "".join(rng.choices(signs + "戊", k=rng.randint(1, 8)))
        score = lambda w: math.log(counts[w] / cutter.total) if w in counts else (cutter.unknown if len(w) == 1 else -math.inf)
        every = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
            every.append(sum(score(run[a:b]) for a, b in zip(at, at[1:], strict=False)))
        best, words = cutter.path(run)
        assert best == pytest.approx(max(every)) and sum(map(score, words)) == pytest.approx(best) and "".join(words) == run


def test_terms_of_both_profiles(spark):
    cutter = segmenter.Segmenter({"頭痛": 9, "藥": 3, "高血壓": 8, "的": 20})
    df = table(spark, ["Réaution 頭痛藥 MCV 3.14", "高血壓的", None, ""])
    terms = [r.tokens for r in segmenter.with_terms(df, cutter).orderBy("doc_index").collect()]
    assert terms == [["r", "é", "aution", "頭痛", "頭", "痛", "藥", "mcv", "3", "14"], ["高血", "血壓", "高", "血", "壓", "的"], [], []]
    words = [r.tokens for r in segmenter.with_words(df, cutter).orderBy("doc_index").collect()]
    assert words == [["R", "é", "aution", "頭痛", "藥", "MCV", "3.14"], ["高血壓", "的"], [], []]


def test_retrieval_by_words(spark, tmp_path):
    """Pairs across words match in plain tokens, and don't in those of a segmenter; the stored index agrees."""
    cutter = segmenter.Segmenter({"頭痛": 9, "醫師": 9, "高血壓": 8})
    docs = spark.createDataFrame([(0, "頭痛醫師"), (1, "痛醫"), (2, "高血壓"), (3, None)], "doc_index long, text string")
    queries = spark.createDataFrame([(1, "痛醫"), (2, "血壓")], "query_id long, text string")
    cut_docs, cut_queries = segmenter.with_terms(docs, cutter), segmenter.with_terms(queries, cutter)
    plain = bm25.build_index(docs).terms.select("term").collect()
    cut = bm25.build_index(cut_docs)
    assert ("痛醫",) in plain and ("痛醫",) not in cut.terms.select("term").collect()
    stored = postings.open_index(cut_docs, str(tmp_path))
    rows = lambda index: [(r.query_id, r.doc_index, round(r.bm25_score, 9)) for r in bm25.bm25_top_k(cut_queries, cut_docs, index, 5, pad=False).orderBy("query_id", "bm25_rank").collect()]
    assert rows(cut) == rows(stored) and [r[:2] for r in rows(cut)][:1] == [(1, 1)] and (2, 2) in [r[:2] for r in rows(cut)]
    assert postings.open_index(docs, str(tmp_path)).blocks.inputFiles() != stored.blocks.inputFiles()


def test_keywords_by_a_segmenter(spark):
    cutter = segmenter.Segmenter({w: 9 for w in ("頭痛", "醫師", "檢查", "高血壓", "治療", "門診", "神經", "建議")})
    raw = ["Keywords: MRI, 1. 高血壓門診頭痛治療的檢查建議, x", "thinking process: a, b", None, "關鍵詞：頭痛和檢查; 頭痛; MRI"]
    texts = spark.createDataFrame(list(enumerate(raw)), "text_id long, raw string")
    rows = expansion.parsed_keywords(texts, 5, cutter.cut).orderBy("text_id", "place").collect()
    assert [(r.text_id, r.place, r.keyword) for r in rows] == [(0, 1, "MRI"), (0, 2, "高血壓門診"), (0, 3, "頭痛治療"), (0, 4, "檢查"), (0, 5, "建議"), (3, 1, "頭痛檢查"), (3, 2, "頭痛"), (3, 3, "MRI")]
    again = expansion.parsed_keywords(texts.where("text_id = 3").withColumn("raw", F.lit("MRI, mri., a b, Straße, STRASSE")), 5, cutter.cut)
    assert [r.keyword for r in expansion.deduplicated(again).orderBy("place").collect()] == ["MRI", "a b", "Straße"]


def test_case_folding(spark):
    words = ["Straße.", "ΣΊΣΥΦΟΣ", "ﬁt", "İ", "ŉ", "plain", "ᏸ", "", None]
    got = [r.x for r in table(spark, words).orderBy("doc_index").select(T.casefold(F.col("text")).alias("x")).collect()]
    assert got == [w and w.casefold() for w in words]
    assert [r.x for r in table(spark, ["!Straße.", "K"]).orderBy("doc_index").select(T.canonical_keyword(F.col("text")).alias("x")).collect()] == ["strasse", "k"]


def test_prompts(spark):
    row = table(spark, ["q"]).select(T.d2k_prompt(F.col("text"), F.lit("p"), 7).alias("d"), T.sanitize_generated(F.lit("Passage: KEYWORD: 回答：x")).alias("s")).first()
    assert row.d.startswith("請根據問題與段落內容，從段落中抽取最多 7 個") and row.d.endswith("\n問題：q\n段落：p\n關鍵詞：") and row.d.count("\n") == 10
    assert row.s == "KEYWORD: 回答：x"
