"""Alignment against a walk over both token lists, with the libraries encoding whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from siftwell.llm import alignment
from siftwell.llm.common import with_key

JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["the", "unbelievable", "cat", "naïve", "漢字", "Straße", "x" * 60, "12345", "don't", "...", "\t", "\n\n", " ", "   ", "é", "é", "\U0001f600", "　", "\x00", "<s>", "<unk>", "<|endoftext|>", "</s>", "<0x41>", "ﬁ"]
ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b ", "▁", "a▁b", "b ▁ c", "\n", "a b", "the cat the cat", "the cat the cat", "x" * 3000]


def texts():
    rng = random.Random(5)
    return ODD + ["".join(w + rng.choice(["", " ", " ", "  "]) for w in rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(60)]


def libraries(text):
    """Ids and bytes of both tokenizers' tokens of a whole text."""
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(JSON), alignment.pieces_of(PIECES)
    t.encode_special_tokens = True
    e = t.encode(" " + text, add_special_tokens=False)
    signs = alignment.byte_signs()
    a = [(i, bytes(signs[c] for c in token)) for i, token in zip(e.ids, e.tokens, strict=True)]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    return a, b


def walk(text):
    """Groups and links of one text, or None."""
    if not text:
        return None
    a, b = libraries(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    spans = []
    for side in (a, b):
        at, out = 0, []
        for i, x in side:
            out.append((at, at + len(x), i))
            at += len(x)
        spans.append(out)
    links = [(i, j) for lo, hi, i in spans[0] for low, high, j in spans[1] if lo < high and low < hi]
    ends = sorted({hi for _, hi, _ in spans[0]} & {hi for _, hi, _ in spans[1]})
    groups, last = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(i) for lo, hi, i in side if lo >= last and hi <= end) for side in spans))
        last = end
    return len(a), len(b), groups, links


def brute_force(rows):
    walks = [walk(t) for t in rows]
    docs = Counter(p for w in walks if w for p in set(w[3]))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for w in walks:
        if w is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = w
        out.append((n_a, n_b, len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, docs


def table(spark, rows):
    return spark.createDataFrame([(i // 2 if i else None, t, "l", 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, slice string, place int, row_key int")


@pytest.mark.parametrize("limit", [alignment.SLICE_TEXT, 300])
def test_align(spark, monkeypatch, limit):
    rows = texts()
    want, docs = brute_force(rows)
    monkeypatch.setattr(alignment, "SLICE_TEXT", limit)
    got = alignment.align(table(spark, rows).coalesce(1), JSON, PIECES).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted((i // 2 if i else -1, *w) for i, w in enumerate(want))
    assert sum(w[0] > 0 for w in want) > 40 and sum(w[0] == 0 for w in want) > 4


def test_pair_counts(spark):
    rows = texts()[:40]
    assert {(r.a, r.b): r.n_docs for r in alignment.pair_counts(table(spark, rows), JSON, PIECES).collect()} == brute_force(rows)[1]


def test_chunks_cut_where_both_end():
    rng = np.random.default_rng(1)
    con = duckdb.connect()
    sides = []
    ends = np.array([3000, 3001, 9000])
    for seed in (3, 4):
        hi = np.union1d(rng.choice(np.arange(1, 9000), 2500 * seed // 3, replace=False), ends).astype(np.int32)
        sides.append((rng.integers(0, 50, len(hi)).astype(np.int32), np.concatenate([[0], hi[:-1]]).astype(np.int32), hi))
    whole = alignment.aligned(con, *sides, ends, 50)
    for chunk in (1, 100, 5000):
        parts = alignment.aligned(con, *sides, ends, 50, chunk)
        assert parts[1].tolist() == whole[1].tolist() and parts[2] == whole[2]
        rows = lambda x, name: sorted(zip(*(np.asarray(v).tolist() for v in x[0][name].values()), strict=True))
        assert all(rows(parts, name) == rows(whole, name) for name in whole[0])


def test_empty_table(spark):
    assert alignment.align(table(spark, ["a"]).where("place = 9"), JSON, PIECES).count() == 0


def test_long_text(spark):
    text = "the cat " * 400_000 + "z" * 100_000
    (row,) = alignment.align(table(spark, [text]), JSON, PIECES).collect()
    assert row.n_a > 800_000 and row.n_links >= max(row.n_a, row.n_b) and row.n_best > 0


def test_row_keys_are_kept(spark):
    docs = with_key(table(spark, ["a b", None]).coalesce(1))
    cut = alignment.sliced(docs, JSON, PIECES).collect()
    assert [r.row_key for r in cut] == [0, 1, None] and {r.slice for r in cut} == {0}
