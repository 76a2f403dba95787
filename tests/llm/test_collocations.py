"""Collocations against plain counting; the automaton against the well-known construction sign by sign."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import collocations

LOWER = str.maketrans(collocations.UPPER, collocations.UPPER.lower())


def brute_force(rows, top, least):
    counts, total = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            inside = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(1, lang, text, 0, "x", 3) for lang, text in rows], "doc_id long, lang string, text string, row_key int, word string, a int")


def made_up(seed=3, n=160):
    rng = random.Random(seed)
    words = ["The", "the", "of", "naïve", "漢字", "a\x1cb", "É", "é", "x1", "zz", "q\x85", "\xa0"]
    fixed = ["New York city hall", "in spite of", "as well as", "ad hoc"]
    rows = [("en", None), (None, "stop. of the"), ("und", "of the, of\tthe\x0bof the"), ("en", ""), ("fr", " \t\n"), ("de", "lone")]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        rows.append((rng.choice(["en", "en", "fr", None]), "".join(p + rng.choice([" ", "  ", "\t", ". ", "\r\n", "!? ", ";"]) for p in parts)))
    return rows


@pytest.mark.parametrize("least,top,size", [(5, 2000, 1 << 20), (3, 7, 1), (30, 2000, 2000)])
def test_collocations(spark, least, top, size):
    rows = made_up()
    want = brute_force(rows, top, least)
    assert len(want) > 3
    got = collocations.collocations(table(spark, rows), top, least, size).collect()
    assert sorted(map(tuple, got)) == want
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_repeated_rows_ties_and_very_long_texts(spark):
    rows = [("en", "alpha beta gamma delta epsilon. " * 20_000 + "w" * 200_000)] + [("en", "tie one. tie two. " * 40)] * 3
    assert sorted(map(tuple, collocations.collocations(table(spark, rows)).collect())) == brute_force(rows, 2000, 30)


def test_nothing(spark):
    assert collocations.collocations(table(spark, [("en", "a b")]).where("a = 0")).count() == 0
    assert collocations.collocations(table(spark, [("en", "a b c")])).count() == 0


def online(runs, depth):
    """The suffix automaton of each run's windows, extended sign by sign, with endpos counts and suffix links."""
    link, length, step, ends = [-1], [0], [{}], [set()]

    def extend(last, sign, place):
        if sign in step[last]:
            q = step[last][sign]
            if length[q] == length[last] + 1:
                ends[q].add(place)
                return q
            return split(last, q, sign, place)
        link.append(0), length.append(length[last] + 1), step.append({}), ends.append({place})
        new, p = len(link) - 1, last
        while p >= 0 and sign not in step[p]:
            step[p][sign] = new
            p = link[p]
        if p >= 0:
            q = step[p][sign]
            link[new] = q if length[q] == length[p] + 1 else split(p, q, sign, None)
        return new

    def split(p, q, sign, place):
        link.append(link[q]), length.append(length[p] + 1), step.append(dict(step[q])), ends.append(set() if place is None else {place})
        new = len(link) - 1
        link[q] = new
        while p >= 0 and step[p].get(sign) == q:
            step[p][sign] = new
            p = link[p]
        return new

    place = 0
    for run in runs:
        for i in range(len(run)):  # windows of the bounded depth, so that no string is longer
            last = 0
            for j in range(max(0, i - depth + 1), i + 1):
                last = extend(last, run[j], place + j)
        place += len(run)
    for s in sorted(range(1, len(link)), key=lambda s: -length[s]):
        ends[link[s]] |= ends[s]
    return link, length, step, ends


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_automaton(depth):
    rng = random.Random(depth)
    runs = [[rng.randrange(4) for _ in range(rng.randint(0, 9))] for _ in range(25)]
    ids = np.array([x for r in runs for x in [*r, -1]], np.int32)
    ours = collocations.automaton(ids, depth)
    link, length, step, ends = online(runs, depth)
    counted = Counter(tuple(r[i : i + k]) for r in runs for k in range(1, depth + 1) for i in range(len(r) - k + 1))
    for k in range(1, depth + 1):
        words, n = ours.substrings(k)
        assert {tuple(w): c for w, c in zip(words.tolist(), n.tolist(), strict=True)} == {s: c for s, c in counted.items() if len(s) == k}
    # classes: every string's state in the other automaton has the same count, longest string and link
    classes = {tuple(w[:m][::-1]): (c, m, s) for w, c, m, s in zip(ours.reversed_words.tolist(), ours.ends.tolist(), ours.length.tolist(), ours.link_length.tolist(), strict=True)}
    seen = set()
    for string in counted:
        state = 0
        for sign in string:
            state = step[state][sign]
        seen.add(state)
        assert len(ends[state]) == counted[string]
    same = {}
    for s in seen:  # states with the same ends are one class
        same.setdefault(frozenset(ends[s]), []).append(s)
    assert len(classes) == len(same)
    assert Counter((c, m, s) for c, m, s in classes.values()) == Counter((len(e), max(length[x] for x in group), min(length[link[x]] for x in group)) for e, group in same.items())


def test_automaton_of_nothing():
    assert len(collocations.automaton(np.zeros(0, np.int32)).ends) == 0
    assert len(collocations.automaton(np.full(3, -1, np.int32)).ends) == 0
