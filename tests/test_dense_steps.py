"""The dense search's work: a block's scores are compared with what is kept, and no search runs twice."""

import numpy as np
import pytest

from siftwell.operators import dense
from siftwell.plans import catalog


@pytest.mark.parametrize("k", [1, 4, 30])
def test_what_is_kept_by_brute_force(k):
    rng = np.random.default_rng(k)
    blocks = [(rng.integers(-3, 4, (9, n)) / 7 + rng.choice([0, 4e-9, 1e-6], (9, n)), rng.permutation(1000)[:n] + 1000 * i) for i, n in enumerate((5, 40, 1, 200, 17))]
    scores, found = dense.nearest(blocks[0][0], np.broadcast_to(blocks[0][1], blocks[0][0].shape), k)
    for new, ids in blocks[1:]:
        scores, found = dense.kept_with(scores, found, new, ids, k)
    every, names = np.concatenate([b[0] for b in blocks], 1), np.concatenate([b[1] for b in blocks])
    for i in range(9):
        order = np.lexsort((names, -np.round(every[i], 8)))[:k]
        assert found[i].tolist() == names[order].tolist() and scores[i].tolist() == every[i][order].tolist()


def test_two_searches_for_feedback(spark, monkeypatch):
    """The first search was planned, and run, twice."""
    calls, search = [], dense.dense_top_k
    monkeypatch.setattr(dense, "dense_top_k", lambda *a: calls.append(a) or search(*a))
    out = catalog.refit_results(spark, "/root/testdata/sf0.001")
    assert len(calls) == 2 and out.count() == 25 * 30
