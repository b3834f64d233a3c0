"""Votes of nearest neighbours against a plain search, with the training table in one row and in blocks."""

from collections import Counter

import numpy as np
import pytest

from pulsegrid.operators import joins


@pytest.mark.parametrize("precision", [None, [[2.0, 0.5, 0.0], [0.5, 1.0, 0.0], [0.0, 0.0, 3.0]]])
@pytest.mark.parametrize(("broadcast", "block"), [(10_000, 5_000), (100, 60), (100, 5_000), (100, 3)])
def test_votes_in_blocks(spark, monkeypatch, precision, broadcast, block):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(joins, "BLOCK_ROWS", block, raising=False)
    r = np.random.default_rng(5)
    x = r.integers(0, 4, (203, 3)).astype(float)  # many equal distances
    label = [int(i) for i in r.integers(0, 3, len(x))]
    rows = [(i, v.tolist(), label[i]) for i, v in enumerate(x)]
    training = spark.createDataFrame([*rows, (1000, None, 1)], "id long, v array<double>, label long")
    asked = spark.createDataFrame([*((i, v) for i, v, _ in rows[::7]), (2000, None)], "q long, v array<double>")
    expected, p = Counter(), np.eye(3) if precision is None else np.array(precision)
    for i, v, _ in rows[::7]:
        d = x - np.array(v)
        for j in np.lexsort((np.arange(len(x)), np.einsum("ij,jk,ik->i", d, p, d)))[:5]:
            expected[i, label[j]] += 1
    out = joins.knn_vote(asked, training, "q", "v", "id", "label", 5, precision).collect()
    assert {(r.q, r.label): round(r.share * 5) for r in out} == dict(expected)
    assert max(expected.values()) > 1
    none = joins.knn_vote(asked.filter("false"), training, "q", "v", "id", "label", 5, precision)
    assert none.count() == 0 and none.columns == ["q", "label", "share"]
