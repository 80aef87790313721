"""Sums of the maximum-entropy model's gradient."""

import numpy as np

from tidegrid.llm import maxent


def test_rows_are_added_in_doubles(monkeypatch):
    p = np.array([[1e8, 1], [1, 2], [1, 4], [1, 8]], np.float32)
    for cells in (1, 4, 1 << 20):
        monkeypatch.setattr(maxent, "_CELLS", cells)
        to = np.zeros((3, 2))
        maxent._add_rows(to, np.array([2, 2, 2, 0]), p)
        assert to.tolist() == [[1, 8], [0, 0], [100_000_002, 7]]


def test_observed_counts_are_summed_in_the_first_round_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "c", "d"], 30))) for i in range(40)], "doc_id long, text string")
    given, gradient = [], maxent.gradient

    def seen_by(model, rows, observed=None):
        out = gradient(model, rows, observed)
        given.append((observed, out))
        return out

    monkeypatch.setattr(maxent, "gradient", seen_by)
    assert maxent.score(docs).count() == 40
    (none, one), (first, two) = given
    assert none is None and all(a is b for a, b in zip(first, one[::2]))
    assert all(np.array_equal(a, b) for a, b in zip(one[::2], two[::2]))
    assert np.allclose(two[1].sum(1), two[0].sum(1), atol=1e-2)  # expected classes of a feature sum to its rows
