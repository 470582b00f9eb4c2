"""Histograms and closure against numpy.histogram."""

import numpy as np
import pytest

from halosift.operators import histograms


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 700
    label = rng.integers(1, 4, n)
    a = np.round(rng.exponential(2.0, n), 1)  # many values on bin edges
    b = np.where(label == 2, 4.0, rng.normal(size=n))  # single-valued in class 2
    c = np.where(rng.random(n) < 0.2, np.nan, rng.random(n))
    p = rng.dirichlet([1, 1, 1], n)
    p[:, 2] = np.where(a > 6, 0.0, p[:, 2])
    rows = [
        (int(label[i]), float(a[i]), float(b[i]), float(c[i]), [float(v) for v in p[i]]) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "label int, a double, `b+` double, c double, p array<double>")
    return df, label, {"a": a, "b+": b, "c": c}, p


FEATURES, LABELS = ["a", "b+", "c"], [1, 2, 3]


def test_counts_and_edges_match_numpy(table):
    df, label, columns, _ = table
    got = {(r["feature"], r["label"], r["bin"]): r for r in histograms.class_histograms(df, FEATURES, LABELS).collect()}
    assert len(got) == 3 * 3 * 50
    for f in FEATURES:
        for y in LABELS:
            values = columns[f][label == y]
            values = values[~np.isnan(values)]
            n, edges = np.histogram(values, bins=50)
            assert [got[f, y, k]["n"] for k in range(50)] == n.tolist()
            assert np.allclose([got[f, y, k]["lo"] for k in range(50)], edges[:-1])
            assert got[f, y, 49]["hi"] == edges[-1]
            assert n.sum() == len(values)


def test_value_at_the_top_edge_is_in_the_last_bin(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (0, 1, 10)], "label int, a double")
    got = {r["bin"]: r["n"] for r in histograms.class_histograms(df, ["a"], [1]).collect()}
    assert got[0] == 1 and got[5] == 1 and got[49] == 1


def test_closure_matches_numpy(table):
    df, label, columns, p = table
    got = {(r["feature"], r["label"], r["bin"]): r for r in histograms.closure(df, FEATURES, LABELS).collect()}
    for f in FEATURES:
        known = ~np.isnan(columns[f])
        for k, y in enumerate(LABELS):
            true, edges = np.histogram(columns[f][(label == y) & known], bins=50)
            pred, _ = np.histogram(columns[f][known], bins=edges, weights=p[known, k])
            empty = (true == 0) | (pred == 0)
            ratio = np.where(empty, -1, pred / np.maximum(true, 1))
            rows = [got[f, y, b] for b in range(50)]
            assert [r["true"] for r in rows] == true.tolist()
            assert np.allclose([r["pred"] for r in rows], pred)
            assert np.allclose([r["ratio"] for r in rows], ratio)
            assert rows[0]["ymax"] == pytest.approx((true / np.where(empty, 1, pred)).max())
