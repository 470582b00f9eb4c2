"""ROC family against a direct computation, for any number of ranges and partitions."""

import random

import numpy as np
import pytest

from halosift.operators import metrics, roc


def direct(rows, collinear):
    """(threshold, fp, tp) from (score, positive) pairs, one sorted pass."""
    steps = {}
    for score, positive in rows:
        pos, neg = steps.get(score, (0, 0))
        steps[score] = (pos + positive, neg + (not positive))
    ordered = sorted(steps.items(), reverse=True)
    out, tp, fp = [], 0, 0
    for k, (score, (pos, neg)) in enumerate(ordered):
        tp, fp = tp + pos, fp + neg
        inner = 0 < k < len(ordered) - 1
        if collinear or not inner or ordered[k + 1][1] != (pos, neg):
            out.append((score, fp, tp))
    return [(float("inf"), 0, 0), *out]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for _ in range(800):
        # One score holds more than a third of all rows.
        score = 0.5 if rng.random() < 0.35 else rng.choice([round(rng.random(), 2), rng.random()])
        out.append((score, rng.random() < score))
    return out


@pytest.mark.parametrize("collinear", [True, False])
@pytest.mark.parametrize("ranges, parts", [(1, 1), (3, 4), (16, 16)])
def test_curve(spark, rows, ranges, parts, collinear):
    df = spark.createDataFrame(rows, "score double, positive boolean").repartition(parts)
    got = roc.roc_points(df, drop_collinear=not collinear, ranges=ranges).collect()
    p = sum(r[1] for r in rows)
    n = len(rows) - p
    want = [(t, fp / n, tp / p) for t, fp, tp in direct(rows, collinear)]
    got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in got), reverse=True)
    assert got == want
    assert got[0][1:] == (0.0, 0.0) and got[-1][1:] == (1.0, 1.0)


def test_area_is_the_rank_statistic(spark, rows):
    df = spark.createDataFrame(rows, "score double, positive boolean")
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    for ranges in (1, 7):
        assert roc.auc(df, ranges=ranges).first()["auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_absent_class_gives_null_rates(spark):
    df = spark.createDataFrame([(0.1, False), (0.2, False), (None, True)], "score double, positive boolean")
    with pytest.raises(ValueError, match="1 rows of a curve have no score"):
        roc.roc_points(df)
    rows = roc.roc_points(df, ranges=1, unscored="skip").collect()
    assert all(r["tpr"] is None for r in rows) and max(r["fpr"] for r in rows) == 1.0
    assert roc.auc(df, unscored="skip").first()["auc"] is None


def test_missing_probabilities_are_no_class_and_cost_nothing(spark):
    from halosift.functions.labels import predicted_label
    from pyspark.sql import functions as F

    rows = [(1, [0.9, 0.1]), (2, [0.2, 0.8]), (1, None), (2, [None, 0.5]), (2, [float("nan"), 0.5])]
    df = spark.createDataFrame(rows, "label int, p array<double>")
    assert [r[0] for r in df.select(predicted_label(F.col("p"), [1, 2])).collect()] == [1, 2, None, None, None]
    got = metrics.accuracy_and_loss(df, [1, 2]).first()
    assert (got["n"], got["n_scored"], got["accuracy"]) == (5, 2, 1.0)
    assert got["loss"] == pytest.approx(-(np.log(0.9) + np.log(0.8)) / 2)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        w = [rng.randint(1, 6) for _ in range(3)]
        rows.append((i, rng.choice([1, 2, 3]), [v / sum(w) for v in w]))
    return spark.createDataFrame(rows, "key int, label int, p array<double>"), rows


def test_pairs_in_both_directions(scored):
    df, rows = scored
    got = {}
    for r in roc.pair_curves(df, [1, 2, 3], drop_collinear=False, ranges=4).collect():
        got.setdefault((r["cat1"], r["cat2"], r["scored_by"]), []).append((r["threshold"], r["fpr"], r["tpr"]))
    assert set(got) == {(a, b, c) for a, b in ((1, 2), (1, 3), (2, 3)) for c in (a, b)}
    for (a, b, c), curve in got.items():
        entries = [(p[c - 1], y == c) for _, y, p in rows if y in (a, b)]
        pos = sum(e[1] for e in entries)
        want = [(t, fp / (len(entries) - pos), tp / pos) for t, fp, tp in direct(entries, True)]
        assert sorted(curve, reverse=True) == want


def test_working_point_takes_the_first_of_equally_near_points(spark):
    curve = spark.createDataFrame(
        [(1, 2, float("inf"), 0.0, 1.0), (1, 2, 0.9, 0.1, 0.02), (1, 2, 0.8, 0.3, 0.0),
         (1, 3, float("inf"), 0.0, 1.0), (1, 3, 0.5, 0.6, 0.25), (1, 3, 0.4, 0.9, 0.25), (1, 3, 0.3, 1.0, None)],
        "cat1 int, cat2 int, threshold double, fpr double, miss double",
    )
    got = {r["cat2"]: (r["fpr"], r["threshold"]) for r in roc.working_points(curve).collect()}
    assert got == {2: (0.1, 0.9), 3: (0.6, 0.5)}


def test_zoom(spark):
    curve = spark.createDataFrame([(0.0, 0.5), (0.1, 0.01), (0.2, 0.02), (0.05, 0.6)], "fpr double, miss double")
    assert sorted(map(tuple, roc.zoom(curve).collect())) == [(0.0, 0.5), (0.1, 0.01)]


def test_accuracy_loss_and_micro_area(scored):
    import math

    df, rows = scored
    got = metrics.accuracy_and_loss(df, [1, 2, 3]).first()
    assert got["n"] == 300
    assert got["accuracy"] == pytest.approx(sum(p.index(max(p)) + 1 == y for _, y, p in rows) / 300)
    assert got["loss"] == pytest.approx(sum(-math.log(p[y - 1]) for _, y, p in rows) / 300)
    entries = [(p[c - 1], y == c) for _, y, p in rows for c in (1, 2, 3)]
    pos, neg = [s for s, y in entries if y], [s for s, y in entries if not y]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert metrics.micro_auc(df, [1, 2, 3]).first()["auc"] == pytest.approx(wins / len(pos) / len(neg))
