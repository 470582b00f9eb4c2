"""Exact samples against a plain sort, with ties, copies and skew."""

import hashlib
from collections import Counter

import pytest

from halosift.operators import sampling


def digest(seed, *key):
    return hashlib.md5("|".join([str(seed), *map(str, key)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, [1, 1, 1, 2, 2, 3][i % 6]) for i in range(1200)], "id bigint, label int")


def firsts(rows, n, seed):
    return {r for r in sorted(rows, key=lambda r: digest(seed, r))[:n]}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_balance_takes_the_first_of_each_class(df, parts):
    got = sampling.balance_classes(df.repartition(parts), [1, 2, 3], ["id"]).collect()
    for label in (1, 2, 3):
        rows = [r["id"] for r in df.collect() if r["label"] == label]
        assert {r["id"] for r in got if r["label"] == label} == firsts(rows, 200, sampling.BALANCE_SEED)
    assert len(got) == 600


def test_balance_drops_labels_not_listed(df):
    got = sampling.balance_classes(df, [2, 3], ["id"])
    assert Counter(r["label"] for r in got.collect()) == {2: 200, 3: 200}


def test_classes_of_equal_size_are_all_kept(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)], "id bigint, label int")
    assert sampling.balance_classes(df, [0, 1], ["id"]).count() == 40


def test_absent_class_raises(df):
    with pytest.raises(ValueError, match=r"\[9\]"):
        sampling.balance_classes(df, [1, 9], ["id"])


def test_undersample_larger(spark, df):
    more = df.unionByName(spark.createDataFrame([(5000, None)], "id bigint, label int"))
    got = sampling.undersample_larger(more, ["id"], labels=(1, 2)).collect()
    assert Counter(r["label"] for r in got) == {1: 400, 2: 400, 3: 200, None: 1}


@pytest.mark.parametrize("n", [1, 2, 5, 6, 99, 101])
def test_split_sizes_and_disjointness(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "id bigint")
    train, test = sampling.train_test(df, ["id"])
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert len(b) == -(-n // 5) and not a & b and len(a | b) == n
    if len(a) > 1:
        fit, held = sampling.fit_validation(train, ["id"])
        assert fit.count() == len(a) * 4 // 5 and fit.count() + held.count() == len(a)


def test_take_random(df):
    rows = [r["id"] for r in df.collect()]
    assert {r["id"] for r in sampling.take_random(df, 37, 5, ["id"]).collect()} == firsts(rows, 37, 5)
    assert sampling.take_random(df, 5000, 5, ["id"]).count() == 1200
    assert sampling.take_random(df.limit(0), 5, 5, ["id"]).count() == 0


def test_refined_prefixes_give_the_same_rows(df, monkeypatch):
    want = sorted(map(tuple, sampling.balance_classes(df, [1, 2, 3], ["id"]).collect()))
    monkeypatch.setattr(sampling, "RANKED_AT_MOST", 0)
    monkeypatch.setattr(sampling, "PREFIX_STEP", 1)
    assert sorted(map(tuple, sampling.balance_classes(df, [1, 2, 3], ["id"]).collect())) == want


def test_one_key_with_a_third_of_all_rows(spark):
    """Copies of a key straddle the n-th place; every row is either in or out."""
    rows = [(0 if i % 3 == 0 else i, f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "key bigint, value string")
    for n in (1, 100, 250, 420, 599):
        quota = lambda t, n=n: {0: n}
        inside, outside = sampling.partition_exact(df, quota, 3, ["key"])
        a, b = inside.collect(), outside.collect()
        assert len(a) == n and Counter(a + b) == Counter(df.collect())
        # Every key before the straddled one is taken whole.
        last = max(digest(3, r["key"]) for r in a)
        assert all(digest(3, r["key"]) >= last for r in b)


def test_equal_rows_are_counted_not_ranked(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_ROW", 40)
    df = spark.createDataFrame([(7, "same")] * 300 + [(i, "x") for i in range(100)], "key bigint, value string")
    for n in (10, 200, 350):
        inside, outside = sampling.partition_exact(df, lambda t, n=n: {0: n}, 1)
        a, b = inside.collect(), outside.collect()
        assert len(a) == n and len(b) == 400 - n and Counter(a + b) == Counter(df.collect())


def test_asking_for_too_many_rows_raises(df):
    with pytest.raises(ValueError, match="rows wanted"):
        sampling.partition_exact(df, lambda t: {0: 5000}, 1, ["id"])


def test_rows_that_differ_in_microseconds_stay_apart(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 00:00:00.000001' + make_interval(0,0,0,0,0,0,id * 0.000001) AS at FROM range(4)")
    test, train = sampling.train_test(df)[::-1]
    assert test.unionByName(train).distinct().count() == 4
