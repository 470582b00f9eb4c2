"""Cuts on hand-made rows: every rule about missing values, and group cuts."""

import random
from collections import Counter

import pytest

from halosift.operators import cuts

SCHEMA = "id int, sample string, event bigint, object bigint, subcl bigint, label bigint, R9 double, lead bigint"
ROWS = [
    (1, "GMSB_L-350TeV", 1, 0, 0, 1, 0.5, 1),
    (2, "GMSB_L-350TeV", 1, 0, 1, 0, 0.5, 0),
    (3, "METPD", 1, 0, 0, 1, -999.0, 1),
    (4, "EGamma", 2, 0, None, 1, None, None),
    (5, "EGamma", 2, 1, 0, 2, 0.9, 1),
    (6, None, 3, 0, 2, 1, 0.9, 1),
    (7, None, 3, 0, 0, None, 0.9, 1),
    (8, "METPD", 4, 0, 0, -1, 0.9, 1),
    (9, "METPD", 4, 0, 0, 3, 0.9, 0),
    (10, "GMSB_L-350TeV", 5, 0, 0, None, 0.1, 1),
    (11, "METPD", None, 0, 0, 3, 0.9, 0),
    (12, "METPD", None, 0, 0, 3, 0.9, 0),
    (13, "METPD", -1, 0, 0, 3, 0.9, 0),
    (14, "METPD", -1, 0, 0, 3, 0.9, 0),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(table):
    return sorted(r["id"] for r in table.collect())


ALL = [r[0] for r in ROWS]


def without(*gone):
    return [i for i in ALL if i not in gone]


def test_missing_label_is_not_unmatched(df):
    assert ids(cuts.drop_unmatched(df)) == without(8)


def test_signal_sample_background(df):
    assert ids(cuts.drop_signal_sample_background(df)) == without(1)


def test_clean_keeps_incomplete_rows_unless_asked(df):
    assert ids(cuts.clean(df)) == without(1, 8)
    assert ids(cuts.clean(df, drop_incomplete=True)) == [2, 3, 5, 9, 13, 14]


def test_missing_subcl_is_subleading(df):
    lead, rest = cuts.split_leading(df)
    assert ids(rest) == [2, 4, 6] and ids(lead) == without(2, 4, 6)


def test_class_from_one_sample(df):
    # EGamma rows must be class 1; class 1 rows must be EGamma; no sample, no verdict.
    assert ids(cuts.select_class(df, 1, "EGamma")) == without(1, 3, 5)


def test_class_pattern_is_a_regular_expression(df):
    assert ids(cuts.select_class(df, 3, "^MET(PD|X)$")) == without(3, 8)


def test_sentinel_keeps_missing_and_lead_drops_missing(df):
    assert ids(cuts.drop_sentinel(df)) == without(3)
    assert ids(cuts.lead_photons(df)) == [1, 3, 5, 6, 7, 8, 10]


def test_relabel(df):
    got = {r["id"]: r["label"] for r in cuts.relabel(df, {2: 1}).collect()}
    assert got[5] == 1 and got[9] == 3 and got[7] is None


def test_single_subcluster_by_parent(df):
    # With the sample in the key, (1, 0) is shared by the two GMSB rows only.
    assert ids(cuts.single_subcluster_only(df)) == [3, 4, 5, 10, 11, 12, 13, 14]
    assert ids(cuts.single_subcluster_only(df, ("event", "object"))) == [4, 5, 10, 11, 12, 13, 14]


def test_single_subcluster_with_a_hot_parent_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (i, "METPD", 7 if rng.random() < 0.35 else rng.choice([None, -3, *range(60)]),
         rng.choice([None, 0, 1, 2]), 0, 1, 0.0, 1)
        for i in range(900)
    ]
    sizes = Counter((r[2], r[3]) for r in rows)
    want = [
        r[0] for r in rows
        if r[2] is None or r[3] is None or r[2] < 0 or sizes[r[2], r[3]] == 1
    ]
    for parts in (1, 4, 16):
        table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert ids(cuts.single_subcluster_only(table, ("event", "object"))) == want


def test_exclude_feature():
    assert cuts.feature_columns("fourFeature", "phi_sig")[0] == ["eta_sig", "etaphi_cov", "timeeta_cov"]
    cols, warning = cuts.feature_columns("fourFeature", "R9")
    assert len(cols) == 4 and "R9" in warning


def test_select_features_names_missing_columns(df):
    with pytest.raises(ValueError, match="Sietaieta"):
        cuts.select_features(df, "default")


def test_features_only(df):
    assert cuts.features_only(df).columns == ["id", "R9", "lead"]


def test_grid_width_comes_from_the_schema(spark):
    names = [f"CNNgrid_{c}_cell{i}_{j}" for c in "Etr" for i in range(-1, 2) for j in range(-1, 2)]
    cols, half = cuts.grid_columns(spark.createDataFrame([tuple([0.0] * 27 + [1])], names + ["label"]))
    assert cols == names and half == 1


# --- parents with one row --------------------------------------------------------------


def parents(spark, rows):
    return spark.createDataFrame(rows, "sample string, event bigint, object bigint, v string")


def plain_single(rows):
    import collections

    n = collections.Counter(r[:3] for r in rows)
    alone = lambda r: r[1] is None or r[2] is None or r[1] < 0 or r[2] < 0 or n[r[:3]] == 1
    return sorted(((r for r in rows if alone(r))), key=str)


@pytest.mark.parametrize("bits, few", [(None, 100_000), (10, 100_000), (10, 0)])
def test_single_parents_by_filter_match_plain_counts(spark, monkeypatch, bits, few):
    """Whatever the filter lets pass by mistake; nulls in the sample are a value; a hot parent."""
    from halosift.functions import bloom as blooms

    if bits:
        monkeypatch.setattr(blooms, "filter_size", lambda n: bits)  # 1,024 bits for 1,200 repeated keys: all hit
    monkeypatch.setattr(cuts, "SINGLE_AT_MOST", few)
    rows = [("a" if k % 3 else None, k % 2000, k % 2, f"v{k}") for k in range(4000)]
    rows += [("hot", 1, 1, "x")] * 3000 + [("a", None, 1, "n"), ("a", None, 1, "n"), ("a", -1, 0, "m"), ("a", -1, 0, "m"), (None, 5, 9, "one")]
    rows += [("b", k, 0, f"b{k}") for k in range(500)] + [("b", k, 0, f"c{k}") for k in range(0, 500, 2)]
    got = cuts.single_subcluster_only(parents(spark, rows).repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == plain_single(rows)


def test_rows_of_single_parents_are_not_moved(spark, tmp_path):
    """Their plan has no shuffle and no sort of rows; what moves are the key's hashes."""
    parents(spark, [("a", k // 2 if k < 6 else k, 0, "v" * 50) for k in range(5000)]).write.parquet(str(tmp_path / "t"))
    df = cuts.single_subcluster_only(spark.read.parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning" not in plan
    assert df.count() == 4994


def test_single_parents_of_an_empty_table(spark):
    assert cuts.single_subcluster_only(parents(spark, [])).collect() == []


def test_bloom_filter_lets_all_members_pass_and_few_others(spark):
    from pyspark.sql import functions as F

    from halosift.functions.bloom import bloom

    df = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    maybe = bloom(df.filter("id < 10000"), "h", 10_000)
    got = df.select("id", maybe(F.col("h")).alias("m")).groupBy((F.col("id") < 10_000).alias("inside")).agg(F.count_if("m").alias("n")).collect()
    found = {r["inside"]: r["n"] for r in got}
    assert found[True] == 10_000 and found[False] < 400
