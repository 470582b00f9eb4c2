"""Statistics and cut flow."""

import pytest

from halosift.operators import cuts, stats
from halosift.operators.sampling import balance_classes

SCHEMA = "id int, sample string, event bigint, object bigint, subcl bigint, label bigint"


@pytest.fixture(scope="module")
def df(spark):
    samples = ["GMSB_1", "GJets_HT", "QCD_HT", "METPD", "EGamma", None]
    rows = [
        (i, samples[i % 6], i // 3, i % 2, i % 4 if i % 11 else None, [-1, 0, 1, 2, 3, None][i % 7 % 6])
        for i in range(300)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_summary_counts(df):
    row = stats.summary(df).first().asDict()
    rows = df.collect()
    assert row["total"] == 300
    assert row["n_bh"] == sum(r["label"] == 2 for r in rows)
    assert row["n_data"] == sum(r["sample"] in ("METPD", "EGamma") for r in rows)
    assert row["f_gmsb"] == pytest.approx(50 / 300)


def test_summary_of_nothing_has_null_fractions(df):
    row = stats.summary(df.filter("id < 0")).first()
    assert row["total"] == 0 and row["n_phys"] == 0 and row["f_phys"] is None


def test_cut_flow_equals_summaries_of_each_stage(df):
    steps = [
        stats.Cut("matched", cuts.is_matched),
        stats.Relabel("merge", {2: 1}),
        stats.Cut("clean", cuts.is_not_signal_sample_background),
        stats.TableStep("single", cuts.single_subcluster_only),
        stats.Cut("leading", lambda label: cuts.is_leading()),
        stats.TableStep("balanced", lambda t: balance_classes(t, [1, 3], ["id"])),
        stats.Cut("nothing", lambda label: label.isNull() & label.isNotNull()),
    ]
    flow = stats.cut_flow(df, steps).orderBy("stage").collect()
    assert [r["cut"] for r in flow] == ["input"] + [s.name for s in steps]
    for n, row in enumerate(flow):
        want = stats.summary(stats.apply_steps(df, steps[:n])).first().asDict()
        got = row.asDict()
        assert {k: got[k] for k in want} == want
    totals = [r["total"] for r in flow]
    assert totals == sorted(totals, reverse=True) and totals[-1] == 0
    balanced = flow[-2]
    assert balanced["n_phys"] == balanced["n_spike"] > 0


def test_row_level_stages_share_one_aggregate(df):
    steps = [
        stats.Cut("matched", cuts.is_matched),
        stats.Cut("clean", cuts.is_not_signal_sample_background),
        stats.Cut("leading", lambda label: cuts.is_leading()),
    ]
    plan = stats.cut_flow(df, steps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_labels(df):
    assert stats.class_list(df) == [-1, 0, 1, 2, 3]
    with pytest.raises(ValueError, match="not a class column"):
        stats.class_list(df.selectExpr("id as label"), at_most=10)
    assert stats.smallest_class(df, [0, 1]).first()["label"] in (0, 1)
    assert sum(r["n"] for r in stats.class_sizes(df).collect()) == 300


def test_breakdown_by_sample(df):
    rows = stats.summary(df, samples=False, by=["sample"]).collect()
    assert len(rows) == 6 and sum(r["total"] for r in rows) == 300
