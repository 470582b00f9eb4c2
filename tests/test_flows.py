"""Whole flows on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from halosift.functions.grids import pixel_names
from halosift.operators import stats
from halosift.plans import flows
from halosift.session import resumable, shared_dir, step_folder
from halosift.sources.catalogue import FEATURE_SETS
from halosift.sources.runs import RunStore

SAMPLES = ["METPD", "EGamma", "GMSB_L-350TeV"]


@pytest.fixture(scope="module")
def dense(spark):
    rng = random.Random(1)
    features = sorted({f for s in FEATURE_SETS.values() for f in s})
    rows = []
    for i in range(600):
        label = rng.choice([-1, 0, 1, 1, 2, 3])
        rows.append((
            rng.choice(SAMPLES), i, 0, i % 2, label, int(rng.random() < 0.7),
            *[rng.gauss(label, 1.0) if f != "R9" or rng.random() > 0.1 else -999.0 for f in features],
        ))
    schema = "sample string, event bigint, object bigint, subcl bigint, label bigint, lead bigint, "
    return spark.createDataFrame(rows, schema + ", ".join(f"`{f}` double" for f in features))


def how(spark, tmp_path, run, epochs=3):
    return flows.Training(RunStore(spark, str(tmp_path)), run, epochs=epochs, shards=2)


def test_dense_flow(spark, dense, tmp_path):
    flow = flows.dense_flow(
        dense, ["event"], exclude="energy", even=True, training=how(spark, tmp_path, "d"), nodes=(8,), explain=True
    )
    last = flow["cut_flow"].orderBy("stage").collect()[-1]
    assert last["cut"] == "balanced" and last["n_phys"] == last["n_bh"] == last["n_spike"]
    n = last["total"]
    train_n = n - -(-n // 5)
    assert flow["scored"].count() == n - train_n
    hist = flow["histograms"].groupBy("feature").sum("n").collect()
    assert len(hist) == 5 and all(r[1] == train_n for r in hist)
    closed = flow["closure"].groupBy("feature").sum("true").collect()
    assert {r[0]: r[1] for r in closed} == {r[0]: r[1] for r in hist}
    assert flow["history"].count() == 9 and flow["working_points"].count() == 3
    assert flow["importance"].count() == 5
    assert 0 < flow["test_area"].first()["auc"] <= 1


def test_dense_flow_keeps_the_default_unbalanced_classes(dense):
    flow = flows.dense_flow(dense, ["event"])
    labels = {r["label"] for r in flow["histograms"].select("label").distinct().collect()}
    assert labels == {0, 1, 2, 3} and flow.model is None


def test_benchmark_flow_has_two_classes_that_can_be_told_apart(spark, dense, tmp_path):
    flow = flows.benchmark_flow(
        dense, ["event"], "clusterShapeOnly", training=how(spark, tmp_path, "b", 8), classes=(0, 1)
    )
    stages = {r["cut"]: r["total"] for r in flow["cut_flow"].collect()}
    assert stages["classes"] == sum(r["n"] for r in flow["rows"].collect()) < stages["leading photon"]
    assert flow.model.net.classes == 2
    assert flow["area"].first()["auc"] > 0.6
    curve = flow["curve"].orderBy("threshold").collect()
    assert curve[0]["fpr"] == curve[0]["tpr"] == 1.0
    assert {r["label"] for r in flow["scored"].select("label").distinct().collect()} == {0, 1}


def test_dry_runs_give_statistics_only(dense):
    assert set(flows.benchmark_flow(dense, ["event"], dry_run=True).tables) == {"cut_flow"}
    assert set(flows.dense_flow(dense, ["event"], even=True, dry_run=True).tables) == {"cut_flow"}


def test_missing_features_fail_by_name(dense):
    with pytest.raises(ValueError, match="Smajor"):
        flows.benchmark_flow(dense.drop("Smajor"), ["event"])


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(2)
    names = [n for ch in "Etr" for n in pixel_names(ch, 3)]
    rows = []
    for i in range(500):
        label = rng.choice([-1, 1, 2, 3])
        sample = "EGamma" if label == 1 else "METPD"
        rows.append((sample, i, 0, int(rng.random() < 0.2), label, *[rng.random() + label * (k % 3) for k in range(147)]))
    schema = "sample string, event bigint, object bigint, subcl bigint, label bigint, "
    return spark.createDataFrame(rows, schema + ", ".join(f"`{n}` double" for n in names))


@pytest.mark.parametrize("arch", ["small3", "dual"])
def test_grid_flow(spark, grid, tmp_path, arch):
    flow = flows.grid_flow(grid, ["event"], arch=arch, training=how(spark, tmp_path, arch, 2))
    assert flow["input_maps"].count() == 3 * 49
    totals = flow["input_maps"].groupBy("label").sum("value").collect()
    assert all(r[1] == pytest.approx(1) for r in totals)
    assert flow["activations"].select("event").distinct().count() == 1
    layers = {r[0] for r in flow["activations"].select("layer").distinct().collect()}
    assert layers == ({"conv0", "conv1"} if arch == "small3" else
                      {"branch1_conv0", "branch1_conv1", "branch2_conv0", "branch2_conv1", "branch2_conv2"})
    assert flow["pair_curves"].select("cat1", "cat2", "scored_by").distinct().count() == 6
    kept = flow["cut_flow"].orderBy("stage").collect()[-1]["total"]
    assert flow["scored"].count() == -(-kept // 5)


def test_subleading_maps_and_unknown_architecture(grid):
    assert set(flows.grid_flow(grid, ["event"], arch="sublead").tables) == {"input_maps"}
    with pytest.raises(ValueError, match="unknown architecture"):
        flows.grid_flow(grid, ["event"], arch="huge")


def test_reports(dense):
    row = flows.label_report(dense).first()
    kept = stats.summary(stats.apply_steps(dense, flows.CLEANING), stats.BENCHMARK_CLASSES).first()
    assert row["total"] == kept["total"] and row["n_sig"] == kept["n_sig"]
    assert flows.by_process(dense).count() == 3


def test_run_name():
    assert flows.run_name("dense", "even", "without_sw+", epochs=20) == "dense_even_without_swp_20epochs"
    assert flows.run_name("dense", "", epochs=5, early_stop=True) == "dense_5epochs_earlyStop"


def test_benchmark_training(spark, tmp_path):
    how = flows.benchmark_training(RunStore(spark, str(tmp_path)), "clusterShapeOnly", "v2", shards=2)
    assert (how.epochs, how.early_stop, how.run) == (1500, False, "benchmark_v2_clusterShapeOnly_1500epochs")
    assert flows.benchmark_training(how.store, "default", shards=2).run.endswith("500epochs_earlyStop")


def test_benchmark_flow_keeps_all_rows_that_the_cuts_leave(spark, dense):
    flow = flows.benchmark_flow(dense, ["event"], "clusterShapeOnly")
    left = flow["cut_flow"].orderBy("stage").collect()[-1]
    assert left["cut"] == "leading photon" and left["total"] == sum(r["n"] for r in flow["rows"].collect())
    assert {r["label"] for r in flow["rows"].select("label").collect()} == {0, 1, 3}


def reads_of(df, run) -> int:
    """How often ``run`` reads ``df``, counted by rows that pass an accumulator."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def mark(stream):
        for batch in stream:
            seen.add(batch.num_rows)
            yield batch

    run(df.mapInArrow(mark, df.schema))
    return seen.value / df.count()


def test_flows_read_their_input_once(spark, dense, grid):
    def count(result):
        return [t.count() for t in result.tables.values()]

    assert reads_of(dense, lambda df: count(flows.dense_flow(df, ["event"], even=True))) == 1
    assert reads_of(dense, lambda df: count(flows.benchmark_flow(df, ["event"]))) == 1
    assert reads_of(grid, lambda df: count(flows.grid_flow(df, ["event"], dry_run=True))) == 1


@pytest.mark.parametrize("samples", [True, False])
def test_stages_counted_while_writing_match_the_cut_flow(spark, dense, samples):
    steps = flows.benchmark_steps([1, 3])
    columns = ["event", "label", "energy"]
    rows, flow = stats.run_while_writing(dense, steps, columns, stats.BENCHMARK_CLASSES, samples)
    want = stats.cut_flow(dense, steps, stats.BENCHMARK_CLASSES, samples)
    assert flow.columns == want.columns
    assert sorted(map(tuple, flow.collect())) == sorted(map(tuple, want.collect()))
    plain = stats.apply_steps(dense, steps).select(*columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.collect()))
    empty, none = stats.run_while_writing(dense.limit(0), steps, columns, stats.BENCHMARK_CLASSES, samples)
    assert empty.count() == 0 and {r["total"] for r in none.collect()} == {0}


def test_explained_flow_with_a_composite_key(spark, dense, tmp_path):
    flow = flows.dense_flow(dense, ["event", "object"], training=how(spark, tmp_path, "x", 1), explain=True)
    assert flow["importance"].count() == 6
    assert all(r["importance"] >= 0 for r in flow["importance"].collect())


def test_grid_flow_with_missing_pixels_and_an_own_net(spark, grid, tmp_path):
    from pyspark.sql import functions as F
    from halosift.models.nets import grid_net

    pixel = next(c for c in grid.columns if c.startswith("CNNgrid_E"))
    holed = grid.withColumn(pixel, F.when(F.col("event") % 10 == 0, None).otherwise(F.col(pixel)))
    flow = flows.grid_flow(
        holed, ["event"], arch=lambda shape, n: grid_net("xsmall3", shape, n), training=how(spark, tmp_path, "own", 1),
        drop_incomplete=True, fit_on_train=True,
    )
    assert "complete" in {r["cut"] for r in flow["cut_flow"].collect()} and flow["working_points"].count() == 3


def test_pinned_tables_are_deleted_at_the_end_of_a_block(spark, dense, tmp_path):
    from halosift.session import pin, released

    stays = pin(dense)
    with released(spark):
        flow = flows.dense_flow(dense, ["event"])
        kept = flow["histograms"].toPandas()
        goes = pin(dense)
    assert len(kept) and stays.count() == dense.count()
    with pytest.raises(Exception):
        goes.count()


def test_feature_sets_trained_together(spark, dense, tmp_path):
    store = RunStore(spark, str(tmp_path))
    sets = {s: flows.Training(store, s, n, shards=1) for s, n in (("clusterShapeOnly", 2), ("IsoOnly", 1))}
    flow = flows.benchmark_sets(dense, ["event"], sets, nodes=(4,))
    assert {r["features"]: r["epochs"] for r in flow["areas"].collect()} == {"clusterShapeOnly": 2, "IsoOnly": 1}
    assert all(0 < r["auc"] <= 1 for r in flow["areas"].collect())
    assert store.history("clusterShapeOnly").count() == 6


def test_a_failed_flow_goes_on_from_its_pinned_rows(spark, dense, tmp_path, monkeypatch):
    raw, name = str(tmp_path / "raw"), f"again-{tmp_path.name}"
    dense.coalesce(2).write.parquet(raw)
    options = dict(training=how(spark, tmp_path / "runs", "r", epochs=1), nodes=(4,))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(flows, "_train", fail)
        with pytest.raises(OSError), resumable(spark, name):
            flows.benchmark_flow(spark.read.parquet(raw), ["event"], **options)
    want = sorted(map(tuple, flows.benchmark_flow(spark.read.parquet(raw), ["event"])["cut_flow"].collect()))

    same, other = spark.read.parquet(raw), spark.read.parquet(raw)
    for part in (tmp_path / "raw").glob("part-*"):
        part.write_bytes(b"")  # from here on, any read of the raw rows fails
    with resumable(spark, name):
        with pytest.raises(Exception):  # another selection is another step
            flows.benchmark_flow(other, ["event"], classes=[1, 3])
        flow = flows.benchmark_flow(same, ["event"], **options)
        assert sorted(map(tuple, flow["cut_flow"].collect())) == want
        assert flow["history"].count() > 0 and 0 <= flow["area"].first()["auc"] <= 1
        folder = step_folder(same)
    assert folder.startswith(f"{shared_dir(spark)}/flows/{name}/") and not (spark._jvm.java.io.File(folder).getParentFile().exists())


def test_steps_are_named_by_plan_and_files(spark, dense, tmp_path):
    at = str(tmp_path / "t")
    dense.limit(50).coalesce(1).write.parquet(at)
    assert step_folder(spark.read.parquet(at)) is None  # outside of a block
    with resumable(spark, f"names-{tmp_path.name}"):
        one, again = spark.read.parquet(at), spark.read.parquet(at)
        assert step_folder(one) == step_folder(again) != step_folder(one, "more")
        assert len({step_folder(t) for t in (one, one.filter("label = 1"), one.filter("label = 2"), one.drop("lead"))}) == 4
        assert step_folder(dense) is None  # rows of the session: not told apart by their plan
        assert step_folder(one.mapInArrow(lambda it: it, one.schema)) is None
        assert step_folder(one.select(F.udf(lambda v: v, "long")("label"))) is None
        dense.limit(60).coalesce(1).write.mode("overwrite").parquet(at)
        assert step_folder(spark.read.parquet(at)) != step_folder(one)
