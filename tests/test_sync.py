"""Synchronous training: shards against one shard and plain Adam, several nets, early stop, resume; row order."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from halosift.models import sync
from halosift.models import train as training
from halosift.models.nets import Adam, dense_net
from halosift.operators import order
from halosift.sources.runs import RunStore


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(1, 4, 330)
    x = rng.normal(size=(330, 4)) * 0.4 + np.eye(4)[label - 1]
    rows = [(i, int(label[i]), [float(v) for v in x[i]]) for i in range(330)]
    return spark.createDataFrame(rows, "key bigint, label int, x array<double>")


def parts(data, shards):
    return sync.numbered_rows(data.filter("key < 250"), data.filter("key >= 250"), [1, 2, 3], shards, ["key"])


def history(store, run):
    return store.history(run).orderBy("metric", "epoch").collect()


def test_positions_count_all_fit_rows_and_do_not_depend_on_shards(data):
    one = {tuple(r["x"]): r["position"] for r in parts(data, 1).filter("NOT held").collect()}
    rows = parts(data.repartition(5), 3)
    assert rows.rdd.getNumPartitions() == 3
    three = {tuple(r["x"]): r["position"] for r in rows.filter("NOT held").collect()}
    assert one == three and sorted(one.values()) == list(range(250))
    assert rows.filter("held").count() == 80
    here = rows.filter("NOT held").withColumn("s", F.spark_partition_id()).groupBy("s").count().collect()
    assert sorted(r["count"] for r in here) == [83, 83, 84]


def test_orders_are_permutations():
    for n in (1, 2, 7, 100, 99991):
        for epoch in range(3):
            assert np.array_equal(np.sort(sync.epoch_order(np.arange(n), n, 1, epoch)), np.arange(n))
    big = (1 << 40) - 87
    at = np.array([0, 1, big - 1])
    got = sync.epoch_order(at, big, 5, 2)
    rng = np.random.default_rng([5, 2])
    factor, offset = int(rng.integers(1, big)), int(rng.integers(big))
    assert np.gcd(factor, big) == 1 and got.tolist() == [(factor * int(p) + offset) % big for p in at]


def plain_adam(rows, net, epochs, shuffle, size=100, seed=43):
    local = rows.orderBy("position").filter("NOT held").collect()
    x, y = np.array([r["x"] for r in local]), np.array([r["y"] for r in local])
    at = np.arange(len(y))
    state = Adam.begin(net.initial(seed))
    for epoch in range(epochs):
        turn = np.argsort(sync.epoch_order(at, len(y), seed, epoch)) if shuffle else at
        for k in range(0, len(y), size):
            now = turn[k:k + size]
            state.step(net.gradient(state.params, x[now], y[now])[1])
    return state


@pytest.mark.parametrize("shuffle", [False, True])
def test_one_shard_is_plain_adam(data, spark, tmp_path, shuffle):
    net, rows = dense_net(4, 3, (5,)), parts(data, 1)
    store = RunStore(spark, str(tmp_path))
    sync.fit(rows, [sync.Model("r", net, 4)], store, 1, shuffle=shuffle, epochs_per_job=3)
    want = plain_adam(rows, net, 4, shuffle)
    state = store.state("r")
    assert state["epoch"] == 4 and state["vector"][-1] == want.steps == 12
    assert np.allclose(state["vector"][:net.n_params], want.params, atol=1e-12)
    assert [r["epoch"] for r in history(store, "r")] == [1, 2, 3, 4] * 3


def test_shards_equal_one_shard(data, spark, tmp_path):
    """Same batches, whatever the shards: parameters and metrics to 1e-9. The last batch is not full."""
    net = dense_net(4, 3, (5,))
    got = {}
    for shards in (1, 2, 4):
        store = RunStore(spark, str(tmp_path / str(shards)))
        sync.fit(parts(data, shards), [sync.Model("r", net, 2)], store, shards, batch_rows=120)
        got[shards] = store.state("r")["vector"], [(r["metric"], r["epoch"], r["train"], r["val"]) for r in history(store, "r")]
    for shards in (2, 4):
        assert np.abs(np.array(got[shards][0]) - np.array(got[1][0])).max() < 1e-9
        for a, b in zip(got[shards][1], got[1][1]):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=1e-9)


def test_shards_without_rows_take_part(data, spark, tmp_path):
    small = data.filter("key < 5 OR key >= 327")
    rows = sync.numbered_rows(small.filter("key < 5"), small.filter("key >= 327"), [1, 2, 3], 6, ["key"])
    net, store = dense_net(4, 3, (2,)), RunStore(spark, str(tmp_path))
    sync.fit(rows, [sync.Model("r", net, 1)], store, 6, batch_rows=2, shuffle=False)
    want = plain_adam(rows, net, 1, False, 2)
    assert np.allclose(store.state("r")["vector"][:net.n_params], want.params, atol=1e-9)


def test_nets_together_train_as_alone(data, spark, tmp_path):
    """Each on its own columns and for its own number of epochs; as many jobs as the longest needs."""
    rows = parts(data, 1)
    models = [sync.Model("all", dense_net(4, 3, (5,)), 5), sync.Model("two", dense_net(2, 3, (4,)), 3, columns=(2, 0))]
    store, alone = RunStore(spark, str(tmp_path / "a")), RunStore(spark, str(tmp_path / "b"))
    both = sync.fit(rows, models, store, 1, epochs_per_job=2)
    for m in models:
        own = sync.fit(rows, [m], alone, 1, epochs_per_job=4)[m.run]
        assert np.allclose(both[m.run].params, own.params, atol=1e-12) and both[m.run].epochs == own.epochs == m.epochs
        assert np.allclose(store.state(m.run)["vector"], alone.state(m.run)["vector"], atol=1e-12)
        assert store.checkpoints(m.run).count() == alone.checkpoints(m.run).count()


def test_job_count_does_not_depend_on_the_number_of_nets(data, monkeypatch, spark, tmp_path):
    rows, calls = parts(data, 1), []
    real = sync.run_epochs
    monkeypatch.setattr(sync, "run_epochs", lambda *a, **k: calls.append(len(a[1])) or real(*a, **k))
    sync.fit(rows, [sync.Model(f"r{k}", dense_net(4, 3, (2,)), 4) for k in range(3)], RunStore(spark, str(tmp_path)), 1, epochs_per_job=2)
    assert calls == [3, 3]


def test_resume_goes_on_where_it_stopped(data, spark, tmp_path):
    net, rows = dense_net(4, 3, (5,)), parts(data, 1)
    whole, cut = RunStore(spark, str(tmp_path / "a")), RunStore(spark, str(tmp_path / "b"))
    sync.fit(rows, [sync.Model("r", net, 5)], whole, 1, epochs_per_job=2)
    sync.fit(rows, [sync.Model("r", net, 2)], cut, 1, epochs_per_job=2)
    sync.fit(rows, [sync.Model("r", net, 5)], cut, 1, epochs_per_job=2, resume=True)
    assert np.allclose(whole.state("r")["vector"], cut.state("r")["vector"], atol=1e-12)
    assert [tuple(r) for r in history(whole, "r")] == [tuple(r) for r in history(cut, "r")]


def test_early_stop_is_that_of_epoch_training(data, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "STOP_FROM_EPOCH", 2)
    monkeypatch.setattr(sync, "STOP_MIN_DELTA", 10.0)  # the second epoch looked at never improves enough
    rows, net, store = parts(data, 1), dense_net(4, 3, (5,)), RunStore(spark, str(tmp_path))
    model = sync.Model("r", net, 9, early_stop=True)
    assert sync.fit(rows, [model], store, 1, epochs_per_job=2)["r"].epochs == 4
    assert sync.fit(rows, [model], store, 1, epochs_per_job=2, resume=True)["r"].epochs == 4


def test_refusals(data, spark, tmp_path, monkeypatch):
    rows, store = parts(data, 2), RunStore(spark, str(tmp_path))
    net = dense_net(4, 3, (5,))
    with pytest.raises(ValueError, match="epoch"):
        sync.fit(rows, [sync.Model("r", net, 0)], store, 2)
    with pytest.raises(ValueError, match="run name"):
        sync.fit(rows, [sync.Model("r", net, 1)] * 2, store, 2)
    monkeypatch.setattr(sync, "SENT_AT_MOST", 100)
    with pytest.raises(ValueError, match="fewer"):
        sync.fit(rows, [sync.Model("r", net, 1)], store, 2)
    with pytest.raises(ValueError, match="no rows"):
        sync.numbered_rows(data.limit(0), data, [1, 2, 3], 2, ["key"])
    with pytest.raises(ValueError, match="label outside"):
        sync.numbered_rows(data, data, [1, 2], 2, ["key"])
    with pytest.raises(ValueError, match="missing"):
        sync.numbered_rows(data.withColumn("x", F.expr("array(1D, NULL, 0D, 0D)")), data, [1, 2, 3], 2, ["key"])


def test_equal_rows_and_keys_are_all_trained_on(data):
    again = data.filter("key < 3").unionByName(data.filter("key < 3")).unionByName(data.filter("key = 3").withColumn("key", F.lit(0).cast("bigint")))
    rows = sync.numbered_rows(again, data.filter("key = 9"), [1, 2, 3], 2, ["key"]).filter("NOT held").collect()
    assert sorted(r["position"] for r in rows) == list(range(7))


@pytest.mark.parametrize("wide, shuffle", [(1 << 18, True), (1, False)])
def test_rows_that_stream_by_train_as_held_ones(data, spark, tmp_path, monkeypatch, wide, shuffle):
    """In segments one after another or as one job a step; several nets, early end of one, the last batch not full."""
    models = [sync.Model("all", dense_net(4, 3, (5,)), 3), sync.Model("two", dense_net(2, 3, (4,)), 2, columns=(2, 0))]
    held, streamed = RunStore(spark, str(tmp_path / "a")), RunStore(spark, str(tmp_path / "b"))
    want = sync.fit(parts(data, 1), models, held, 1, batch_rows=30, shuffle=shuffle)
    for name, value in (("HELD_AT_MOST", 0), ("SEGMENT_ROWS", 100), ("FILE_ROWS", 25), ("WIDE_BATCH", wide)):
        monkeypatch.setattr(sync, name, value)
    monkeypatch.setattr(sync, "_Shard", None)  # nothing is held
    got = sync.fit(parts(data, 1), models, streamed, 1, batch_rows=30, shuffle=shuffle)
    for m in models:
        assert got[m.run].epochs == want[m.run].epochs and np.allclose(got[m.run].params, want[m.run].params, atol=1e-9)
        assert np.allclose(streamed.state(m.run)["vector"], held.state(m.run)["vector"], atol=1e-9)
        for a, b in zip(history(streamed, m.run), history(held, m.run)):
            assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=1e-9)


def test_a_large_batch_is_taken_in_parts():
    rng, net = np.random.default_rng(2), dense_net(4, 3, (5,))
    x, y, params = rng.normal(size=(40000, 4)), rng.integers(0, 3, 40000), net.initial(1)
    seen = training.MetricSums(3)
    p, grad = net.gradient(params, x, y)
    assert np.allclose(sync._add_gradient(net, params, x, y, seen) / len(y), grad, atol=1e-12)
    assert np.allclose(seen.flush(), training.metric_sums(p, y))


def test_steps_make_no_arrays_of_their_own(monkeypatch):
    """From step to step less memory is taken than two layers of a batch need; results are those of plain steps."""
    rng, net = np.random.default_rng(3), dense_net(4, 3, (64, 64))
    x, y, at = rng.normal(size=(2050, 4)), rng.integers(0, 3, 2050), np.arange(2050)
    shard = type("Shard", (), {"x": x, "y": y, "position": at, "held_x": x[:700], "held_y": y[:700], "total": lambda self, v: v})()
    state, want = sync.Progress(Adam.begin(net.initial(1))), Adam.begin(net.initial(1))
    taken, held, step = [], [0], Adam.step

    def traced(self, grad):
        step(self, grad)
        now, peak = tracemalloc.get_traced_memory()
        taken.append(peak - held[0])
        held[0] = now
        tracemalloc.reset_peak()

    monkeypatch.setattr(Adam, "step", traced)
    tracemalloc.start()
    try:
        sums = sync._epoch(shard, [sync.Model("r", net, 1)], [state], at, 2050, 100)
    finally:
        tracemalloc.stop()
    monkeypatch.undo()
    assert len(taken) == 21 and max(taken[1:-1]) < 2 * 100 * 64 * 8  # the first and the last have other rows than the batch before
    seen = training.MetricSums(3)
    for k in range(0, 2050, 100):
        p, grad = net.gradient(want.params, x[k:k + 100], y[k:k + 100])
        seen.add(p, y[k:k + 100])
        want.step(grad)
    assert np.allclose(state.adam.params, want.params, atol=1e-12) and np.allclose(sums[0], seen.flush())
    assert np.allclose(sums[1], training.metric_sums(net.predict(want.params, x[:700]), y[:700]))


# --- row order -------------------------------------------------------------------------


def test_rows_of_files_are_numbered_as_they_stand(spark, tmp_path):
    for name, span in (("b", range(100, 130)), ("a", range(40)), ("c", range(200, 201))):
        spark.createDataFrame([(k,) for k in reversed(span)], "v int").coalesce(1).write.parquet(str(tmp_path / "t" / name))
    table = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "t"))
    numbered = order.in_file_order(table)
    got = [r["v"] for r in numbered.orderBy(order.POSITION).collect()]
    assert got == [*reversed(range(40)), *reversed(range(100, 130)), 200]
    assert [r["v"] for r in order.first_rows(numbered, 2).orderBy(order.POSITION).collect()] == [39, 38]
    first, last = order.last_fifth(numbered)
    assert first.count() == 56 and {r["v"] for r in last.collect()} == {*range(100, 114), 200}


def test_rows_of_one_file_are_not_sent_to_one_task(spark, tmp_path):
    """However small a table must be to be broadcast by itself: the starts of the files always are."""
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = order.in_file_order(spark.read.parquet(str(tmp_path / "t")))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [r["id"] for r in numbered.orderBy(order.POSITION).collect()] == list(range(100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbers_in_order_of_a_column(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 7).alias("k")).repartition(5)
    rows = order.in_order_of(df, [F.col("k"), -F.col("id")], ranges=4).orderBy(order.POSITION).collect()
    assert [r[order.POSITION] for r in rows] == list(range(1000))
    assert [(r["k"], r["id"]) for r in rows] == sorted(((i % 7, i) for i in range(1000)), key=lambda p: (p[0], -p[1]))
    assert order.in_order_of(df.limit(0), [F.col("k")]).count() == 0


def test_small_ranges_are_joined(spark):
    """A small table is sorted and written by one task, not by as many as a shuffle may have; numbers do not depend on it."""
    df = spark.range(0, 1000).select(F.col("id"), F.xxhash64("id").alias("k")).repartition(5)
    one, four = order.in_order_of(df, [F.col("k")]), order.in_order_of(df, [F.col("k")], ranges=4)
    assert len(one.inputFiles()) == 1 and len(four.inputFiles()) == 4
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in four.collect()}
