"""Training, scoring and attribution as Spark jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halosift.models import score as scoring
from halosift.models import train as training
from halosift.models.nets import Adam, Net, conv_net, dense_net
from halosift.operators import attribution
from halosift.sources.runs import RunStore


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(1, 4, 450)
    x = rng.normal(size=(450, 4)) * 0.4 + np.eye(4)[label - 1]
    rows = [(i, int(label[i]), [float(v) for v in x[i]]) for i in range(450)]
    return spark.createDataFrame(rows, "key bigint, label int, x array<double>"), x, label


def test_one_shard_is_plain_mini_batch_adam(data):
    df, _, _ = data
    net = dense_net(4, 3, (5,))
    rows = training.pin_shards(df, [1, 2, 3], 1, ["key"])
    local = rows.collect()
    x, y = np.array([r["x"] for r in local]), np.array([r["y"] for r in local])
    state, want = Adam.begin(net.initial(1)), Adam.begin(net.initial(1))
    for epoch in range(2):
        state, _ = training.train_epoch(rows, net, state, 1, epoch, shuffle=False)
        for at in range(0, len(y), training.BATCH_ROWS):
            _, grad = net.gradient(want.params, x[at:at + 100], y[at:at + 100])
            want.step(grad)
    assert state.steps == want.steps == 10
    assert np.allclose(state.params, want.params) and np.allclose(state.second, want.second)


def test_shards_are_averaged_by_rows(data):
    df, _, _ = data
    net = dense_net(4, 3, (5,))
    rows = training.pin_shards(df, [1, 2, 3], 3, ["key"])
    assert rows.rdd.getNumPartitions() == 3
    parts = rows.withColumn("s", F.spark_partition_id()).collect()
    got, _ = training.train_epoch(rows, net, Adam.begin(net.initial(1)), 1, 0, shuffle=False)
    total, n = 0.0, 0
    for s in {r["s"] for r in parts}:
        mine = [r for r in parts if r["s"] == s]
        x, y = np.array([r["x"] for r in mine]), np.array([r["y"] for r in mine])
        one = Adam.begin(net.initial(1))
        for at in range(0, len(y), 100):
            one.step(net.gradient(one.params, x[at:at + 100], y[at:at + 100])[1])
        total, n = total + one.params * len(y), n + len(y)
    assert np.allclose(got.params, total / n)


def test_training_does_not_depend_on_how_the_table_was_partitioned(data):
    df, _, _ = data
    net = dense_net(4, 3, (5,))
    results = []
    for parts in (1, 16):
        rows = training.pin_shards(df.repartition(parts), [1, 2, 3], 3, ["key"])
        state, seen = training.train_epoch(rows, net, Adam.begin(net.initial(1)), 1, 0)
        results.append((state.params, seen["loss"]))
    assert np.array_equal(results[0][0], results[1][0]) and results[0][1] == results[1][1]


def test_large_state_travels_in_pieces(data, monkeypatch):
    df, _, _ = data
    net = dense_net(4, 3, (5,))
    rows = training.pin_shards(df, [1, 2, 3], 2, ["key"])
    want, _ = training.train_epoch(rows, net, Adam.begin(net.initial(1)), 1, 0)
    monkeypatch.setattr(training, "PIECE", 7)
    got, _ = training.train_epoch(rows, net, Adam.begin(net.initial(1)), 1, 0)
    assert np.array_equal(want.params, got.params)


def test_metrics_match_a_direct_computation(data):
    df, x, label = data
    net = dense_net(4, 3, (5,))
    rows = training.pin_shards(df, [1, 2, 3], 4, ["key"])
    params = net.initial(2)
    got = training.evaluate(rows, net, params)
    p = net.predict(params, x)
    assert got["loss"] == pytest.approx(-np.log(p[np.arange(450), label - 1]).mean())
    assert got["accuracy"] == pytest.approx((p.argmax(axis=1) == label - 1).mean())
    truth = np.eye(3)[label - 1].ravel().astype(bool)
    pos, neg = p.ravel()[truth], p.ravel()[~truth]
    exact = ((pos[:, None] > neg) + (pos[:, None] == neg) / 2).mean()
    assert got["auc"] == pytest.approx(exact, abs=0.01)


def test_training_learns_and_keeps_the_best(spark, data, tmp_path):
    df, _, _ = data
    net = dense_net(4, 3, (16,))
    fit = training.pin_shards(df.filter("key % 5 > 0"), [1, 2, 3], 2, ["key"])
    held = training.pin_shards(df.filter("key % 5 = 0"), [1, 2, 3], 2, ["key"])
    store = RunStore(spark, str(tmp_path))
    model = training.train(fit, held, net, store, "r", 12)
    history = store.history("r").filter("metric = 'loss'").orderBy("epoch").collect()
    assert len(history) == 12 and history[-1]["val"] < history[0]["val"] * 0.95
    saved = store.checkpoints("r").orderBy("epoch").collect()
    losses = [r["val_loss"] for r in saved]
    assert losses == sorted(losses, reverse=True)
    assert np.array_equal(model.params, saved[-1]["params"])
    # A new training of the same run starts from empty tables.
    training.train(fit, held, net, store, "r", 1)
    assert store.history("r").count() == 3


def test_early_stop(spark, data, tmp_path, monkeypatch):
    df, _, _ = data
    rows = training.pin_shards(df, [1, 2, 3], 1, ["key"])
    losses = iter([0.9, 0.95, 0.8, 0.7, 0.7, 0.1, 0.1])
    monkeypatch.setattr(training, "STOP_FROM_EPOCH", 2)
    monkeypatch.setattr(
        training, "evaluate", lambda *a: {"loss": next(losses), "accuracy": 0.0, "auc": 0.0}
    )
    model = training.train(
        rows, rows, dense_net(4, 3, (2,)), RunStore(spark, str(tmp_path)), "r", 7, early_stop=True
    )
    assert model.epochs == 5  # 0.8 and 0.7 improve from the start epoch on, the next 0.7 does not


def test_missing_features_are_refused(spark):
    df = spark.createDataFrame([(1, 1, [1.0, None])], "key int, label int, x array<double>")
    with pytest.raises(ValueError, match="missing features"):
        training.pin_shards(df, [1, 2], 1, ["key"])


def test_nothing_to_train_on_is_an_error(data, spark, tmp_path):
    df, _, _ = data
    rows = training.pin_shards(df.limit(0), [1, 2, 3], 2, ["key"])
    with pytest.raises(ValueError, match="no rows"):
        training.evaluate(rows, dense_net(4, 3, (2,)), np.zeros(19))
    with pytest.raises(ValueError, match="one epoch"):
        training.train(rows, rows, dense_net(4, 3, (2,)), RunStore(spark, str(tmp_path)), "r", 0)


def test_scores_and_missing_inputs(spark):
    net = dense_net(2, 3, (4,))
    df = spark.createDataFrame(
        [(1, [0.5, -1.0]), (2, [None, 1.0]), (3, None), (4, [2.0, 0.0])], "key int, x array<double>"
    )
    params = net.initial(1)
    got = {r["key"]: r["p"] for r in scoring.score(df, net, params).collect()}
    assert got[2] is None and got[3] is None
    want = net.predict(params, np.array([[0.5, -1.0], [2.0, 0.0]]))
    assert np.allclose([got[1], got[4]], want) and sum(got[1]) == pytest.approx(1)


def test_activations(spark):
    net = conv_net((5, 5, 2), 3, [3, 2])
    x = np.random.default_rng(0).normal(size=(2, 50))
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(2)], "key int, x array<double>")
    params = net.initial(5)
    assert scoring.conv_layers(net) == ["conv0"]
    want = net.activations(params, x, "conv0")
    rows = scoring.activations(df, net, params, "conv0", ["key"]).collect()
    assert len(rows) == want.size
    for r in rows:
        assert r["value"] == pytest.approx(want[r["key"], r["i"], r["j"], r["kernel"]])


def linear_net(weights):
    """Two outputs whose logit difference is linear in x."""
    net = Net((1, 1, len(weights)), ((),), (), 2)
    params = np.zeros(net.n_params)
    net.dense_layers[0].parts(params)[0][0, 0, :, 0] = weights
    return net, params


def test_attributions_add_up(spark):
    rng = np.random.default_rng(7)
    net, params = linear_net([0.01, -0.02, 0.0])
    x = rng.normal(size=(12, 3))
    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(12)], "key bigint, x array<double>")
    explained, background = df.filter("key < 5"), df.filter("key >= 5")
    got = attribution.attributions(explained, background, net, params, "key", walks_per_background=3)
    values = np.zeros((5, 3))
    for r in got.collect():
        values[r["key"], r["feature"]] = r["value"]
    p = net.predict(params, x)[:, 0]
    assert np.allclose(values.sum(axis=1), p[:5] - p[5:].mean())
    # Close to linear: each feature's share is its weight times its distance from the background.
    assert np.allclose(values, 0.25 * np.array([0.01, -0.02, 0.0]) * (x[:5] - x[5:].mean(axis=0)), atol=2e-4)
    summary = {r["feature"]: r["importance"] for r in attribution.importance(got, ["a", "b", "c"]).collect()}
    assert summary["c"] == 0 and summary["b"] > 0


def test_rows_with_one_key_keep_their_own_attributions(spark):
    rng = np.random.default_rng(3)
    net, params = linear_net([0.4, -0.3])
    x = rng.normal(size=(8, 2))
    df = spark.createDataFrame([(k // 2, k % 2, [float(v) for v in x[k]]) for k in range(8)], "event int, part int, x array<double>")
    got = attribution.attributions(df, df, net, params, ["event", "part"]).collect()
    total = {}
    for r in got:
        total[r["event"], r["part"]] = total.get((r["event"], r["part"]), 0) + r["value"]
    p = net.predict(params, x)[:, 0]
    assert all(total[k // 2, k % 2] == pytest.approx(p[k] - p.mean()) for k in range(8))
    assert len(attribution.attributions(df, df, net, params, "event").collect()) == 16  # not merged by a shared key


def test_a_small_table_is_explained_whole(spark):
    net, params = linear_net([0.4, -0.3])
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "key int, x array<double>")
    assert attribution.explain_sample(df, net, params, "key").select("key").distinct().count() == 30
    some = attribution.explain_sample(df, net, params, "key", explained_rows=5, background_rows=3)
    assert some.select("key").distinct().count() == 5


def test_a_hot_key_and_equal_rows_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"), (F.col("id") % 2 + 1).alias("label"),
        F.array(F.when(F.col("id") % 3 == 0, F.col("id") % 6).otherwise(F.col("id")).cast("double")).alias("x"))
    shards = training.pin_shards(rows, [1, 2], 8, ["key"])
    sizes = [r["n"] for r in shards.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1.3 * 6000 / 8


def test_training_refuses_other_labels_and_infinite_inputs(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 4, [2.0])], "key int, label int, x array<double>")
    with pytest.raises(ValueError, match="1 training rows have a label outside"):
        training.pin_shards(df, [1, 2], 1, ["key"])
    df = spark.createDataFrame([(1, 1, [float("inf")])], "key int, label int, x array<double>")
    with pytest.raises(ValueError, match="infinite"):
        training.pin_shards(df, [1, 2], 1, ["key"])


def test_infinite_inputs_have_no_score(spark):
    net, params = linear_net([0.4, -0.3])
    df = spark.createDataFrame([([1.0, 2.0],), ([float("inf"), 1.0],), ([float("nan"), 1.0],)], "x array<double>")
    assert [r["p"] is None for r in scoring.score(df, net, params).collect()] == [False, True, True]


def test_training_goes_on_after_its_last_epoch(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 2 + 1, [float(k % 7), float(k % 2)]) for k in range(60)], "key int, label int, x array<double>")
    fit, held = (training.pin_shards(df.filter(f"key % 5 {o} 0"), [1, 2], 2, ["key"]) for o in (">", "="))
    net, store = dense_net(2, 2, (3,)), RunStore(spark, str(tmp_path))
    whole = training.train(fit, held, net, store, "whole", 4, batch_rows=10)
    training.train(fit, held, net, store, "parts", 2, batch_rows=10)
    parts = training.train(fit, held, net, store, "parts", 4, batch_rows=10, resume=True)
    assert parts.epochs == 4 and np.allclose(parts.params, whole.params)
    same = [sorted((r["epoch"], r["metric"], round(r["val"], 9)) for r in store.history(x).collect()) for x in ("whole", "parts")]
    assert same[0] == same[1]
