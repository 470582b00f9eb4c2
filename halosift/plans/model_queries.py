"""Scoring, training, attribution and whole flows over the given tables.

Scoring uses parameters made by a rule, so that plain SQL can repeat it. What
training produces is not a SQL result; those queries have no check SQL.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halosift.functions.grids import GridSpec, build_images
from halosift.models import score as scoring
from halosift.models.nets import Layer, Net, dense_net, grid_net
from halosift.models.sync import Model, fit, numbered_rows
from halosift.models.train import Trained, pin_shards, train
from halosift.operators import attribution, sampling, stats
from halosift.plans import flows
from halosift.plans.driver_views import (
    CLASSES,
    ROW_KEY,
    SUBCLUSTERS_SQL,
    grid_table,
    grids_sql,
    subclusters,
)
from halosift.plans.feature_queries import _bin_sql, _rounded
from halosift.plans.registry import query
from halosift.plans.sampling_queries import BALANCED_ROWS_SQL, ranked_sql
from halosift.plans.selection_queries import (
    CLEAN,
    class_from_sql,
    flow_sql,
    summary_sql,
)
from halosift.session import pin
from halosift.sources.runs import RunStore

# --- scoring with parameters made by a rule --------------------------------------------

RULE_SQL = "((({k}) * 37) % 101 - 50) / 250.0::DOUBLE"


def rule_params(net: Net) -> np.ndarray:
    return (np.arange(net.n_params) * 37 % 101 - 50) / 250.0


def layer_sql(layer: Layer, source: str, relu: bool = True) -> str:
    """A valid convolution of a flat list as nested list functions."""
    (kh, kw), f = layer.kernel, layer.filters
    (h, w, c), (oh, ow, _) = layer.in_shape, layer.out_shape
    weight = RULE_SQL.format(k=f"{layer.start} + s * {f} + o % {f}")
    bias = RULE_SQL.format(k=f"{layer.start + layer.n_weights} + o % {f}")
    at = (
        f"((o // {f * ow} + s // {c * kw}) * {w} + (o // {f}) % {ow} + (s // {c}) % {kw}) * {c} + s % {c} + 1"
    )
    total = f"list_sum(list_transform(range(0, {kh * kw * c}), lambda s: {source}[{at}] * {weight})) + {bias}"
    value = f"greatest(0, {total})" if relu else total
    return f"list_transform(range(0, {oh * ow * f}), lambda o: {value})"


def net_sql(net: Net, source: str) -> str:
    """CTEs from ``source`` (key columns, x) to ``predicted`` (..., p); ``a0``.. are
    the layer outputs of the first branch."""
    ctes, before, ends = [], source, []
    for b, layers in enumerate(net.branch_layers):
        column = "x"
        for n, layer in enumerate(layers):
            name = f"b{b}_{n}"
            ctes.append(f"{name} AS MATERIALIZED (SELECT *, {layer_sql(layer, column)} AS {name}_out FROM {before})")
            before, column = name, f"{name}_out"
        ends.append(column)
    joined = ends[0] if len(ends) == 1 else f"list_concat({', '.join(ends)})"
    ctes.append(f"joined AS (SELECT *, {joined} AS d FROM {before})")
    before, column = "joined", "d"
    for n, layer in enumerate(net.dense_layers):
        last = n == len(net.dense_layers) - 1
        ctes.append(
            f"d{n} AS MATERIALIZED (SELECT *, {layer_sql(layer, column, relu=not last)} AS d{n}_out FROM {before})"
        )
        before, column = f"d{n}", f"d{n}_out"
    ctes.append(
        f"raised AS (SELECT *, list_transform({column}, lambda z: exp(z - list_max({column}))) AS e FROM {before})"
    )
    ctes.append("predicted AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM raised)")
    return ", ".join(ctes)


def _probabilities(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(F.col("p")[k], 6).alias(f"p{k + 1}") for k in range(3)])


P_OUT = ", ".join(f"round(p[{k}], 6) AS p{k}" for k in (1, 2, 3))

DENSE = dense_net(5, 3, (4, 3))
DENSE_X = ["eta_sig / 50", "phi_sig / 100000", "etaphi_cov", "timeeta_cov", "energy / 100000"]
_dense_source = (
    f'inputs AS (SELECT event, "object", tower, crystal, [{", ".join(DENSE_X)}] AS x FROM subclusters)'
)


@query(
    f"""WITH {SUBCLUSTERS_SQL}, {_dense_source}, {net_sql(DENSE, "inputs")}
SELECT event, "object", tower, crystal, {P_OUT} FROM predicted"""
)
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = subclusters(spark, sf_dir).select(*ROW_KEY, F.expr(f"array({', '.join(DENSE_X)})").alias("x"))
    return _probabilities(scoring.score(df, DENSE, rule_params(DENSE)), *ROW_KEY)


def _inputs_sql(channels: str) -> str:
    """Images of the unscaled channels, channel varying fastest."""
    value = ", ".join(f"{c}[k]" for c in channels)
    return (
        f"inputs AS (SELECT event, flatten(list_transform(range(1, 50), lambda k: [{value}])) AS x FROM grids)"
    )


def _images(spark: SparkSession, sf_dir: str, *channels: str) -> DataFrame:
    spec = GridSpec(channels=channels)
    return build_images(grid_table(spark, sf_dir), spec, ["event", "label"], scale=False).df


CONV = grid_net("small3", (7, 7, 3), 3)


@query(
    f"""WITH {grids_sql()}, {_inputs_sql("etr")}, {net_sql(CONV, "inputs")}
SELECT event, {P_OUT} FROM predicted"""
)
def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _images(spark, sf_dir, "E", "t", "r")
    return _probabilities(scoring.score(df, CONV, rule_params(CONV)), "event")


DUAL = grid_net("dual", (7, 7, 1), 3)


@query(
    f"""WITH {grids_sql()}, {_inputs_sql("e")}, {net_sql(DUAL, "inputs")}
SELECT event, {P_OUT} FROM predicted"""
)
def dual_grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(scoring.score(_images(spark, sf_dir, "E"), DUAL, rule_params(DUAL)), "event")


def _activation_sql(layer: Layer, name: str) -> str:
    _, w, f = layer.out_shape
    size = layer.out_shape[0] * w * f
    return f"""SELECT event, '{layer.name}' AS layer, CAST(o % {f} AS INT) AS kernel,
       CAST(o // {f * w} AS INT) AS i, CAST((o // {f}) % {w} AS INT) AS j, round(v, 6) AS value
FROM (SELECT event, unnest(range(0, {size})) AS o, unnest({name}_out) AS v FROM {name})"""


@query(
    f"""WITH {grids_sql()}, {_inputs_sql("etr")}, {net_sql(CONV, "inputs")} """
    + " UNION ALL ".join(
        _activation_sql(layer, f"b0_{n}") for n, layer in enumerate(CONV.branch_layers[0][:2])
    )
)
def layer_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature maps of every layer with more than one pixel, for all images."""
    df = _images(spark, sf_dir, "E", "t", "r")
    first, second = [
        scoring.activations(df, CONV, rule_params(CONV), layer, ["event"])
        for layer in scoring.conv_layers(CONV)
    ]
    return _rounded(first.unionByName(second), "value")


@query(
    f"""WITH {grids_sql()}, picked AS ({ranked_sql("grids", "event", 43)}),
chosen AS (SELECT * FROM picked WHERE place = 1),
{_inputs_sql("etr").replace("FROM grids", "FROM chosen")}, {net_sql(CONV, "inputs")} """
    + _activation_sql(CONV.branch_layers[0][0], "b0_0")
)
def one_row_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = sampling.take_random(_images(spark, sf_dir, "E", "t", "r"), 1, 43, ["event"])
    return _rounded(scoring.activations(one, CONV, rule_params(CONV), "conv0", ["event"]), "value")


# --- training --------------------------------------------------------------------------

EPOCHS, SHARDS = 3, 4


def _run_id(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex[:8]}"


def _how(spark: SparkSession, name: str, epochs: int = EPOCHS) -> flows.Training:
    return flows.Training(RunStore(spark), _run_id(name), epochs, shards=SHARDS)


def _trained(spark: SparkSession, df: DataFrame, net: Net, name: str) -> Trained:
    fit, held = sampling.fit_validation(sampling.train_test(df, ["event"])[0], ["event"])
    return train(
        pin_shards(fit, CLASSES, SHARDS, ["event"]), pin_shards(held, CLASSES, SHARDS, ["event"]),
        net, RunStore(spark), _run_id(name), EPOCHS,
    )


def _scaled_images(spark: SparkSession, sf_dir: str, *channels: str) -> DataFrame:
    spec = GridSpec(channels=channels)
    return pin(build_images(grid_table(spark, sf_dir), spec, ["event", "label"]).df)


def _shown_history(model: Trained, name: str) -> DataFrame:
    return model.store.history(model.run).select(
        F.lit(name).alias("run"), "epoch", "metric",
        F.round("train", 6).alias("train"), F.round("val", 6).alias("val"),
    )


@query()
def train_grid_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of a convolution net on three-channel images."""
    model = _trained(spark, _scaled_images(spark, sf_dir, "E", "t", "r"), CONV, "grid")
    return _shown_history(model, "grid")


@query()
def train_dual_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _trained(spark, _scaled_images(spark, sf_dir, "E"), DUAL, "dual")
    return _shown_history(model, "dual")


@query()
def training_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improving checkpoints of a run, their size and whether each is the best."""
    model = _trained(spark, _scaled_images(spark, sf_dir, "E"), grid_net("xsmall3", (7, 7, 1), 3), "best")
    saved = model.store.checkpoints(model.run)
    lowest = F.min("val_loss").over(Window.partitionBy("run"))
    return saved.select(
        "epoch", F.round("val_loss", 6).alias("val_loss"), F.size("params").alias("n_params"),
        (F.col("val_loss") == lowest).alias("is_best"),
    )


# --- synchronous training --------------------------------------------------------------

LINEAR = dense_net(5, 3, ())
LINEAR_EPOCHS, LINEAR_BATCHES = 2, 2


def _linear_step_sql(step: int) -> str:
    """One Adam step of a net without hidden layers, over one batch, from the step before."""
    return f"""z{step} AS (SELECT x, y, list_transform([0, 1, 2], lambda j: list_sum(list_transform(range(0, 5), lambda i: x[i + 1] * w[i * 3 + j + 1])) + w[16 + j]) AS z
  FROM numbered, sizes, (SELECT list(p ORDER BY k) AS w FROM p{step - 1}) WHERE position // size = {(step - 1) % LINEAR_BATCHES}),
e{step} AS (SELECT x, y, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z{step}),
d{step} AS (SELECT x, list_transform([0, 1, 2], lambda j: e[j + 1] / list_sum(e) - CASE WHEN y = j THEN 1 ELSE 0 END) AS d FROM e{step}),
g{step} AS (SELECT k, avg(d[k % 3 + 1] * CASE WHEN k < 15 THEN x[k // 3 + 1] ELSE 1 END) AS g FROM d{step}, range(0, {LINEAR.n_params}) t(k) GROUP BY k),
m{step} AS (SELECT k, p, m + 0.1::DOUBLE * (g - m) AS m, v + 0.001::DOUBLE * (g * g - v) AS v FROM p{step - 1} JOIN g{step} USING (k)),
p{step} AS MATERIALIZED (SELECT k, m, v, p - 0.001::DOUBLE * sqrt(1 - pow(0.999::DOUBLE, {step})) / (1 - pow(0.9::DOUBLE, {step})) * m / (sqrt(v) + 0.0000001::DOUBLE) AS p FROM m{step})"""


@query(
    f"""WITH {SUBCLUSTERS_SQL},
numbered AS (SELECT [{", ".join(DENSE_X)}] AS x, label - 1 AS y,
  row_number() OVER (ORDER BY md5(concat_ws('|', '47', event, "object", tower, crystal))) - 1 AS position
  FROM subclusters WHERE label IN (1, 2, 3) AND crystal % 5 > 0),
sizes AS (SELECT (count(*) + {LINEAR_BATCHES - 1}) // {LINEAR_BATCHES} AS size FROM numbered),
p0 AS (SELECT k, {RULE_SQL.format(k="k")} AS p, 0::DOUBLE AS m, 0::DOUBLE AS v FROM range(0, {LINEAR.n_params}) t(k)),
"""
    + ",\n".join(_linear_step_sql(n) for n in range(1, LINEAR_EPOCHS * LINEAR_BATCHES + 1))
    + f" SELECT CAST(k AS INT) AS k, round(p, 8) AS value FROM p{LINEAR_EPOCHS * LINEAR_BATCHES}"
)
def synchronous_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a net without hidden layers after four steps, two batches an epoch, on two shards."""
    rows = subclusters(spark, sf_dir).filter("label IN (1, 2, 3)").select(
        *ROW_KEY, "label", F.expr(f"array({', '.join(DENSE_X)})").alias("x"))
    dealt = numbered_rows(rows.filter("crystal % 5 > 0"), rows.filter("crystal % 5 = 0"), CLASSES, 2, ROW_KEY)
    size = -(-dealt.filter(~F.col("held")).count() // LINEAR_BATCHES)
    store, run = RunStore(spark), _run_id("linear")
    fit(dealt, [Model(run, LINEAR, LINEAR_EPOCHS, start=tuple(rule_params(LINEAR)))], store, 2, shuffle=False, batch_rows=size)
    last = store.states(run).filter(f"epoch = {LINEAR_EPOCHS}")
    return last.select(F.posexplode("vector").alias("k", "value")).filter(f"k < {LINEAR.n_params}").select("k", F.round("value", 8).alias("value"))


# --- attribution -----------------------------------------------------------------------


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute attribution of 500 rows against 100 background rows."""
    df = subclusters(spark, sf_dir).select(
        F.concat_ws("-", *ROW_KEY).alias("key"), F.expr(f"array({', '.join(DENSE_X)})").alias("x")
    )
    values = attribution.explain_sample(df, DENSE, rule_params(DENSE), "key")
    names = ["eta_sig", "phi_sig", "etaphi_cov", "timeeta_cov", "energy"]
    return _rounded(attribution.importance(values, names), "importance")


def _sums_sql() -> str:
    """The first class's probability minus its mean over the background rows."""
    own = f"""keyed AS (SELECT *, concat_ws('-', event, "object", tower, crystal) AS key FROM predicted),
drawn AS ({ranked_sql("(SELECT key, p[1] AS p FROM keyed)", "key", 43)}),
explained AS ({ranked_sql("(SELECT key, p[1] AS p FROM keyed)", "key", 44)})"""
    return f"""WITH {SUBCLUSTERS_SQL}, {_dense_source}, {net_sql(DENSE, "inputs")}, {own}
SELECT key, round(p - (SELECT avg(p) FROM drawn WHERE place <= 100), 6) AS total FROM explained WHERE place <= 500"""


@query(_sums_sql())
def attribution_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of an explained row add up to its probability minus that of the background."""
    df = subclusters(spark, sf_dir).select(
        F.concat_ws("-", *ROW_KEY).alias("key"), F.expr(f"array({', '.join(DENSE_X)})").alias("x")
    )
    values = attribution.explain_sample(df, DENSE, rule_params(DENSE), "key")
    return values.groupBy("key").agg(F.round(F.sum("value"), 6).alias("total"))


@query(_sums_sql())
def multiplier_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DeepLIFT attributions of an explained row add up to the same."""
    df = subclusters(spark, sf_dir).select(
        F.concat_ws("-", *ROW_KEY).alias("key"), F.expr(f"array({', '.join(DENSE_X)})").alias("x")
    )
    values = attribution.explain_sample(df, DENSE, rule_params(DENSE), "key", multipliers=True)
    return values.groupBy("key").agg(F.round(F.sum("value"), 6).alias("total"))


def _multipliers_sql() -> str:
    """DeepLIFT of the first class for a net without hidden layers, for each explained and background row."""
    ratio = "CASE WHEN abs(z[j] - f[j]) < 0.0000001 THEN exp(z[j] - top) ELSE (exp(z[j] - top) - exp(f[j] - top)) / (z[j] - f[j]) END"
    return f"""WITH {SUBCLUSTERS_SQL}, {_dense_source},
keyed AS (SELECT x, concat_ws('-', event, "object", tower, crystal) AS key FROM inputs),
lin AS (SELECT key, x, list_transform([0, 1, 2], lambda j: list_sum(list_transform(range(0, 5), lambda i: x[i + 1] * {RULE_SQL.format(k="i * 3 + j")})) + {RULE_SQL.format(k="15 + j")}) AS z FROM keyed),
drawn AS (SELECT * FROM ({ranked_sql("lin", "key", 43)}) WHERE place <= 100),
explained AS (SELECT * FROM ({ranked_sql("lin", "key", 44)}) WHERE place <= 500),
pairs AS (SELECT e.key, e.x, e.z, d.x AS b, d.z AS f, greatest(list_max(e.z), list_max(d.z)) AS top FROM explained e, drawn d),
sums AS (SELECT *, list_sum(list_transform(z, lambda v: exp(v - top))) AS s, list_sum(list_transform(f, lambda v: exp(v - top))) AS t FROM pairs),
parts AS (SELECT *, list_transform([1, 2, 3], lambda j: (CASE WHEN j = 1 THEN (1 / s + 1 / t) / 2 ELSE 0 END
  - (exp(z[1] - top) + exp(f[1] - top)) / (2 * s * t)) * ({ratio})) AS m FROM sums),
each AS (SELECT key, unnest(range(0, 5)) AS i, x, b, m FROM parts)
SELECT key, CAST(i AS INT) AS feature, round(avg((x[i + 1] - b[i + 1]) * list_sum(list_transform([0, 1, 2], lambda j: m[j + 1] * {RULE_SQL.format(k="i * 3 + j")}))), 8) AS value
FROM each GROUP BY key, i"""


@query(_multipliers_sql())
def linear_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DeepLIFT attributions of 500 rows against 100 background rows, for a net without hidden layers."""
    df = subclusters(spark, sf_dir).select(
        F.concat_ws("-", *ROW_KEY).alias("key"), F.expr(f"array({', '.join(DENSE_X)})").alias("x")
    )
    return _rounded(attribution.explain_sample(df, LINEAR, rule_params(LINEAR), "key", multipliers=True), "value", digits=8)


# --- flows -----------------------------------------------------------------------------

_GRID_KEPT = f"{CLEAN} AND {class_from_sql(1, 'EGamma')} AND subcl IS NOT DISTINCT FROM 0"
_GRID_BALANCED = f"""{grids_sql(unmatched=True)},
kept AS (SELECT * FROM grids WHERE {_GRID_KEPT} AND label IN (1, 2, 3)),
ranked AS ({ranked_sql("kept", "event", 111, "label")}),
balanced AS (SELECT * EXCLUDE (place, size) FROM ranked WHERE place <= (SELECT min(size) FROM ranked))"""


def _stage_sql(number: int, name: str, source: str, classes: dict, samples: bool = True) -> str:
    return f"SELECT {number} AS stage, '{name}' AS cut, * FROM ({summary_sql(source, classes, samples)})"


_c2 = f"{CLEAN} AND {class_from_sql(1, 'EGamma')}"


@query(
    f"WITH {_GRID_BALANCED} "
    + " UNION ALL ".join(
        _stage_sql(n, name, source, stats.DETECTOR_CLASSES)
        for n, (name, source) in enumerate([
            ("input", "grids"),
            ("matched", "(SELECT * FROM grids WHERE label IS DISTINCT FROM -1)"),
            ("no signal-sample background", f"(SELECT * FROM grids WHERE {CLEAN})"),
            ("class 1 from EGamma", f"(SELECT * FROM grids WHERE {_c2})"),
            ("leading", f"(SELECT * FROM grids WHERE {_GRID_KEPT})"),
            ("balanced", "balanced"),
        ])
    )
)
def grid_flow_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = flows.grid_flow(grid_table(spark, sf_dir, unmatched=True), ["event"], dry_run=True)
    return flow["cut_flow"]


@query(
    f"""WITH {_GRID_BALANCED},
images AS (SELECT event, label, list_transform(range(1, 50), lambda k: e[k] * r[k]) AS er FROM balanced),
bounds AS (SELECT min(list_min(er)) AS lo, max(list_max(er)) AS hi FROM images),
split AS ({ranked_sql("images", "event", 43)}),
pixels AS (SELECT label, unnest(range(0, 49)) AS k, unnest(er) AS v FROM split WHERE place > (size + 4) // 5),
sums AS (SELECT label, CAST(k // 7 - 3 AS INT) AS i, CAST(k % 7 - 3 AS INT) AS j,
                sum((v - lo) / (hi - lo)) AS s FROM pixels, bounds GROUP BY ALL)
SELECT label, 'Er' AS channel, i, j, round(s / sum(s) OVER (PARTITION BY label), 8) AS value FROM sums"""
)
def grid_flow_input_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = flows.grid_flow(grid_table(spark, sf_dir, unmatched=True), ["event"], dry_run=True)
    return _rounded(flow["input_maps"], "value", digits=8)


@query(
    f"""WITH {grids_sql(unmatched=True)},
images AS (SELECT event, label, list_transform(range(1, 50), lambda k: e[k] * r[k]) AS er
           FROM grids WHERE {_c2} AND subcl IS DISTINCT FROM 0),
bounds AS (SELECT min(list_min(er)) AS lo, max(list_max(er)) AS hi FROM images),
split AS ({ranked_sql("images", "event", 43)}),
pixels AS (SELECT label, unnest(range(0, 49)) AS k, unnest(er) AS v FROM split WHERE place > (size + 4) // 5),
sums AS (SELECT label, CAST(k // 7 - 3 AS INT) AS i, CAST(k % 7 - 3 AS INT) AS j,
                sum((v - lo) / (hi - lo)) AS s FROM pixels, bounds GROUP BY ALL)
SELECT label, 'Er' AS channel, i, j, round(s / sum(s) OVER (PARTITION BY label), 8) AS value FROM sums"""
)
def grid_flow_subleading_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = flows.grid_flow(grid_table(spark, sf_dir, unmatched=True), ["event"], arch="sublead")
    return _rounded(flow["input_maps"], "value", digits=8)


@query()
def grid_flow_working_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid flow end to end: cuts, balance, images, training, scoring, curves."""
    flow = flows.grid_flow(
        grid_table(spark, sf_dir, unmatched=True), ["event"], training=_how(spark, "grid-flow")
    )
    return _rounded(flow["working_points"], "fpr", "miss", "threshold")


@query(
    f"WITH {SUBCLUSTERS_SQL}, {BALANCED_ROWS_SQL} "
    + " UNION ALL ".join(
        _stage_sql(n, name, source, stats.DETECTOR_CLASSES, samples=False)
        for n, (name, source) in enumerate([
            ("input", "subclusters"),
            ("matched", "(SELECT * FROM subclusters WHERE label IS DISTINCT FROM -1)"),
            ("no signal-sample background", f"(SELECT * FROM subclusters WHERE {CLEAN})"),
            ("balanced", "balanced"),
        ])
    )
)
def dense_flow_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.dense_flow(subclusters(spark, sf_dir), ROW_KEY, even=True, dry_run=True)["cut_flow"]


_FLOW_FEATURES = ["eta_sig", "phi_sig", "etaphi_cov", "timeeta_cov", "sw+", "energy"]
_train_long = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, label, \"{c}\" AS value FROM train_rows" for c in _FLOW_FEATURES
)


@query(
    f"""WITH {SUBCLUSTERS_SQL}, {BALANCED_ROWS_SQL},
split AS ({ranked_sql("(SELECT * EXCLUDE (place, size) FROM balanced)", 'event, "object", tower, crystal', 43)}),
train_rows AS (SELECT * FROM split WHERE place > (size + 4) // 5),
long AS ({_train_long}),
raw AS (SELECT feature, label, min(value) AS lo, max(value) AS hi FROM long GROUP BY ALL),
placed AS (SELECT feature, label, {_bin_sql("value")} AS bin FROM long JOIN raw USING (feature, label)),
counts AS (SELECT feature, label, bin, count(*) AS n FROM placed GROUP BY ALL),
bins AS (SELECT feature, label, CAST(unnest(range(0, 50)) AS INT) AS bin FROM raw)
SELECT feature, label, bin, coalesce(n, 0) AS n FROM bins LEFT JOIN counts USING (feature, label, bin)"""
)
def dense_flow_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = flows.dense_flow(subclusters(spark, sf_dir), ROW_KEY, even=True)
    return flow["histograms"].select("feature", "label", "bin", "n")


_BENCHMARK_LEFT = f"""left_over AS (
  SELECT * REPLACE (CASE WHEN label = 2 THEN 1 ELSE label END AS label) FROM subclusters
  WHERE {CLEAN} AND R9 IS DISTINCT FROM -999 AND lead = 1),
split AS ({ranked_sql("left_over", 'event, "object", tower, crystal', 43)})"""


_closure_long = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, label, \"{c}\" AS value FROM train_rows" for c in _FLOW_FEATURES if c != "sw+"
)


@query(
    f"""WITH {SUBCLUSTERS_SQL}, {BALANCED_ROWS_SQL},
split AS ({ranked_sql("(SELECT * EXCLUDE (place, size) FROM balanced)", 'event, "object", tower, crystal', 43)}),
train_rows AS (SELECT * FROM split WHERE place > (size + 4) // 5),
long AS ({_closure_long}),
raw AS (SELECT feature, label, min(value) AS lo, max(value) AS hi FROM long GROUP BY ALL),
placed AS (SELECT feature, label, {_bin_sql("value")} AS bin FROM long JOIN raw USING (feature, label)),
counts AS (SELECT feature, label, bin, count(*) AS n FROM placed GROUP BY ALL),
bins AS (SELECT feature, label, CAST(unnest(range(0, 50)) AS INT) AS bin FROM raw)
SELECT feature, label, bin, coalesce(n, 0) AS n_true FROM bins LEFT JOIN counts USING (feature, label, bin)"""
)
def dense_flow_closure_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of the closure test that does not come out of training, from the whole flow."""
    flow = flows.dense_flow(
        subclusters(spark, sf_dir), ROW_KEY, exclude="sw+", even=True, training=_how(spark, "closure", 1)
    )
    return flow["closure"].select("feature", "label", "bin", F.col("true").alias("n_true"))


@query(f"""WITH {SUBCLUSTERS_SQL}, {_BENCHMARK_LEFT}
SELECT event, "object", tower, crystal, label FROM split WHERE place <= (size + 4) // 5""")
def benchmark_flow_scored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test row of the benchmark flow has a score, and no other row."""
    flow = flows.benchmark_flow(subclusters(spark, sf_dir), ROW_KEY, training=_how(spark, "keys", 1))
    return flow["scored"].filter("p IS NOT NULL").select(*ROW_KEY, "label")


@query("""SELECT CAST(e AS INT) AS epoch, m AS metric FROM range(1, 4) t(e), (VALUES ('loss'), ('accuracy'), ('auc')) v(m)
WHERE (SELECT count(*) FROM embeddings) > 0""")
def training_history_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of history for each epoch and metric."""
    model = _trained(spark, _scaled_images(spark, sf_dir, "E", "t", "r"), CONV, "history")
    return model.store.history(model.run).select("epoch", "metric")


@query()
def dense_flow_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense flow end to end on balanced rows, with its closure test."""
    flow = flows.dense_flow(
        subclusters(spark, sf_dir), ROW_KEY, exclude="sw+", even=True, training=_how(spark, "dense-flow"),
    )
    return _rounded(flow["closure"], "lo", "hi", "pred", "ratio", "ymax")


@query(flow_sql(
    [
        ("input", "true", "label"),
        ("matched", "label IS DISTINCT FROM -1", "label"),
        ("no signal-sample background", CLEAN, "label"),
        ("halo as background", CLEAN, "(CASE WHEN label = 2 THEN 1 ELSE label END)"),
        ("object selection", f"{CLEAN} AND R9 IS DISTINCT FROM -999",
         "(CASE WHEN label = 2 THEN 1 ELSE label END)"),
        ("leading photon", f"{CLEAN} AND R9 IS DISTINCT FROM -999 AND lead = 1",
         "(CASE WHEN label = 2 THEN 1 ELSE label END)"),
    ],
    stats.BENCHMARK_CLASSES,
))
def benchmark_flow_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.benchmark_flow(subclusters(spark, sf_dir), ROW_KEY, dry_run=True)["cut_flow"]


@query(f"""WITH {SUBCLUSTERS_SQL}, {_BENCHMARK_LEFT}
SELECT label, CASE WHEN place <= (size + 4) // 5 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM split GROUP BY ALL""")
def benchmark_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that the cuts leave, by label and part: nothing is lost before training."""
    return flows.benchmark_flow(subclusters(spark, sf_dir), ROW_KEY)["rows"]


@query()
def benchmark_flow_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark flow end to end, ending in the signal-vs-rest curve."""
    flow = flows.benchmark_flow(
        subclusters(spark, sf_dir), ROW_KEY, training=_how(spark, "benchmark")
    )
    return _rounded(flow["curve"], "threshold", "fpr", "tpr", "miss")


@query()
def benchmark_full_training_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default feature set with its own length of training: 500 epochs of batches of 100 rows, with early stop."""
    how = flows.benchmark_training(RunStore(spark), "default", uuid.uuid4().hex[:8], shards=1, synchronous=True)
    return _rounded(flows.benchmark_flow(subclusters(spark, sf_dir), ROW_KEY, training=how)["area"], "auc")


@query()
def benchmark_set_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six feature sets trained together, shortened to three epochs each."""
    store = RunStore(spark)
    sets = {s: flows.Training(store, _run_id(s), EPOCHS, shards=1) for s in flows.BENCHMARK_EPOCHS if s != "fourFeature"}
    return _rounded(flows.benchmark_sets(subclusters(spark, sf_dir), ROW_KEY, sets)["areas"], "auc")


@query()
def four_feature_flow_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = flows.benchmark_flow(
        subclusters(spark, sf_dir), ROW_KEY, "fourFeature", training=_how(spark, "four")
    )
    return _rounded(flow["area"], "auc")


@query(
    f"WITH {SUBCLUSTERS_SQL} "
    + summary_sql(f"(SELECT * FROM subclusters WHERE {CLEAN})", stats.BENCHMARK_CLASSES, samples=False)
)
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.label_report(subclusters(spark, sf_dir))


@query(
    f"WITH {SUBCLUSTERS_SQL} "
    + summary_sql(f"(SELECT * FROM subclusters WHERE {CLEAN})", stats.DETECTOR_CLASSES, False, "sample")
)
def process_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.by_process(subclusters(spark, sf_dir))
