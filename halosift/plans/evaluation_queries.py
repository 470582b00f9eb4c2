"""ROC curves, areas, working points, accuracy and loss over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halosift.functions.labels import predicted_label
from halosift.operators import metrics, roc
from halosift.plans.driver_views import CLASSES, SCORED_SQL, scored, table
from halosift.plans.registry import query
from halosift.sources.runs import best_checkpoint as choose_best
from halosift.sources.runs import improved_epochs


def curve_sql(entries: str, by: str = "", collinear: bool = False) -> str:
    """CTEs from rows (by, score, positive) to the curve, with one global window."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    using = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    bend = "" if collinear else """
  WHERE before IS NULL OR after_pos IS NULL OR after_pos <> pos OR after_neg <> neg"""
    return f"""entries AS ({entries}),
steps AS (SELECT {keys}score, count(*) FILTER (WHERE positive) AS pos,
                 count(*) FILTER (WHERE NOT positive) AS neg FROM entries GROUP BY {keys}score),
run AS (
  SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
         lead(pos) OVER w AS after_pos, lead(neg) OVER w AS after_neg, lag(pos) OVER w AS before
  FROM steps WINDOW w AS ({part}ORDER BY score DESC)),
sizes AS (SELECT {keys}sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM steps {group}),
turns AS (SELECT {keys}score AS threshold, fp, tp FROM run{bend}
  UNION ALL SELECT {keys}CAST('inf' AS DOUBLE), 0, 0 FROM sizes),
curve AS (
  SELECT {keys}threshold, CAST(fp AS DOUBLE) / nullif(n, 0) AS fpr,
         CAST(tp AS DOUBLE) / nullif(p, 0) AS tpr, 1 - CAST(tp AS DOUBLE) / nullif(p, 0) AS miss
  FROM turns JOIN sizes {using})"""


def _rounded(curve: DataFrame) -> DataFrame:
    return curve.select(*[
        F.round(c, 9).alias(c) if c in ("fpr", "tpr", "miss", "threshold") else c for c in curve.columns
    ])


def _curve_out(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return (
        f"SELECT {keys}round(threshold, 9) AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, "
        "round(miss, 9) AS miss FROM curve"
    )


_one_rest = "SELECT p[{k}] AS score, label = {k} AS positive FROM scored"
_pair_entries = " UNION ALL ".join(
    f"SELECT {a} AS cat1, {b} AS cat2, {c} AS scored_by, p[{c}] AS score, label = {c} AS positive "
    f"FROM scored WHERE label IN ({a}, {b})"
    for a, b in ((1, 2), (1, 3), (2, 3))
    for c in (a, b)
)
PAIRS = "cat1, cat2, scored_by"


@query(f"WITH {SCORED_SQL}, {curve_sql(_one_rest.format(k=1))} " + _curve_out())
def binary_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal against the rest, without points that continue a straight line."""
    return _rounded(roc.roc_points(roc.against_rest(scored(spark, sf_dir), 1, CLASSES)))


@query(f"WITH {SCORED_SQL}, {curve_sql(_one_rest.format(k=1), collinear=True)} " + _curve_out())
def binary_curve_all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roc.against_rest(scored(spark, sf_dir), 1, CLASSES)
    return _rounded(roc.roc_points(rows, drop_collinear=False))


@query(f"WITH {SCORED_SQL}, {curve_sql(_one_rest.format(k=2))} " + _curve_out())
def class_against_rest_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(roc.roc_points(roc.against_rest(scored(spark, sf_dir), 2, CLASSES)))


_tied = "SELECT CAST(user_id % 7 AS DOUBLE) AS score, event_type = 'error' AS positive FROM events"


@query(f"WITH {curve_sql(_tied)} " + _curve_out())
def tied_score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct scores, each shared by a large part of the rows."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id % 7 AS DOUBLE) AS score", "event_type = 'error' AS positive"
    )
    return _rounded(roc.roc_points(rows))


@query(f"WITH {SCORED_SQL}, {curve_sql(_pair_entries, PAIRS)} " + _curve_out(PAIRS))
def pair_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(roc.pair_curves(scored(spark, sf_dir), CLASSES))


ZOOM = " WHERE fpr BETWEEN 0 AND 0.1 AND miss BETWEEN 0.01 AND 0.5"


@query(f"WITH {SCORED_SQL}, {curve_sql(_pair_entries, PAIRS)} " + _curve_out(PAIRS) + ZOOM)
def pair_curves_zoomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(roc.zoom(roc.pair_curves(scored(spark, sf_dir), CLASSES)))


@query(
    f"""WITH {SCORED_SQL}, {curve_sql(_one_rest.format(k=1))}
SELECT 'full' AS view, threshold, round(fpr, 9) AS fpr, round(miss, 9) AS miss FROM curve
UNION ALL SELECT 'zoom', threshold, round(fpr, 9), round(miss, 9) FROM curve {ZOOM}"""
)
def curve_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = roc.roc_points(roc.against_rest(scored(spark, sf_dir), 1, CLASSES))
    full = curve.withColumn("view", F.lit("full"))
    near = roc.zoom(curve).withColumn("view", F.lit("zoom"))
    return full.unionByName(near).select(
        "view", "threshold", F.round("fpr", 9).alias("fpr"), F.round("miss", 9).alias("miss")
    )


@query(
    f"""WITH {SCORED_SQL}, {curve_sql(_pair_entries, PAIRS)},
near AS (SELECT *, row_number() OVER (PARTITION BY cat1, cat2
           ORDER BY abs(miss - 0.01), threshold DESC) AS place FROM curve WHERE scored_by = cat1)
SELECT cat1, cat2, round(fpr, 9) AS fpr, round(miss, 9) AS miss, round(threshold, 9) AS threshold
FROM near WHERE place = 1"""
)
def working_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = roc.pair_curves(scored(spark, sf_dir), CLASSES, first_only=True)
    return _rounded(roc.working_points(curves))


AREA = """areas AS (
  SELECT *, lag(fpr, 1, 0) OVER w AS f0, lag(tpr, 1, 0) OVER w AS t0 FROM curve
  WINDOW w AS ({part}ORDER BY threshold DESC))
"""


@query(
    f"""WITH {SCORED_SQL}, {curve_sql(_pair_entries, PAIRS, collinear=True)},
{AREA.format(part=f"PARTITION BY {PAIRS} ")}
SELECT {PAIRS}, round(sum((fpr - f0) * (tpr + t0) / 2), 8) AS auc FROM areas GROUP BY {PAIRS}"""
)
def pair_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roc.pair_entries(scored(spark, sf_dir), CLASSES)
    return roc.auc(rows, roc.PAIR_KEYS).withColumn("auc", F.round("auc", 8))


_all_rest = " UNION ALL ".join(
    f'SELECT {k} AS "class", p[{k}] AS score, label = {k} AS positive FROM scored' for k in CLASSES
)


@query(
    f"""WITH {SCORED_SQL}, {curve_sql(_all_rest, '"class"', collinear=True)},
{AREA.format(part='PARTITION BY "class" ')}
SELECT "class", round(sum((fpr - f0) * (tpr + t0) / 2), 8) AS auc FROM areas GROUP BY "class\""""
)
def class_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roc.every_class_against_rest(scored(spark, sf_dir), CLASSES)
    return roc.auc(rows, ["class"]).withColumn("auc", F.round("auc", 8))


_micro = " UNION ALL ".join(_one_rest.format(k=k) for k in CLASSES)


@query(
    f"""WITH {SCORED_SQL}, {curve_sql(_micro, collinear=True)}, {AREA.format(part="")}
SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 8) AS auc FROM areas"""
)
def micro_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro_auc(scored(spark, sf_dir), CLASSES).withColumn("auc", F.round("auc", 8))


@query(
    f"""WITH {SCORED_SQL} SELECT count(*) AS n,
        round(avg(CASE WHEN list_position(p, list_max(p)) = label THEN 1 ELSE 0 END), 8) AS accuracy,
        round(avg(-ln(greatest(p[label], 1e-7))), 8) AS loss FROM scored"""
)
def accuracy_and_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.accuracy_and_loss(scored(spark, sf_dir), CLASSES)
    return out.select("n", F.round("accuracy", 8).alias("accuracy"), F.round("loss", 8).alias("loss"))


# --- scores with holes: no probabilities, one missing, or not a number ------------------

_HOLES_SQL = """holed AS (SELECT key, label,
  CASE WHEN key % 7 = 0 THEN NULL WHEN key % 11 = 0 THEN [NULL, p[2], p[3]]
       WHEN key % 13 = 0 THEN [p[1], 'NaN'::DOUBLE, p[3]] ELSE p END AS p,
  key % 7 <> 0 AND key % 11 <> 0 AND key % 13 <> 0 AS whole FROM scored)"""


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("double")
    key, p = F.col("key"), F.col("p")
    return scored(spark, sf_dir).withColumn(
        "p",
        F.when(key % 7 == 0, None)
        .when(key % 11 == 0, F.array(nothing, p[1], p[2]))
        .when(key % 13 == 0, F.array(p[0], F.lit(float("nan")), p[2]))
        .otherwise(p),
    )


@query(
    f"""WITH {SCORED_SQL}, {_HOLES_SQL} SELECT count(*) AS n, count(CASE WHEN whole THEN 1 END) AS n_scored,
        round(avg(CASE WHEN whole THEN CASE WHEN list_position(p, list_max(p)) = label THEN 1 ELSE 0 END END), 8) AS accuracy,
        round(avg(CASE WHEN whole THEN -ln(greatest(p[label], 1e-7)) END), 8) AS loss FROM holed"""
)
def accuracy_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.accuracy_and_loss(_holed(spark, sf_dir), CLASSES)
    return out.select("n", "n_scored", F.round("accuracy", 8).alias("accuracy"), F.round("loss", 8).alias("loss"))


@query(f"""WITH {SCORED_SQL}, {_HOLES_SQL}
SELECT key, CASE WHEN whole THEN CAST(list_position(p, list_max(p)) AS BIGINT) ELSE 0 END AS predicted FROM holed""")
def predicted_class_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 where there is no class."""
    predicted = F.coalesce(predicted_label(F.col("p"), CLASSES), F.lit(0)).cast("bigint")
    return _holed(spark, sf_dir).select("key", predicted.alias("predicted"))


# --- run tables: a run per event type, an epoch per user, the mean value as its loss ----

LOSSES_SQL = """losses AS (
  SELECT event_type AS run, CAST(user_id AS INT) AS epoch, round(avg(value), 6) AS val_loss
  FROM events GROUP BY event_type, user_id)"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("run"), F.col("user_id").cast("int").alias("epoch")
    ).agg(F.round(F.avg("value"), 6).alias("val_loss"))


@query(
    f"""WITH {LOSSES_SQL}, seen AS (
  SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM losses)
SELECT run, epoch, val_loss FROM seen WHERE val_loss < least(coalesce(best, 999), 999)"""
)
def improved_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improved_epochs(losses(spark, sf_dir))


@query(f"WITH {LOSSES_SQL} SELECT run, epoch, val_loss FROM losses ORDER BY val_loss, epoch LIMIT 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose_best(losses(spark, sf_dir))


@query(
    f"""WITH {LOSSES_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS place FROM losses)
SELECT run, epoch, val_loss FROM ranked WHERE place = 1"""
)
def best_checkpoint_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose_best(losses(spark, sf_dir), per_run=True)
