"""Scaling, encodings and image grids over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halosift.functions import grids, labels, scaling
from halosift.operators import cuts, histograms, maps, stats
from halosift.plans.driver_views import (
    CLASSES,
    ROW_KEY,
    SCORED_SQL,
    SUBCLUSTERS_SQL,
    grid_table,
    grids_sql,
    scored,
    subclusters,
    table,
)
from halosift.plans.registry import query
from halosift.sources.catalogue import FEATURE_SETS, LABEL_NAMES, quoted

FEATURES = ["eta_sig", "phi_sig", "etaphi_cov", "timeeta_cov", "energy"]
DETECTOR = FEATURE_SETS["detector"]


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(quoted(c), digits).alias(c) if c in columns else F.col(quoted(c)) for c in df.columns
    ])


# --- strings and labels ----------------------------------------------------------------


@query(
    f"""WITH {SUBCLUSTERS_SQL} SELECT sample, coalesce(sample LIKE '%GMSB%', false) AS has_text,
        coalesce(regexp_matches(sample, '^(QCD|GJets)_HT'), false) AS has_pattern, count(*) AS n
        FROM subclusters GROUP BY sample"""
)
def sample_text_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("sample")
    return subclusters(spark, sf_dir).groupBy("sample").agg(F.count(F.lit(1)).alias("n")).select(
        "sample",
        F.coalesce(name.contains("GMSB"), F.lit(False)).alias("has_text"),
        F.coalesce(name.rlike("^(QCD|GJets)_HT"), F.lit(False)).alias("has_pattern"),
        "n",
    )


@query(
    f"""WITH {SUBCLUSTERS_SQL} SELECT event, "object", tower, crystal,
        [CAST(label = 1 AS INT), CAST(label = 2 AS INT), CAST(label = 3 AS INT)]::VARCHAR AS encoded,
        label AS decoded,
        CASE label WHEN 1 THEN 'physicsBkg' WHEN 2 THEN 'beamHalo' ELSE 'spike' END AS name
        FROM subclusters WHERE label IN (1, 2, 3)"""
)
def one_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cuts.select_classes(subclusters(spark, sf_dir), *CLASSES)
    hot = df.withColumn("hot", labels.one_hot(F.col("label"), CLASSES))
    return hot.select(
        *ROW_KEY,
        F.col("hot").cast("string").alias("encoded"),
        labels.from_one_hot(F.col("hot"), CLASSES).cast("bigint").alias("decoded"),
        labels.label_name(F.col("label"), LABEL_NAMES).alias("name"),
    )


@query(f"WITH {SCORED_SQL} SELECT key, CAST(list_position(p, list_max(p)) AS BIGINT) AS predicted FROM scored")
def predicted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "key", labels.predicted_label(F.col("p"), CLASSES).cast("bigint").alias("predicted")
    )


@query(
    f"""WITH {SUBCLUSTERS_SQL}, c AS (SELECT DISTINCT label FROM subclusters WHERE label >= 0)
SELECT a.label AS cat1, b.label AS cat2 FROM c a JOIN c b ON a.label < b.label"""
)
def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.distinct_labels(subclusters(spark, sf_dir).filter("label >= 0"))
    first, second = found.select(F.col("label").alias("cat1")), found.select(F.col("label").alias("cat2"))
    return first.join(second, F.col("cat1") < F.col("cat2"))


# --- scaling ---------------------------------------------------------------------------


@query(
    f"WITH {SUBCLUSTERS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, min(\"{c}\") AS lo, max(\"{c}\") AS hi FROM subclusters" for c in DETECTOR
    )
)
def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.column_ranges(subclusters(spark, sf_dir), DETECTOR)


SCALED_SQL = f"""WITH {SUBCLUSTERS_SQL},
r AS (SELECT {", ".join(f'min("{c}") AS lo{i}, max("{c}") - min("{c}") AS w{i}' for i, c in enumerate(DETECTOR))}
      FROM subclusters)
"""


@query(
    SCALED_SQL
    + 'SELECT event, "object", tower, crystal, '
    + ", ".join(f'round(("{c}" - lo{i}) / w{i}, 6) AS "{c}"' for i, c in enumerate(DETECTOR))
    + " FROM subclusters, r"
)
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = subclusters(spark, sf_dir).select(*ROW_KEY, *map(quoted, DETECTOR))
    return _rounded(scaling.MinMax.fit(df, DETECTOR).scale(df), *DETECTOR)


@query(
    f"""WITH {SUBCLUSTERS_SQL} SELECT event, "object", tower, crystal,
        {", ".join(f'round("{c}", 4) AS "{c}"' for c in DETECTOR)} FROM subclusters"""
)
def min_max_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = subclusters(spark, sf_dir).select(*ROW_KEY, *map(quoted, DETECTOR))
    fitted = scaling.MinMax.fit(df, DETECTOR)
    return _rounded(fitted.unscale(fitted.scale(df)), *DETECTOR, digits=4)


# --- histograms ------------------------------------------------------------------------

LABELS = [0, 1, 2, 3]

_long = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, label, \"{c}\" AS value FROM subclusters WHERE label IN (0, 1, 2, 3)"
    for c in FEATURES
)


def _bin_sql(value: str) -> str:
    """Bin of a value from lo and hi; numpy's rule with its edge correction."""
    guess = f"least(49, CAST(floor(({value} - lo) / (hi - lo) * 50) AS INT))"
    edge = "(CASE WHEN {b} = 50 THEN hi ELSE {b} * ((hi - lo) / 50) + lo END)"
    low, high = edge.format(b=f"({guess})"), edge.format(b=f"({guess} + 1)")
    return (
        f"CASE WHEN {value} < {low} THEN {guess} - 1 "
        f"WHEN {value} >= {high} AND {guess} < 49 THEN {guess} + 1 ELSE {guess} END"
    )


def hist_sql(long_rows: str) -> str:
    return f"""long AS ({long_rows}),
raw AS (SELECT feature, label, min(value) AS a, max(value) AS b FROM long GROUP BY ALL),
ranges AS (SELECT feature, label, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo,
                  CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM raw),
placed AS (SELECT feature, label, {_bin_sql("value")} AS bin
           FROM long JOIN ranges USING (feature, label)),
counts AS (SELECT feature, label, bin, count(*) AS n FROM placed GROUP BY ALL),
bins AS (SELECT feature, label, lo, hi, CAST(unnest(range(0, 50)) AS INT) AS bin FROM ranges),
hist AS (
  SELECT feature, label, bin, bin * ((hi - lo) / 50) + lo AS lo,
         CASE WHEN bin = 49 THEN hi ELSE (bin + 1) * ((hi - lo) / 50) + lo END AS hi,
         coalesce(n, 0) AS n
  FROM bins LEFT JOIN counts USING (feature, label, bin))"""


@query(
    f"""WITH {SUBCLUSTERS_SQL}, {hist_sql(_long)}
SELECT feature, label, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM hist"""
)
def feature_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histograms.class_histograms(subclusters(spark, sf_dir), FEATURES, LABELS)
    return _rounded(out, "lo", "hi")


_scored_long = (
    "SELECT 'value' AS feature, label, value FROM scored "
    "UNION ALL SELECT 'user_id' AS feature, label, user_id AS value FROM scored"
)
PRED_SQL = f"""WITH {SCORED_SQL}, {hist_sql(_scored_long)},
weights AS (
  SELECT feature, value, p FROM (
    SELECT 'value' AS feature, value, p FROM scored
    UNION ALL SELECT 'user_id', user_id, p FROM scored)),
pred AS (
  SELECT feature, label, {_bin_sql("value")} AS bin, sum(p[label]) AS pred
  FROM weights JOIN ranges USING (feature) WHERE value BETWEEN lo AND hi GROUP BY ALL)
"""


@query(PRED_SQL + "SELECT feature, label, bin, round(pred, 6) AS pred FROM pred")
def predicted_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    ranges = histograms.class_ranges(df, ["value", "user_id"], CLASSES)
    out = histograms.predicted_histograms(df, ranges)
    return _rounded(out, "pred")


@query(
    PRED_SQL
    + """, both_sides AS (
  SELECT feature, label, bin, lo, hi, n, coalesce(pred, 0) AS pred
  FROM hist LEFT JOIN pred USING (feature, label, bin)),
tops AS (
  SELECT feature, label, max(n / CASE WHEN n = 0 OR pred = 0 THEN 1.0::DOUBLE ELSE pred END) AS ymax
  FROM both_sides GROUP BY ALL)
SELECT feature, label, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n AS "true", round(pred, 6) AS pred,
       round(CASE WHEN n = 0 OR pred = 0 THEN -1.0::DOUBLE ELSE pred / n END, 6) AS ratio,
       round(ymax, 6) AS ymax
FROM both_sides JOIN tops USING (feature, label)"""
)
def closure_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histograms.closure(scored(spark, sf_dir), ["value", "user_id"], CLASSES)
    return _rounded(out, "lo", "hi", "pred", "ratio", "ymax")


# --- images ----------------------------------------------------------------------------

IMAGE_KEEP = ["event", "label"]


def _image_rows(images: grids.Images) -> DataFrame:
    """One row per (event, i, j, channel)."""
    side, _, depth = images.shape
    names = F.array(*[F.lit(n) for n in images.names])
    at = F.col("at")
    half = side // 2
    return images.df.select(*IMAGE_KEEP, F.posexplode_outer("x").alias("at", "v")).select(
        *IMAGE_KEEP,
        F.element_at(names, (at % depth + 1).cast("int")).alias("channel"),
        (F.floor(at / (depth * side)).cast("int") - half).alias("i"),
        (F.floor(at / depth).cast("int") % side - half).alias("j"),
        F.round("v", 6).alias("v"),
    )


def _image_sql(channels: dict[str, str], views: str, scale: bool = True) -> str:
    """Long pixel rows of list columns, scaled by channel over the whole table."""
    long_rows = " UNION ALL ".join(
        f"SELECT event, label, '{name}' AS channel, unnest(range(0, 49)) AS k, unnest({expr}) AS v FROM images"
        for name, expr in channels.items()
    )
    value = "v"
    if scale:
        value = """CASE WHEN max(v) OVER w = min(v) OVER w THEN v - min(v) OVER w
                   ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END"""
    return f"""WITH {views}, long AS ({long_rows}),
pixels AS (SELECT event, label, channel, CAST(k // 7 - 3 AS INT) AS i, CAST(k % 7 - 3 AS INT) AS j,
                  {value} AS v FROM long WINDOW w AS (PARTITION BY channel))
"""


_plain = f"{grids_sql()}, images AS (SELECT * FROM grids)"
_IMAGE_OUT = "SELECT event, label, channel, i, j, round(v, 6) AS v FROM pixels"


@query(_image_sql({"E": "e", "t": "t", "r": "r"}, _plain) + _IMAGE_OUT)
def scaled_image_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image_rows(grids.build_images(grid_table(spark, sf_dir), grids.GridSpec(), IMAGE_KEEP))


@query(_image_sql({"E": "e", "r": "r"}, _plain, scale=False) + _IMAGE_OUT)
def chosen_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = grids.GridSpec(channels=("r", "E"))
    return _image_rows(grids.build_images(grid_table(spark, sf_dir), spec, IMAGE_KEEP, scale=False))


_product = "list_transform(range(1, 50), lambda k: {a}[k] * {b}[k])"


@query(
    _image_sql(
        {a + b: _product.format(a=a.lower(), b=b) for a, b in (("E", "r"), ("E", "t"), ("t", "r"))}, _plain
    )
    + _IMAGE_OUT
)
def channel_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = grids.GridSpec(products=(("E", "r"), ("E", "t"), ("t", "r")))
    return _image_rows(grids.build_images(grid_table(spark, sf_dir), spec, IMAGE_KEEP))


_normal = f"""{grids_sql(holes=True)},
summed AS (SELECT *, list_sum(list_filter(e, lambda v: v IS NOT NULL)) AS s FROM grids),
images AS (SELECT event, label,
                  list_transform(e, lambda v: CASE WHEN v IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE v / s END) AS e
           FROM summed)"""


@query(_image_sql({"E": "e"}, _normal, scale=False) + _IMAGE_OUT)
def normalised_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = grids.GridSpec(channels=("E",), normalize=("E",))
    df = grid_table(spark, sf_dir, holes=True)
    return _image_rows(grids.build_images(df, spec, IMAGE_KEEP, scale=False))


_normal_product = f"""{grids_sql(holes=True)},
summed AS (SELECT *, list_sum(list_filter(e, lambda v: v IS NOT NULL)) AS s FROM grids),
images AS (SELECT event, label, list_transform(range(1, 50),
                  lambda k: CASE WHEN e[k] IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE e[k] / s END * r[k]) AS er
           FROM summed)"""


@query(_image_sql({"Er": "er"}, _normal_product) + _IMAGE_OUT)
def normalised_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = grids.GridSpec(normalize=("E",), products=(("E", "r"),))
    return _image_rows(grids.build_images(grid_table(spark, sf_dir, holes=True), spec, IMAGE_KEEP))


@query(
    f"WITH {grids_sql()} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS channel, min(list_min({c.lower()})) AS lo, max(list_max({c.lower()})) AS hi FROM grids"
        for c in "Etr"
    )
)
def channel_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = grids.GridSpec()
    arrays, _ = grids.channel_arrays(grid_table(spark, sf_dir), spec)
    return grids.channel_ranges(arrays, spec.names)


_MAPS = """, sums AS (SELECT label, channel, i, j, sum(v) AS s FROM pixels GROUP BY ALL)
SELECT label, channel, i, j, round(s / sum(s) OVER (PARTITION BY label, channel), 8) AS value FROM sums"""


@query(_image_sql({"E": "e", "t": "t", "r": "r"}, _plain) + _MAPS)
def mean_input_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = grids.build_images(grid_table(spark, sf_dir), grids.GridSpec(), IMAGE_KEEP)
    return _rounded(maps.mean_maps(images), "value", digits=8)


_sub = f"{grids_sql()}, images AS (SELECT * FROM grids WHERE subcl IS DISTINCT FROM 0)"


@query(_image_sql({"E": "e", "t": "t", "r": "r"}, _sub) + _MAPS)
def subleading_input_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    subleading = cuts.split_leading(grid_table(spark, sf_dir))[1]
    images = grids.build_images(subleading, grids.GridSpec(), IMAGE_KEEP)
    return _rounded(maps.mean_maps(images), "value", digits=8)
