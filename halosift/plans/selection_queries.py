"""Sources, cuts and statistics over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halosift.operators import cuts, stats
from halosift.plans.driver_views import (
    ROW_KEY,
    SUBCLUSTERS_SQL,
    grid_table,
    grids_sql,
    subclusters,
)
from halosift.plans.registry import query
from halosift.session import shared_dir
from halosift.sources import tables
from halosift.sources.catalogue import FEATURE_SETS, quoted

SHOWN = ["sample", *ROW_KEY, "label"]
SHOWN_SQL = 'sample, event, "object", tower, crystal, label'

# The standard cleaning as SQL conditions.
MATCHED = "label IS DISTINCT FROM -1"
NOT_SIGNAL_BACKGROUND = "NOT (coalesce(sample LIKE '%GMSB%', false) AND label IS NOT DISTINCT FROM 1)"
CLEAN = f"{MATCHED} AND {NOT_SIGNAL_BACKGROUND}"


def class_from_sql(nclass: int, samp: str) -> str:
    return (
        f"NOT ((coalesce(regexp_matches(sample, '{samp}'), false) AND label IS DISTINCT FROM {nclass}) "
        f"OR (coalesce(NOT regexp_matches(sample, '{samp}'), false) AND label IS NOT DISTINCT FROM {nclass}))"
    )


def rows_where(condition: str, shown: str = SHOWN_SQL) -> str:
    return f"WITH {SUBCLUSTERS_SQL} SELECT {shown} FROM subclusters WHERE {condition}"


def summary_sql(
    source: str, classes: dict[str, int], samples: bool = True, by: str = "", label: str = "label"
) -> str:
    tests = {n: f"{label} = {c}" for n, c in classes.items()}
    if samples:
        tests.update(
            data="sample IN ('METPD', 'EGamma')",
            gjets="sample LIKE '%GJets%'",
            qcd="sample LIKE '%QCD%'",
            gmsb="sample LIKE '%GMSB%'",
        )
    counts = ", ".join(f"count(*) FILTER (WHERE {t}) AS n_{n}" for n, t in tests.items())
    parts = ", ".join(
        f"count(*) FILTER (WHERE {t}) / nullif(count(*), 0)::DOUBLE AS f_{n}" for n, t in tests.items()
    )
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"SELECT {head}count(*) AS total, {counts}, {parts} FROM {source}{tail}"


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN)


# --- sources ---------------------------------------------------------------------------

CSV_COLUMNS = ["sample", "event", "object", "subcl", "label", "R9", "eta_sig"]


def _written_csv(spark: SparkSession, sf_dir: str) -> list[str]:
    """The subclusters as two CSV sets: other column order, one column absent in
    the second, and missing values written as text."""
    base = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    df = subclusters(spark, sf_dir).select(*CSV_COLUMNS)
    mc = df.filter("sample like 'G%' or sample like 'Q%'").select(*CSV_COLUMNS)
    rest = df.filter("not coalesce(sample like 'G%' or sample like 'Q%', false)").select(
        "label", "event", "object", "subcl", "eta_sig", "sample"
    )
    for part, name, missing in ((mc, "background", "NA"), (rest, "data", "nan")):
        part.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in part.columns]) \
            .write.option("header", True).csv(f"{base}/{name}")
    return [f"{base}/background", f"{base}/data"]


CSV_SQL = f"""WITH {SUBCLUSTERS_SQL},
read_back AS (
  SELECT sample, event, "object", subcl, label, eta_sig,
         CASE WHEN sample LIKE 'G%' OR sample LIKE 'Q%' THEN R9 END AS R9
  FROM subclusters)
"""


@query(CSV_SQL + 'SELECT sample, event, "object", subcl, label, eta_sig, R9 FROM read_back')
def csv_append_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.read_csv(spark, _written_csv(spark, sf_dir))
    return df.select("sample", "event", "object", "subcl", "label", "eta_sig", "R9")


@query(CSV_SQL + 'SELECT sample, event, "object", subcl, label, eta_sig, R9 FROM read_back')
def csv_mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files by one glob over all layouts."""
    folder = _written_csv(spark, sf_dir)[0].rpartition("/")[0]
    df = tables.read_csv(spark, f"{folder}/*/*.csv")
    return df.select("sample", "event", "object", "subcl", "label", "eta_sig", "R9")


@query(
    CSV_SQL
    + """SELECT CASE WHEN sample LIKE 'G%' OR sample LIKE 'Q%' THEN 'background' ELSE 'data' END AS dataset,
         count(*) AS n, count(sample) AS n_sample, count(R9) AS n_r9,
         CAST(sum(event) AS BIGINT) AS event_sum
         FROM read_back GROUP BY 1"""
)
def csv_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    background, data = _written_csv(spark, sf_dir)
    df = tables.read_datasets(spark, {"background": [background], "data": [data]})
    return df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count("sample").alias("n_sample"),
        F.count("R9").alias("n_r9"), F.sum("event").alias("event_sum"),
    )


@query(rows_where("sample = 'METPD'"))
def parquet_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land as Parquet by sample, read one sample back with partition pruning."""
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    tables.land(subclusters(spark, sf_dir), path)
    return shown(tables.read_parquet(spark, path).filter("sample = 'METPD'"))


# --- cuts ------------------------------------------------------------------------------


@query(rows_where(MATCHED))
def drop_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.drop_unmatched(subclusters(spark, sf_dir)))


@query(rows_where(NOT_SIGNAL_BACKGROUND))
def drop_signal_sample_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.drop_signal_sample_background(subclusters(spark, sf_dir)))


@query(rows_where(CLEAN))
def clean_keep_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.clean(subclusters(spark, sf_dir)))


@query(rows_where(f"{CLEAN} AND sample IS NOT NULL"))
def clean_drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.clean(subclusters(spark, sf_dir), drop_incomplete=True))


@query(rows_where("subcl IS NOT DISTINCT FROM 0"))
def leading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.split_leading(subclusters(spark, sf_dir))[0])


@query(rows_where("subcl IS DISTINCT FROM 0"))
def subleading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.split_leading(subclusters(spark, sf_dir))[1])


def single_sql(keys: str) -> str:
    return f"""WITH {SUBCLUSTERS_SQL},
counted AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS siblings FROM subclusters)
SELECT {SHOWN_SQL} FROM counted
WHERE siblings = 1 OR event IS NULL OR event < 0 OR "object" IS NULL OR "object" < 0"""


@query(single_sql('sample, event, "object"'))
def single_subcluster_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.single_subcluster_only(subclusters(spark, sf_dir)))


@query(single_sql('event, "object"'))
def single_subcluster_parents_without_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.single_subcluster_only(subclusters(spark, sf_dir), ("event", "object")))


@query(rows_where(class_from_sql(1, "EGamma")))
def class_from_one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.select_class(subclusters(spark, sf_dir), 1, "EGamma"))


@query(rows_where("R9 IS DISTINCT FROM -999"))
def drop_sentinel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.drop_sentinel(subclusters(spark, sf_dir)))


@query(rows_where("lead = 1"))
def lead_photon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.lead_photons(subclusters(spark, sf_dir)))


@query(
    f"""WITH {SUBCLUSTERS_SQL} SELECT sample, event, "object", tower, crystal,
        CASE WHEN label = 2 THEN 1 ELSE label END AS label FROM subclusters"""
)
def relabel_halo_as_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.relabel(subclusters(spark, sf_dir), {2: 1}))


def _feature_query(name: str, exclude: str | None = None) -> None:
    cols = [c for c in FEATURE_SETS[name] if c != exclude]
    listed = ", ".join(f'"{c}"' for c in cols)
    sql = f'WITH {SUBCLUSTERS_SQL} SELECT sample, event, "object", subcl, {listed}, label FROM subclusters'

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cuts.select_features(subclusters(spark, sf_dir), name, exclude)

    query(sql, f"features_{name}" + ("_exclude_energy" if exclude else ""))(run)


for _name in FEATURE_SETS:
    _feature_query(_name)
_feature_query("detector", "energy")


@query(f"""WITH {SUBCLUSTERS_SQL} SELECT eta_sig, phi_sig, etaphi_cov, timeeta_cov FROM subclusters""")
def drop_identity_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.features_only(cuts.select_features(subclusters(spark, sf_dir), "fourFeature"))


GRID_COUNT_SQL = f"""WITH {grids_sql()},
pixels AS (
  SELECT label, 'E' AS channel, unnest(range(0, 49)) AS k, unnest(e) AS v FROM grids
  UNION ALL SELECT label, 't', unnest(range(0, 49)), unnest(t) FROM grids
  UNION ALL SELECT label, 'r', unnest(range(0, 49)), unnest(r) FROM grids)
SELECT 'CNNgrid_' || channel || '_cell' || (k // 7 - 3) || '_' || (k % 7 - 3) AS pixel,
       CAST(3 AS BIGINT) AS half_width, count(v) AS n, round(sum(v), 6) AS total
FROM pixels GROUP BY channel, k"""


@query(GRID_COUNT_SQL)
def grid_column_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel columns found by name, the half width from their number, and their sums."""
    df = grid_table(spark, sf_dir)
    cols, half = cuts.grid_columns(df)
    names = F.expr(f"array({', '.join(repr(c) for c in cols)})")
    pixels = df.select(F.posexplode_outer(F.expr(f"array({', '.join(map(quoted, cols))})")).alias("at", "v"))
    return pixels.groupBy("at").agg(F.count("v").alias("n"), F.sum("v").alias("total")).select(
        F.element_at(names, F.col("at") + 1).alias("pixel"),
        F.lit(half).cast("bigint").alias("half_width"),
        "n",
        F.round("total", 6).alias("total"),
    )


@query(rows_where("label IN (2, 3)"))
def two_class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.select_classes(subclusters(spark, sf_dir), 2, 3))


@query(rows_where(f"sample = 'METPD' AND {CLEAN}"))
def one_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cuts.clean(subclusters(spark, sf_dir)).filter("sample = 'METPD'"))


# --- statistics ------------------------------------------------------------------------

SLICE_SQL = (
    f"WITH {SUBCLUSTERS_SQL}, kept AS (SELECT * FROM subclusters WHERE {CLEAN} "
    f"AND {class_from_sql(1, 'EGamma')} AND subcl IS NOT DISTINCT FROM 0) "
)


@query(SLICE_SQL + summary_sql("kept", stats.DETECTOR_CLASSES))
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest, clean, class from one sample, leading rows, statistics: one scan, one aggregate."""
    df = cuts.select_class(cuts.clean(subclusters(spark, sf_dir)), 1, "EGamma")
    return stats.summary(cuts.split_leading(df)[0])


@query(f"WITH {SUBCLUSTERS_SQL} " + summary_sql("subclusters", stats.DETECTOR_CLASSES, samples=False))
def label_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(subclusters(spark, sf_dir), samples=False)


@query(f"WITH {SUBCLUSTERS_SQL} " + summary_sql("subclusters", {}))
def sample_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(subclusters(spark, sf_dir), classes={})


@query(f"WITH {SUBCLUSTERS_SQL} " + summary_sql("subclusters", stats.BENCHMARK_CLASSES))
def benchmark_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(subclusters(spark, sf_dir), stats.BENCHMARK_CLASSES)


@query(f"WITH {SUBCLUSTERS_SQL} " + summary_sql("subclusters", stats.DETECTOR_CLASSES, False, "sample"))
def fractions_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(subclusters(spark, sf_dir), samples=False, by=["sample"])


@query(f"WITH {SUBCLUSTERS_SQL} SELECT label, count(*) AS n FROM subclusters GROUP BY label")
def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_sizes(subclusters(spark, sf_dir))


@query(
    f"""WITH {SUBCLUSTERS_SQL} SELECT label, count(*) AS n FROM subclusters
        WHERE label IN (1, 2, 3) GROUP BY label ORDER BY n, label LIMIT 1"""
)
def smallest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.smallest_class(subclusters(spark, sf_dir), [1, 2, 3])


@query(f"WITH {SUBCLUSTERS_SQL} SELECT DISTINCT label FROM subclusters WHERE label IS NOT NULL")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_labels(subclusters(spark, sf_dir))


def flow_sql(stages: list[tuple[str, str, str]], classes: dict[str, int]) -> str:
    """Stages as (name, condition so far, label column)."""
    parts = [
        f"SELECT {n} AS stage, '{name}' AS cut, * FROM ("
        + summary_sql(f"(SELECT * FROM subclusters WHERE {where})", classes, label=label)
        + ")"
        for n, (name, where, label) in enumerate(stages)
    ]
    return f"WITH {SUBCLUSTERS_SQL} " + " UNION ALL ".join(parts)


DETECTOR_STEPS = [
    stats.Cut("matched", cuts.is_matched),
    stats.Cut("no signal-sample background", cuts.is_not_signal_sample_background),
    stats.Cut("class 1 from EGamma", lambda label: cuts.is_class_from(1, "EGamma", label)),
    stats.Cut("leading", lambda label: cuts.is_leading()),
]
_c3 = f"{CLEAN} AND {class_from_sql(1, 'EGamma')}"


@query(flow_sql(
    [
        ("input", "true", "label"),
        ("matched", MATCHED, "label"),
        ("no signal-sample background", CLEAN, "label"),
        ("class 1 from EGamma", _c3, "label"),
        ("leading", f"{_c3} AND subcl = 0", "label"),
    ],
    stats.DETECTOR_CLASSES,
))
def cut_flow_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cut_flow(subclusters(spark, sf_dir), DETECTOR_STEPS)


BENCHMARK_STEPS = [
    stats.Cut("matched", cuts.is_matched),
    stats.Cut("no signal-sample background", cuts.is_not_signal_sample_background),
    stats.Relabel("halo as background", {2: 1}),
    stats.Cut("object selection", lambda label: cuts.is_not_sentinel("R9")),
    stats.Cut("leading photon", lambda label: cuts.is_lead_photon()),
]
_merged = "(CASE WHEN label = 2 THEN 1 ELSE label END)"


@query(flow_sql(
    [
        ("input", "true", "label"),
        ("matched", MATCHED, "label"),
        ("no signal-sample background", CLEAN, "label"),
        ("halo as background", CLEAN, _merged),
        ("object selection", f"{CLEAN} AND R9 IS DISTINCT FROM -999", _merged),
        ("leading photon", f"{CLEAN} AND R9 IS DISTINCT FROM -999 AND lead = 1", _merged),
    ],
    stats.BENCHMARK_CLASSES,
))
def cut_flow_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cut_flow(subclusters(spark, sf_dir), BENCHMARK_STEPS, stats.BENCHMARK_CLASSES)


@query(f"""WITH {SUBCLUSTERS_SQL},
cleaned AS (SELECT *, count(*) OVER (PARTITION BY sample, event, "object") AS siblings
            FROM subclusters WHERE {CLEAN})
SELECT 0 AS stage, 'input' AS cut, * FROM ({summary_sql("subclusters", stats.DETECTOR_CLASSES)})
UNION ALL
SELECT 1, 'matched', * FROM ({summary_sql(f"(SELECT * FROM subclusters WHERE {MATCHED})", stats.DETECTOR_CLASSES)})
UNION ALL
SELECT 2, 'no signal-sample background', * FROM ({summary_sql("cleaned", stats.DETECTOR_CLASSES)})
UNION ALL
SELECT 3, 'single subcluster', * FROM ({summary_sql("(SELECT * FROM cleaned WHERE siblings = 1)", stats.DETECTOR_CLASSES)})
UNION ALL
SELECT 4, 'leading', * FROM ({summary_sql("(SELECT * FROM cleaned WHERE siblings = 1 AND subcl = 0)", stats.DETECTOR_CLASSES)})
""")
def cut_flow_with_group_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        *DETECTOR_STEPS[:2],
        stats.TableStep("single subcluster", cuts.single_subcluster_only),
        DETECTOR_STEPS[3],
    ]
    return stats.cut_flow(subclusters(spark, sf_dir), steps)
