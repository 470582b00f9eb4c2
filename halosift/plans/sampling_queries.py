"""Exact samples and splits over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halosift.operators import cuts, order, sampling, stats
from halosift.plans.driver_views import (
    ROW_KEY,
    SUBCLUSTERS_SQL,
    subclusters,
    table,
)
from halosift.plans.registry import query
from halosift.plans.selection_queries import CLEAN, SHOWN_SQL, flow_sql, shown

# Sorted classes of the event types; the label of the balanced event sample.
EVENT_LABELS_SQL = """labelled AS (
  SELECT event_id, user_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1
         WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS label
  FROM events)"""


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id",
        """CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1
           WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS label""",
    )


def ranked_sql(source: str, key: str, seed: int, partition: str = "") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return (
        f"SELECT *, row_number() OVER ({part}ORDER BY md5(concat_ws('|', '{seed}', {key}))) AS place, "
        f"count(*) OVER ({f'PARTITION BY {partition}' if partition else ''}) AS size FROM {source}"
    )


EVENT_KEY = ["event_id"]


@query(
    f"""WITH {EVENT_LABELS_SQL},
ranked AS ({ranked_sql("(SELECT * FROM labelled WHERE label IN (1, 2, 3))", "event_id", 111, "label")})
SELECT event_id, user_id, label FROM ranked WHERE place <= (SELECT min(size) FROM ranked)"""
)
def balanced_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balance_classes(labelled_events(spark, sf_dir), [1, 2, 3], EVENT_KEY)


BALANCED_ROWS_SQL = f"""kept AS (SELECT * FROM subclusters WHERE {CLEAN} AND label IN (1, 2, 3)),
ranked AS ({ranked_sql("kept", 'event, "object", tower, crystal', 111, "label")}),
balanced AS (SELECT * FROM ranked WHERE place <= (SELECT min(size) FROM ranked))"""


@query(f"WITH {SUBCLUSTERS_SQL}, {BALANCED_ROWS_SQL} SELECT {SHOWN_SQL} FROM balanced")
def balanced_subclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cuts.clean(subclusters(spark, sf_dir))
    return shown(sampling.balance_classes(df, [1, 2, 3], ROW_KEY))


@query(
    flow_sql([("input", "true", "label"), ("clean", CLEAN, "label")], stats.DETECTOR_CLASSES).replace(
        f"WITH {SUBCLUSTERS_SQL}", f"WITH {SUBCLUSTERS_SQL}, {BALANCED_ROWS_SQL}"
    )
    + " UNION ALL SELECT 2 AS stage, 'balanced' AS cut, * FROM ("
    + flow_sql([("x", "true", "label")], stats.DETECTOR_CLASSES)
    .split("* FROM (", 1)[1]
    .replace("(SELECT * FROM subclusters WHERE true)", "balanced")
)
def cut_flow_with_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        stats.Cut(
            "clean",
            lambda label: cuts.is_matched(label) & cuts.is_not_signal_sample_background(label),
        ),
        stats.TableStep("balanced", lambda df: sampling.balance_classes(df, [1, 2, 3], ROW_KEY)),
    ]
    return stats.cut_flow(subclusters(spark, sf_dir), steps)


@query(
    f"""WITH ranked AS ({ranked_sql("events", "event_id", 43)})
SELECT event_id, event_type, CASE WHEN place <= (size + 4) // 5 THEN 'test' ELSE 'train' END AS part
FROM ranked"""
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    train, test = sampling.train_test(events, EVENT_KEY)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    f"""WITH ranked AS ({ranked_sql("events", "event_id", 43)}),
train AS (SELECT event_id, event_type FROM ranked WHERE place > (size + 4) // 5),
again AS ({ranked_sql("train", "event_id", 44)})
SELECT event_id, event_type, CASE WHEN place <= size * 4 // 5 THEN 'fit' ELSE 'validation' END AS part
FROM again"""
)
def fit_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    fit, validation = sampling.fit_validation(sampling.train_test(events, EVENT_KEY)[0], EVENT_KEY)
    return fit.withColumn("part", F.lit("fit")).unionByName(
        validation.withColumn("part", F.lit("validation"))
    )


def _random_sql(n: int, seed: int) -> str:
    return (
        f"WITH ranked AS ({ranked_sql('events', 'event_id', seed)}) "
        f"SELECT event_id, event_type, value FROM ranked WHERE place <= {n}"
    )


@query(_random_sql(100, 7))
def random_background_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return sampling.take_random(events, 100, 7, EVENT_KEY)


@query(_random_sql(500, 8))
def random_explained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return sampling.take_random(events, 500, 8, EVENT_KEY)


@query(_random_sql(1, 43))
def one_random_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return sampling.take_random(events, 1, 43, EVENT_KEY)


@query(
    f"""WITH {EVENT_LABELS_SQL},
ranked AS ({ranked_sql("labelled", "event_id", 111, "label")}),
least AS (SELECT min(size) AS n FROM ranked WHERE label IN (0, 1))
SELECT event_id, user_id, label FROM ranked, least WHERE label NOT IN (0, 1) OR place <= n"""
)
def undersample_larger_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.undersample_larger(labelled_events(spark, sf_dir), EVENT_KEY)


# --- rows in the order of the file -----------------------------------------------------

FILE_ROWS_SQL = """numbered AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER () - 1 AS position, count(*) OVER () AS size FROM lineitem)"""


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.in_file_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "position")


@query(f"WITH {FILE_ROWS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, position FROM numbered WHERE position < 500")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 rows as they stand in the file: the rows to explain."""
    return order.first_rows(_numbered_lines(spark, sf_dir), 500, "position")


@query(f"WITH {FILE_ROWS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, position FROM numbered WHERE position >= size * 4 // 5")
def last_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows at the end that a fit holds back, in the order of the file."""
    return order.last_fifth(_numbered_lines(spark, sf_dir), "position")[1]
