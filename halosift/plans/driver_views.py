"""The given tables seen as subcluster, grid and scored tables.

Each view exists twice: as a DataFrame for the engine and as SQL text for the
check. Both use only operations that give the same bits in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halosift.functions.grids import pixel_names
from halosift.sources.tables import read_parquet

HALF = 3
SIDE = 2 * HALF + 1
CELLS = SIDE * SIDE
CLASSES = [1, 2, 3]
ROW_KEY = ["event", "object", "tower", "crystal"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def subclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subcluster per line item; the row key is (event, object, tower, crystal)."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        """CASE WHEN l_partkey % 37 = 0 THEN NULL
                WHEN l_partkey % 5 = 0 THEN 'GMSB_L-350TeV'
                WHEN l_partkey % 5 = 1 THEN 'GJets_HT-400To600'
                WHEN l_partkey % 5 = 2 THEN 'QCD_HT500to700'
                WHEN l_partkey % 5 = 3 THEN 'METPD' ELSE 'EGamma' END AS sample""",
        "l_orderkey AS event",
        "CAST(l_linenumber - 1 AS BIGINT) AS object",
        "l_suppkey % 3 AS subcl",
        """CAST(CASE WHEN l_quantity = 1 THEN -1 WHEN l_quantity <= 3 THEN 0
                WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2
                ELSE 3 END AS BIGINT) AS label""",
        "l_partkey AS tower",
        "l_suppkey AS crystal",
        "CAST(CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lead",
        "CASE WHEN l_partkey % 17 = 0 THEN -999D ELSE l_discount END AS R9",
        "l_quantity AS eta_sig",
        "l_extendedprice AS phi_sig",
        "l_discount AS etaphi_cov",
        "l_tax AS timeeta_cov",
        "l_tax + l_discount AS `sw+`",
        "l_extendedprice * (1 - l_discount) AS energy",
        "l_tax * 2 AS Sietaieta",
        "l_quantity / 50 AS Smajor",
        "l_discount * 3 AS Sminor",
        "l_extendedprice / 1000 AS ecalPFClusterIsoOvPt",
        "l_tax * l_discount AS hcalPFClusterIsoOvPt",
        "l_quantity * l_tax AS trkSumPtHollowConeDR03OvPt",
        "l_quantity + 1 AS major_length",
        "l_discount + 1 AS minor_length",
    )


SUBCLUSTERS_SQL = """subclusters AS (
  SELECT CASE WHEN l_partkey % 37 = 0 THEN NULL
              WHEN l_partkey % 5 = 0 THEN 'GMSB_L-350TeV'
              WHEN l_partkey % 5 = 1 THEN 'GJets_HT-400To600'
              WHEN l_partkey % 5 = 2 THEN 'QCD_HT500to700'
              WHEN l_partkey % 5 = 3 THEN 'METPD' ELSE 'EGamma' END AS sample,
         l_orderkey AS event,
         CAST(l_linenumber - 1 AS BIGINT) AS "object",
         l_suppkey % 3 AS subcl,
         CAST(CASE WHEN l_quantity = 1 THEN -1 WHEN l_quantity <= 3 THEN 0
              WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2
              ELSE 3 END AS BIGINT) AS label,
         l_partkey AS tower,
         l_suppkey AS crystal,
         CAST(CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lead,
         CASE WHEN l_partkey % 17 = 0 THEN CAST(-999 AS DOUBLE) ELSE l_discount END AS R9,
         l_quantity AS eta_sig,
         l_extendedprice AS phi_sig,
         l_discount AS etaphi_cov,
         l_tax AS timeeta_cov,
         l_tax + l_discount AS "sw+",
         l_extendedprice * (1 - l_discount) AS energy,
         l_tax * 2 AS Sietaieta,
         l_quantity / 50 AS Smajor,
         l_discount * 3 AS Sminor,
         l_extendedprice / 1000 AS ecalPFClusterIsoOvPt,
         l_tax * l_discount AS hcalPFClusterIsoOvPt,
         l_quantity * l_tax AS trkSumPtHollowConeDR03OvPt,
         l_quantity + 1 AS major_length,
         l_discount + 1 AS minor_length
  FROM lineitem)"""


def grid_table(
    spark: SparkSession, sf_dir: str, holes: bool = False, unmatched: bool = False
) -> DataFrame:
    """One 7x7 three-channel image per embedding, as pixel columns.

    ``holes`` leaves one energy pixel of every eleventh image missing and sets
    every thirteenth image's energies to zero; ``unmatched`` makes every 23rd
    row unmatched.
    """
    row, vector = F.col("vec_id"), F.col("embedding")
    places = F.sequence(F.lit(0), F.lit(CELLS - 1))
    energy = F.transform(places, lambda k: F.abs(vector[k].cast("double")))
    if holes:
        energy = F.transform(energy, lambda v, k: (
            F.when(row % 13 == 0, F.lit(0.0)).when((row % 11 == 0) & (row % CELLS == k), F.lit(None)).otherwise(v)
        ))
    pixels = {
        "E": energy,
        "t": F.transform(places, lambda k: vector[(k + 7) % 64].cast("double")),
        "r": F.transform(places, lambda k: F.when(vector[(k + 15) % 64] > 0, 1.0).otherwise(0.0)),
    }
    label = F.col("label") % 3 + 1
    if unmatched:
        label = F.when(row % 23 == 0, -1).otherwise(label)
    sample = (
        F.when(row % 5 == 0, F.lit("METPD")).when(row % 5 == 1, F.lit("GJets_HT-400To600"))
        .otherwise(F.lit("EGamma"))
    )
    identity = ["sample", "event", "object", "subcl", "label"]
    return table(spark, sf_dir, "embeddings").select(
        sample.alias("sample"),
        row.alias("event"),
        F.lit(0).cast("bigint").alias("object"),
        (row % 3).alias("subcl"),
        label.cast("bigint").alias("label"),
        *[cells.alias(f"_{ch}") for ch, cells in pixels.items()],
    ).selectExpr(*identity, *[
        f"_{ch}[{k}] AS `{name}`" for ch in pixels for k, name in enumerate(pixel_names(ch, HALF))
    ])


def grids_sql(holes: bool = False, unmatched: bool = False) -> str:
    energy = "abs(CAST(embedding[k + 1] AS DOUBLE))"
    if holes:
        energy = (
            "CASE WHEN vec_id % 13 = 0 THEN 0.0 WHEN vec_id % 11 = 0 AND vec_id % 49 = k THEN NULL "
            f"ELSE {energy} END"
        )
    label = "label % 3 + 1"
    if unmatched:
        label = f"CASE WHEN vec_id % 23 = 0 THEN -1 ELSE {label} END"
    return f"""grids AS (
  SELECT CASE WHEN vec_id % 5 = 0 THEN 'METPD' WHEN vec_id % 5 = 1 THEN 'GJets_HT-400To600'
              ELSE 'EGamma' END AS sample,
         vec_id AS event, vec_id % 3 AS subcl, CAST({label} AS BIGINT) AS label,
         list_transform(range(0, 49), lambda k: {energy}) AS e,
         list_transform(range(0, 49), lambda k: CAST(embedding[(k + 7) % 64 + 1] AS DOUBLE)) AS t,
         list_transform(range(0, 49),
           lambda k: CASE WHEN embedding[(k + 15) % 64 + 1] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r
  FROM embeddings)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored row per event: key, label and one probability per class."""
    w1 = "1 + value / 50 + CASE WHEN event_type IN ('click', 'view') THEN 0.5D ELSE 0D END"
    w2 = "1 + (user_id % 17) / 8D + CASE WHEN event_type IN ('purchase', 'signup') THEN 0.5D ELSE 0D END"
    w3 = "1 + (user_id % 5) / 4D + CASE WHEN event_type = 'error' THEN 0.5D ELSE 0D END"
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id AS key",
            """CAST(CASE WHEN event_type IN ('click', 'view') THEN 1
                         WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 3 END AS BIGINT) AS label""",
            "value", "user_id", f"{w1} AS w1", f"{w2} AS w2", f"{w3} AS w3",
        )
        .selectExpr(
            "key", "label", "value", "CAST(user_id AS DOUBLE) AS user_id",
            "array(w1 / (w1 + w2 + w3), w2 / (w1 + w2 + w3), w3 / (w1 + w2 + w3)) AS p",
        )
    )


SCORED_SQL = """weighed AS (
  SELECT event_id AS key,
         CAST(CASE WHEN event_type IN ('click', 'view') THEN 1
                   WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 3 END AS BIGINT) AS label,
         value, user_id,
         1 + value / 50
           + CASE WHEN event_type IN ('click', 'view') THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS w1,
         1 + (user_id % 17) / 8::DOUBLE
           + CASE WHEN event_type IN ('purchase', 'signup') THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS w2,
         1 + (user_id % 5) / 4::DOUBLE
           + CASE WHEN event_type = 'error' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS w3
  FROM events),
scored AS (
  SELECT key, label, value, CAST(user_id AS DOUBLE) AS user_id,
         [w1 / (w1 + w2 + w3), w2 / (w1 + w2 + w3), w3 / (w1 + w2 + w3)] AS p
  FROM weighed)"""
