"""Bindings of the operators to the input tables, shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits that does not depend on the order of sums."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: groups are users, the truth is value / 100, the score a fixed mix of the event's number with it, the label a purchase."""
    e = table(spark, sf_dir, "events")
    noise = (F.col("event_id") * 7919 % 10007) / F.lit(10007e0)
    return e.select("event_id", "user_id", "event_type", (F.col("value") / 100e0).alias("truth"), F.round(noise * 0.7e0 + F.col("value") / 2000e0, 3).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))


#: The same in SQL.
SCORED = """scored AS (SELECT event_id, user_id, event_type, value / 100e0 AS truth, round((event_id * 7919 % 10007) / 10007e0 * 0.7e0 + value / 2000e0, 3) AS score,
 CAST(event_type = 'purchase' AS INTEGER) AS label FROM events)"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a protein (supplier) and a ligand (part) with a measured y (quantity)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("prot"), F.col("l_partkey").alias("lig"), F.col("l_quantity").alias("y"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"))


INTERACTIONS = "inter AS (SELECT l_suppkey AS prot, l_partkey AS lig, l_quantity AS y, l_orderkey AS ord, l_linenumber AS line FROM lineitem)"
