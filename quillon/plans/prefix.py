"""Running totals and numbers over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.cut import cut

Order = str | Column


def _ranges(df: DataFrame, order: list[Order]) -> DataFrame:
    """df dealt into ranges of the order, as many as the session has shuffle partitions, with the number of the range; cut, so that both of its uses see the same ranges."""
    spark = df.sparkSession
    return cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()))


def totals_before(df: DataFrame, order: str | list[Order], sums: dict[str, str | Column]) -> DataFrame:
    """df and, for each name and column of sums, the total over all rows with a smaller order; 0 without any. The order is total over the rows."""
    order = [order] if isinstance(order, str) else order
    dealt = _ranges(df, order)
    per_range = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    offsets = per_range.select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_off_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, *[(F.col(f"_off_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])


def numbered(df: DataFrame, order: list[Order], name: str, first: int = 0) -> DataFrame:
    """df and the place of each row in the order, which is total over the rows, from `first` on."""
    return totals_before(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}).withColumn(name, F.col(name) + first).drop("_one")
