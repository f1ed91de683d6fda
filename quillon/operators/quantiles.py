"""Exact quantiles of whole tables and of large groups: counts of distinct values, and running totals of these by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.prefix import totals_before


def quantiles(df: DataFrame, groups: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """A row for each group (one for no groups): for each name of `at` the quantile of the values that aren't null, between neighbours by the line; groups without values have no row.

    Equal values are counted before anything moves, and the distinct ones are ordered by ranges, so that neither a hot group nor a hot value lands in one task, and no task holds a group. Null groups are a group.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.lit(0).alias("_all"), F.col(value).alias("_v"))
    order = ["_all", *keys]
    counted = totals_before(rows.groupBy(*order, "_v").agg(F.count("*").alias("_n")), [*order, "_v"], {"_before": "_n"})
    sizes = counted.groupBy(*order).agg(F.min("_before").alias("_off"), F.sum("_n").alias("_total"))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos")) for k, p in enumerate(at.values())])).alias("r")
    asked = sizes.select(*[F.col(k).alias(f"_a{k}") for k in order], "_off", ranks)  # a few rows for each group
    same = F.lit(True)
    for k in order:
        same = same & F.col(k).eqNullSafe(F.col(f"_a{k}"))
    low, high = F.floor("r.pos"), F.ceil("r.pos")
    here = lambda place: (F.col("_before") - F.col("_off") <= place) & (place < F.col("_before") - F.col("_off") + F.col("_n"))
    met = counted.join(asked, same & (here(low) | here(high)))
    v = F.col("_v")
    sides = met.groupBy(*order, "r.k").agg(F.max("r.pos").alias("pos"), F.min(v).alias("a"), F.max(v).alias("b"))
    between = F.when(F.floor("pos") == F.ceil("pos"), F.col("a").cast("double")).otherwise((F.ceil("pos") - F.col("pos")) * F.col("a") + (F.col("pos") - F.floor("pos")) * F.col("b"))
    named = sides.withColumn("_q", between).groupBy(*order).agg(*[F.max(F.when(F.col("k") == k, F.col("_q"))).alias(n) for k, n in enumerate(at)])
    return named.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], *at)
