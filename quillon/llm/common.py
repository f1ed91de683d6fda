"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.cut import cut, drop_stored, new_path, stored

__all__ = ["WORD", "cut", "drop_stored", "join_hot", "new_path", "sampled", "small_batches", "stored", "table"]

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than this part of the rows is hot; there are fewer of them than this, so that they may be broadcast.
HOT = 1000
#: Bytes of whole texts that go to a Python worker at once.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, where it is above BATCH_BYTES, for whole texts that go to Python.

    Spark reads it when a query is planned, which is after an operator has returned, so it can't be put back here; a lower bound of the user stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def sampled(units: DataFrame, group: str, keys: list[str], most: int, groups: int = 10_000) -> DataFrame:
    """At most `most` rows of each group, chosen by a hash of the keys; all of a smaller group. units has one row for each group and keys.

    Hashes are uniform, so a bound on them that a little fewer rows than `most` are expected to pass takes the place of a ranking: no task sorts a group. Should more
    pass, the bound is lowered. Of more than `groups` groups, the first in order are meant.
    """
    counts = {r[0]: r[1] for r in units.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).limit(groups).collect()}
    shares = {g: 1.0 if n <= most else max(1.0, most - 4 * most**0.5) / n for g, n in counts.items()}
    unit = F.xxhash64(*keys) / F.lit(2.0**64) + F.lit(0.5)
    if not counts:
        return units.limit(0)
    while True:
        bounds = units.sparkSession.createDataFrame(list(shares.items()), f"`{group}` {units.schema[group].dataType.simpleString()}, _bound double")  # a row for each group
        chosen = units.join(F.broadcast(bounds), group).where((F.col("_bound") >= 1) | (unit < F.col("_bound"))).drop("_bound")
        above = [r[0] for r in chosen.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]
        if not above:
            return chosen
        shares |= {g: 0.9 * shares[g] for g in above}


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row for each of the keys and says in column n how many of the rows it has.

    Keys with more than a HOT-th of the rows, fewer than HOT by that, are broadcast, so that no task gets all rows of one; the others meet by shuffle.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(keyed.where(F.col(n) * HOT > total).drop(n))
    rest = keyed.where(F.col(n) * HOT <= total).drop(n)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, how), allowMissingColumns=True)
