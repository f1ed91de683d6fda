"""Joins beyond the plain ones: cascades, priorities, ranges in space, nearest centres, work done once per distinct value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.cut import finely
from pyspark.sql.types import DoubleType, StructField, StructType


def map_distinct(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df joined with what `work` makes of its distinct keys (a table with the key): costly work is done once for each."""
    return df.join(work(df.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


def token_join(df: DataFrame, tokens: DataFrame, key: str, token: str) -> DataFrame:
    """Rows of df whose key has tokens that aren't empty, with them. tokens has one row per key."""
    return df.join(tokens.where(F.coalesce(F.trim(token) != "", F.lit(False))), key, "inner")


def missing_tokens(df: DataFrame, tokens: DataFrame, key: str, token: str) -> DataFrame:
    """Rows of df without such tokens."""
    return df.join(tokens.where(F.coalesce(F.trim(token) != "", F.lit(False))), key, "left_anti")


def good_entities(df: DataFrame, key: str, label: str, least: int, low: float, high: float) -> DataFrame:
    """Keys with enough labelled rows and a share of positives within bounds, both included."""
    stats = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.avg(F.col(label).cast("double")).alias("_rate"))
    return stats.where((F.col("_n") >= least) & F.col("_rate").between(low, high)).select(key)


def entity_semi_join(df: DataFrame, keys: dict[str, int], label: str, low: float, high: float) -> DataFrame:
    """Rows all of whose entities are good by the counts of df itself, in one pass."""
    finely(df.sparkSession)
    return reduce(lambda rows, key: rows.join(good_entities(df, key, label, keys[key], low, high), key, "left_semi"), keys, df)


def cascade(df: DataFrame, steps: list[tuple[DataFrame, Column]], value: str) -> DataFrame:
    """df and value from the first table, in order, with a match; each table has at most one row per match, and its column is called value."""
    names = []
    for k, (lookup, condition) in enumerate(steps):
        names.append(f"_{value}_{k}")
        df = df.join(lookup.withColumnRenamed(value, names[-1]), condition, "left")
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def cluster_of(df: DataFrame, value: str, members: DataFrame) -> DataFrame:
    """df and cluster: of members (member, cluster) that of the value itself, else that of the first 16 digits of its SHA-1, else an empty text."""
    by = lambda k: members.select(F.col("member").alias(f"_m{k}"), "cluster")
    short = F.substring(F.sha1(F.col(value).cast("binary")), 1, 16)
    found = cascade(df, [(by(0), F.col(value) == F.col("_m0")), (by(1), short == F.col("_m1"))], "cluster").drop("_m0", "_m1")
    return found.withColumn("cluster", F.coalesce("cluster", F.lit("")))


def affinity_join(complexes: DataFrame, id_col: str, index: DataFrame | None) -> DataFrame:
    """Complexes with what an index (id, y) tells of them, ids in small letters; those that it lacks go, unless no index is given."""
    if index is None:
        return complexes.withColumn("y", F.lit(None).cast("double"))
    return complexes.join(index.select(F.col("id").alias("_id"), "y"), F.lower(id_col) == F.col("_id")).drop("_id")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in a total order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def within_distance(left: DataFrame, right: DataFrame, xyz: tuple[str, str, str], radius: float, groups: list[str] | None = None) -> DataFrame:
    """Pairs of rows at a distance of radius or less, with the distance; the columns of the two sides differ but for xyz and groups.

    Space is cut into cubes as wide as the radius; a row of the left side goes to the 27 around its own, so the join is by equality of cubes.
    """
    groups = groups or []
    cube = [F.floor(F.col(c) / radius) for c in xyz]
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    a = left.withColumn("_near", around).select("*", *[(c + F.col(f"_near.{n}")).alias(f"_c{n}") for c, n in zip(cube, "ijk", strict=True)]).drop("_near")
    a = a.withColumnsRenamed({c: f"_a_{c}" for c in xyz})
    b = right.select("*", *[c.alias(f"_c{n}") for c, n in zip(cube, "ijk", strict=True)]).withColumnsRenamed({c: f"_b_{c}" for c in xyz})
    square = sum(((F.col(f"_a_{c}") - F.col(f"_b_{c}")) ** 2 for c in xyz), F.lit(0e0))
    joined = a.join(b, [*groups, "_ci", "_cj", "_ck"]).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius)
    return joined.drop("_ci", "_cj", "_ck", *[f"_{s}_{c}" for s in "ab" for c in xyz])


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0e0), lambda s, x: s + x)


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0e0), lambda s, x: s + x)


#: Points and centres that are compared at once.
POINTS, CENTERS = 1 << 15, 2048


def nearest_center(points: DataFrame, centers: DataFrame, key: str, point: str, center: str, cid: str, cosine: bool = True) -> DataFrame:
    """points and the best centre of their key, as cid and similarity: the largest inner product or, without cosine, the least distance (similarity is then minus its
    square). Of centres that are equal to twelve digits the smallest id is meant.

    centers has one row per (key, cid). Points of a key are dealt into chunks by a hash of the whole row, and each chunk meets all centres of its key in one task, where blocks of
    both are multiplied as matrices: no row carries the centres, and a hot key is spread. Points of unknown keys go; a vector that is null, holds null or has another length
    than the centres gets null.
    """
    points = points.drop(cid, "similarity")
    spark_type = centers.schema[cid].dataType
    schema = StructType([*points.schema.fields, StructField(cid, spark_type), StructField("similarity", DoubleType())])
    n_key = len(points.columns)
    chunks = points.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / F.lit(POINTS)).cast("int").alias("_chunks"))
    dealt = points.join(chunks, F.col(key) == F.col("_key")).withColumn("_chunk", F.pmod(F.xxhash64(*points.columns), F.col("_chunks")).cast("int")).drop("_chunks")
    spread = centers.select(F.col(key).alias("_key"), F.col(cid).alias("_cid"), F.col(center).cast("array<double>").alias("_center")).join(chunks, "_key")
    spread = spread.select(F.col("_key").alias("_of"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_at"), "_cid", "_center")

    def rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors as doubles, and which of them are whole; all have the length that most whole ones have."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.asarray(column.value_lengths().fill_null(0))
        flat = column.flatten()
        whole = np.asarray(column.is_valid()) & (sizes > 0)
        if flat.null_count:
            of = np.repeat(np.arange(len(sizes)), sizes)
            whole[of[np.asarray(flat.is_null())]] = False
        length = int(np.bincount(sizes[whole]).argmax()) if whole.any() else 0
        whole &= sizes == length
        return np.asarray(flat.fill_null(0), np.float64)[np.repeat(whole, sizes)].reshape(int(whole.sum()), length), whole

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.select(list(range(n_key)))
        y, sound = rows_of(right.column("_center"))
        ids = right.column("_cid").filter(pa.array(sound))
        if not len(left) or not len(ids):
            return own.slice(0, 0).append_column(cid, ids.slice(0, 0)).append_column("similarity", pa.array([], pa.float64()))
        order = pc.sort_indices(ids).to_numpy()
        ids, y = ids.take(pa.array(order)), y[order]
        x, known = rows_of(left.column(point))
        if x.shape[1] != y.shape[1]:
            x, known = np.zeros((0, y.shape[1])), np.zeros(len(known), bool)
        best, at = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
        lengths = (x * x).sum(axis=1)
        for low in range(0, len(y), CENTERS):
            part = y[low : low + CENTERS]
            for start in range(0, len(x), CENTERS):
                rows = slice(start, start + CENTERS)
                score = x[rows] @ part.T
                if not cosine:
                    score = 2 * score - lengths[rows, None] - (part * part).sum(axis=1)
                score = np.round(score, 12)
                top = score.argmax(axis=1)
                value = score[np.arange(len(top)), top]
                better = value > best[rows]
                best[rows], at[rows] = np.where(better, value, best[rows]), np.where(better, top + low, at[rows])
        place = np.full(len(known), -1)
        place[known] = at
        taken = pa.array(place, mask=~known)
        value = np.zeros(len(known))
        value[known] = best
        return own.append_column(cid, ids.take(taken)).append_column("similarity", pa.array(value, mask=~known))

    return dealt.groupBy("_key", "_chunk").cogroup(spread.groupBy("_of", "_at")).applyInArrow(meet, schema)
