"""Latent vectors as a whole: covariances and principal components, and soft clusters of each key by expectation maximisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.cut import cut

#: Points of one key that are looked at together.
POINTS = 1 << 15
#: Variances are this at least.
LEAST = 1e-6


def moments(df: DataFrame, vec_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of vectors, their mean and the matrix of summed products of deviations from it, in one pass.

    Each task adds up its batches about the first vector, so that no digits are lost to a distant mean; the tasks' matrices merge through a tree, and only a few of them come to the driver. Vectors that
    are null, hold null or non-finite numbers or have another length than the first go. Without any the mean is empty.
    """
    v = F.col(vec_col).cast("array<double>")
    sound = df.where(F.col(vec_col).isNotNull()).select(v.alias("v")).where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & (F.size("v") > 0))
    one = sound.first()
    if one is None:
        return 0, np.empty(0), np.empty((0, 0))
    origin = np.array(one["v"])
    d = len(origin)

    def added(batches):
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, d) - origin if batch.num_rows else np.empty((0, d))
            n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()]), pa.array([p.tobytes()])], names=["n", "s", "p"])

    parts = sound.where(F.size("v") == d).mapInArrow(added, "n long, s binary, p binary").rdd.map(lambda r: (r["n"], np.frombuffer(r["s"]), np.frombuffer(r["p"])))
    n, s, p = parts.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]), 3)
    return n, origin + s / n, p.reshape(d, d) - np.outer(s, s) / n


def principal_components(df: DataFrame, vec_col: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean, the k directions of most variance (rows), and their variances (of samples, n - 1). Of each direction the entry that is largest in size is positive, the first of equals."""
    n, mean, products = moments(df, vec_col)
    if not n:
        return mean, np.empty((0, 0)), np.empty(0)
    values, vectors = np.linalg.eigh(products / max(1, n - 1))
    order = np.argsort(-values, kind="stable")[:k]
    found = vectors[:, order].T
    at = np.abs(np.round(found, 9)).argmax(axis=1)
    return mean, found * np.where(found[np.arange(len(found)), at] < 0, -1.0, 1.0)[:, None], np.maximum(values[order], 0.0)


def project(df: DataFrame, vec_col: str, mean: np.ndarray, directions: np.ndarray, name: str = "projection") -> DataFrame:
    """df and the coordinates of each vector along the directions, in expressions alone; null for vectors that are null, hold null or have another length."""
    v = F.col(vec_col)
    row = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    along = lambda xs: F.aggregate(F.zip_with(v, row(xs), lambda a, b: a.cast("double") * b), F.lit(0e0), lambda s, x: s + x) - float(mean @ xs)
    sound = (F.size(v) == len(mean)) & F.forall(v, lambda x: x.isNotNull())
    return df.withColumn(name, F.when(sound, F.array(*[along(xs) for xs in directions])))


def covariances(df: DataFrame, vec_col: str) -> DataFrame:
    """(i, j, covariance) for i <= j, of samples."""
    n, _, products = moments(df, vec_col)
    cells = [(i, j, float(products[i, j] / max(1, n - 1))) for i in range(len(products)) for j in range(i, len(products))]
    return df.sparkSession.createDataFrame(cells, "i int, j int, covariance double")



def _shares(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray, hard: bool) -> tuple[np.ndarray, np.ndarray]:
    """Memberships of points in clusters, and the logarithms of the points' densities."""
    with np.errstate(divide="ignore"):
        logs = np.log(weight) - 0.5 * ((x * x) @ (1 / var).T - 2 * x @ (mean / var).T + (mean * mean / var).sum(axis=1) + np.log(2 * math.pi * var).sum(axis=1))
    top = logs.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
    shares = np.eye(logs.shape[1])[logs.argmax(axis=1)] if hard else np.exp(logs - total)
    return shares, total[:, 0]


def soft_clusters(points: DataFrame, centers: DataFrame, key: str, vector: str, center: str, cid: str, rounds: int, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """Gaussian clusters with a variance for each dimension, for every key at once: (key, cid, weight, mean, var) after some rounds, and (key, round, likelihood), the logarithm of the points' likelihood
    before each round, which never falls (with `hard`, where each point counts for its likeliest cluster only, the first of equals, it may).

    centers has a row for each (key, cid), where clusters start, with equal weights and the variances of all points of the key. Points of a key are dealt into chunks by a hash, each of which meets the key's
    clusters in one task and gives back sums alone, so a hot key is spread, and nothing hangs on partitions but the last digits. Clusters of a key have to fit a task. A cluster
    that no point belongs to stays as it is, with weight 0. Vectors that are null or hold null and keys without centres go.
    """
    sound = points.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.xxhash64(*points.columns).alias("h"))
    known = sound.join(centers.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    cells = known.select("k", F.posexplode("v").alias("at", "x")).groupBy("k", "at").agg(F.var_pop("x").alias("var"), F.count("*").alias("n"))
    spread = cells.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "var"))), lambda c: F.greatest(c["var"], F.lit(LEAST))).alias("var"), F.max("n").alias("n"))
    start = centers.select(F.col(key).alias("k"), F.col(cid).cast("long").alias("cid"), F.col(center).cast("array<double>").alias("mean"))
    sizes = start.groupBy("k").agg(F.count("*").alias("_c")).join(spread, "k")
    now = cut(start.join(sizes, "k").select("k", "cid", (F.lit(1e0) / F.col("_c")).alias("weight"), "mean", "var"))
    chunks = spread.select("k", "n", F.ceil(F.col("n") / POINTS).cast("int").alias("chunks"))
    dealt = cut(known.join(chunks, "k").withColumn("chunk", F.pmod("h", F.col("chunks")).cast("int")).select("k", "chunk", "v"))
    kind = points.schema[key].dataType.simpleString()

    def step(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"k": [], "cid": [], "n": [], "s": [], "q": [], "likelihood": []})
        x, b = np.array(a["v"].to_list(), np.float64), b.sort_values("cid")
        shares, logs = _shares(x, b["weight"].to_numpy(), np.array(b["mean"].to_list()), np.array(b["var"].to_list()), hard)
        first = np.zeros(len(b))
        first[0] = logs.sum()
        return pd.DataFrame({"k": [a["k"].iloc[0]] * len(b), "cid": b["cid"].to_numpy(), "n": shares.sum(axis=0), "s": list(shares.T @ x), "q": list(shares.T @ (x * x)), "likelihood": first})

    told = []
    for r in range(rounds):
        every = now.join(chunks, "k").select(F.col("k").alias("k_2"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_2"), "cid", "weight", "mean", "var")
        parts = cut(dealt.groupBy("k", "chunk").cogroup(every.groupBy("k_2", "chunk_2")).applyInPandas(step, f"k {kind}, cid long, n double, s array<double>, q array<double>, likelihood double"))
        told.append(parts.groupBy("k").agg(F.sum("likelihood").alias("likelihood")).select(F.col("k").alias(key), F.lit(r).alias("round"), "likelihood"))
        sums = parts.select("k", "cid", F.posexplode(F.arrays_zip("s", "q")).alias("at", "z")).groupBy("k", "cid", "at").agg(F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
        lists = sums.groupBy("k", "cid").agg(F.array_sort(F.collect_list(F.struct("at", "s", "q"))).alias("z")).join(parts.groupBy("k", "cid").agg(F.sum("n").alias("m")), ["k", "cid"])
        mean = F.transform("z", lambda z: z["s"] / F.col("m"))
        var = F.transform("z", lambda z: F.greatest(z["q"] / F.col("m") - (z["s"] / F.col("m")) * (z["s"] / F.col("m")), F.lit(LEAST)))
        moved = now.withColumnsRenamed({"mean": "_mean", "var": "_var"}).drop("weight").join(lists, ["k", "cid"]).join(chunks.select("k", F.col("n").alias("_n")), "k")
        some = F.col("m") > 0
        now = cut(moved.select("k", "cid", (F.col("m") / F.col("_n")).alias("weight"), F.when(some, mean).otherwise(F.col("_mean")).alias("mean"), F.when(some, var).otherwise(F.col("_var")).alias("var")))
    likelihoods = told[0]
    for more in told[1:]:
        likelihoods = likelihoods.union(more)
    return now.select(F.col("k").alias(key), F.col("cid").alias(cid), "weight", "mean", "var"), likelihoods
