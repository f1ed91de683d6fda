"""Points in space and on grids: contacts, rankings of chains, distances, densities."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import nearest_center
from quillon.operators.quantiles import quantiles
from quillon.plans.cut import cut


def contact_mask(residues: DataFrame, contacts: DataFrame, group: str, residue: str) -> DataFrame:
    """(group, mask, contact_n): a 1 for each residue, in order, that has a contact, else a 0."""
    near = contacts.select(group, residue).distinct().withColumn("_near", F.lit("1"))
    marked = residues.join(near, [group, residue], "left").select(group, residue, F.coalesce("_near", F.lit("0")).alias("_bit"))
    ordered = F.array_sort(F.collect_list(F.struct(residue, "_bit")))
    return marked.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["_bit"]), "").alias("mask"), F.count(F.when(F.col("_bit") == "1", 1)).alias("contact_n"))


def chain_ranking(residues: DataFrame, ligand: DataFrame, xyz: tuple[str, str, str], structure: str, chain: str, residue: str, cutoff: float, sigma: float) -> DataFrame:
    """(structure, chain, contacts, soft, best, place): residues nearer than the cutoff, the sum of exp(-distance / sigma), the least distance, and the place in the structure.

    Each residue finds the nearest ligand point of its chain, by blocks, so that a chain with many of either is spread. Residues without a place, and chains without a ligand point, go.
    """
    there = " AND ".join(f"`{c}` IS NOT NULL" for c in xyz)
    at = F.array(*[F.col(c).cast("double") for c in xyz])
    points = residues.where(there).select(structure, chain, residue, at.alias("_at"))
    known = ligand.where(there).select(chain, at.alias("_lig")).distinct().withColumn("_id", F.xxhash64("_lig"))
    least = nearest_center(points, known, chain, "_at", "_lig", "_id", cosine=False).withColumn("_d", F.sqrt(F.greatest(-F.col("similarity"), F.lit(0e0))))
    stats = least.groupBy(structure, chain).agg(F.count(F.when(F.col("_d") < cutoff, 1)).alias("contacts"), F.sum(F.exp(-F.col("_d") / sigma)).alias("soft"), F.min("_d").alias("best"))
    place = F.row_number().over(Window.partitionBy(structure).orderBy(F.desc("contacts"), F.desc("soft"), "best", chain))
    return stats.withColumn("place", place.cast("long"))


#: Rows of a block that meet the other block at once.
AT_ONCE = 32


def pair_quantiles(points: DataFrame, group: str, row: str, vector: str, at: tuple[float, ...], sample: int | None = None, block: int = 2048, bins: int = 65536) -> DataFrame:
    """(group, pairs, q<percent> ...): quantiles of the distances of all pairs in a group, exact; with `sample`, of at most so many points of it (chosen by a hash).

    Points are dealt into blocks by a hash and every two blocks meet in a task, so that a large group is spread and pairs are never rows: a task first gives back how many distances fall into each bin, and in a
    second pass the distinct distances, and their numbers, of the bins that hold a quantile's two neighbours. Vectors of a group have one length.
    """
    p = points.select(F.col(group).alias("g"), F.col(row).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("g IS NOT NULL AND i IS NOT NULL AND v IS NOT NULL")
    if sample is not None:
        p = p.withColumn("_rn", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("i"), "i"))).where(F.col("_rn") <= sample).drop("_rn")
    length = F.sqrt(F.aggregate("v", F.lit(0e0), lambda s, x: s + x * x))
    sizes = p.groupBy("g").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_k"), (2e0 * F.max(length)).alias("_most"))
    dealt = cut(p.join(sizes, "g").withColumn("_own", F.pmod(F.xxhash64("i"), F.col("_k")).cast("int")))
    kind = points.schema[group].dataType.simpleString()

    def met(asked: DataFrame | None) -> DataFrame:
        """(g, bin, n) of all pairs, or (g, bin, d, n) of those in the bins that are asked for."""
        own = dealt.select("g", "i", "v", "_most", F.col("_own").alias("a"), F.explode(F.sequence("_own", F.col("_k") - 1)).alias("b"))
        if asked is not None:
            own = own.join(asked.groupBy("g").agg(F.collect_set("bin").alias("wanted")), "g")  # a few bins for each group
        other = dealt.select(F.col("g").alias("g_2"), F.col("i").alias("i"), F.col("v").alias("v"), F.col("_own").alias("b_2"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("a_2"))

        second = asked is not None

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(left) and len(right):
                x, y, most = np.array(left["v"].to_list()), np.array(right["v"].to_list()), left["_most"].iloc[0]
                i, j, same = left["i"].to_numpy(), right["i"].to_numpy(), left["a"].iloc[0] == left["b"].iloc[0]
                for k in range(0, len(x), AT_ONCE):
                    apart = x[k : k + AT_ONCE, None, :] - y[None, :, :]
                    d = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))
                    d = d[i[k : k + AT_ONCE, None] < j[None, :]] if same else d.ravel()
                    at_bin = np.minimum(bins, np.floor(d / most * bins)).astype(np.int32) if most > 0 else np.zeros(len(d), np.int32)
                    if second:
                        some = np.isin(at_bin, left["wanted"].iloc[0])
                        values, n = np.unique(d[some], return_counts=True)
                        found.append(pd.DataFrame({"bin": np.minimum(bins, np.floor(values / most * bins)).astype(np.int32) if most > 0 else np.zeros(len(values), np.int32), "d": values, "n": n}))
                    else:
                        found.append(pd.DataFrame(dict(zip(("bin", "n"), np.unique(at_bin, return_counts=True), strict=True))))
            out = pd.concat(found) if found else pd.DataFrame({"bin": [], "d": [], "n": []})
            out = out.groupby(["bin"] if not second else ["bin", "d"], as_index=False)["n"].sum()
            return out.assign(g=left["g"].iloc[0] if len(left) else None)[["g", "bin", *([] if not second else ["d"]), "n"]]

        schema = f"g {kind}, bin int, {'' if not second else 'd double, '}n long"
        return own.groupBy("g", "a", "b").cogroup(other.groupBy("g_2", "a_2", "b_2")).applyInPandas(meet, schema)

    counts = met(None).groupBy("g", "bin").agg(F.sum("n").alias("n"))
    found = _from_bins(counts, at, lambda asked: met(asked).groupBy("g", "bin", "d").agg(F.sum("n").alias("m")))
    return found.withColumnsRenamed({"g": group, "n": "pairs"})


def exact_quantiles(d: DataFrame, at: tuple[float, ...], bins: int = 65536) -> DataFrame:
    """(g, n, q<percent> ...) of (g, _most, d): quantiles of the values of each group, between neighbours by the line; values are from 0 to _most, which a group shares.

    Values are counted by bins first; only those in the bins that hold a quantile's two neighbours are gathered and sorted, in a second pass, so that no task holds a group.
    """
    d = d.select("g", "d", F.when(F.col("_most") > 0, F.least(F.lit(bins), F.floor(F.col("d") / F.col("_most") * bins).cast("int"))).otherwise(0).alias("bin"))
    near = lambda asked: d.join(asked, ["g", "bin"]).groupBy("g", "bin", "d").agg(F.count("*").alias("m"))  # noqa: E731  equal values are one row
    return _from_bins(d.groupBy("g", "bin").agg(F.count("*").alias("n")), at, near)


def _from_bins(counts: DataFrame, at: tuple[float, ...], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(g, n, q<percent> ...) from (g, bin, n), and from what near gives for some (g, bin): (g, bin, d, m), the distinct values in it and their numbers."""
    of = Window.partitionBy("g")  # over the bins of a group
    held = cut(counts.select("g", "bin", "n", F.sum("n").over(of).alias("all"), (F.sum("n").over(of.orderBy("bin")) - F.col("n")).alias("before")))
    rank = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(x)) * (F.col("all") - 1)).alias("at")) for k, x in enumerate(at)])).alias("_r")
    sides = F.explode(F.array(F.floor("_r.at"), F.ceil("_r.at"))).alias("place")
    asked = held.select("*", rank).select("g", "bin", "before", "n", "all", "_r.k", "_r.at", sides).where("place >= before AND place < before + n").distinct()
    upto = near(asked.select("g", "bin").distinct()).withColumn("end", F.sum("m").over(Window.partitionBy("g", "bin").orderBy("d")))
    found = asked.join(upto, ["g", "bin"]).where("place - before < end and place - before >= end - m").select("g", "all", "k", "at", "place", "d")
    each = found.groupBy("g", "k").agg(F.max("all").alias("all"), (F.min("d") + (F.max("at") - F.floor(F.max("at"))) * (F.max("d") - F.min("d"))).alias("q"))
    return each.groupBy("g").agg(F.max("all").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{round(100 * x)}") for k, x in enumerate(at)])


def _grid(df: DataFrame, low: float, high: float, size: int) -> DataFrame:
    """(i, j, gx, gy): a square grid; its size is a parameter."""
    n = df.sparkSession.range(size * size).select((F.col("id") / size).cast("long").alias("i"), (F.col("id") % size).alias("j"))
    at = lambda c: low + (high - low) * F.col(c) / (size - 1)
    return n.withColumn("gx", at("i")).withColumn("gy", at("j"))


def kde_grid(points: DataFrame, x: str, y: str, low: float, high: float, size: int, width: float) -> DataFrame:
    """(i, j, density): a Gaussian kernel density on a grid. Each point adds to all grid places in its own row; sums are partial before the shuffle."""
    grid = _grid(points, low, high, size).agg(F.array_sort(F.collect_list(F.struct("i", "j", "gx", "gy"))).alias("_grid"))
    spread = points.select(x, y).join(F.broadcast(grid)).select(x, y, F.explode("_grid").alias("g"))
    square = (F.col(x) - F.col("g.gx")) ** 2 + (F.col(y) - F.col("g.gy")) ** 2
    sums = spread.groupBy("g.i", "g.j").agg(F.sum(F.exp(-square / (2 * width * width))).alias("_s"), F.count("*").alias("_n"))
    return sums.select("i", "j", (F.col("_s") / (F.col("_n") * (2 * math.pi * width * width))).alias("density"))


def voronoi_grid(centers: DataFrame, cid: str, x: str, y: str, low: float, high: float, size: int) -> DataFrame:
    """(i, j, cid): the nearest centre of each grid place, the smallest id of equals. Blocks of places and of centres meet as matrices."""
    places = _grid(centers, low, high, size).select(F.lit(0).alias("k"), "i", "j", F.array("gx", "gy").alias("v"))
    known = centers.select(F.lit(0).alias("k"), F.col(cid).alias("cid"), F.array(x, y).cast("array<double>").alias("center"))
    return nearest_center(places, known, "k", "v", "center", "cid", cosine=False).select("i", "j", "cid")


def percentile_zoom(points: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Points between two percentiles on every axis."""
    joined = points
    for c in columns:
        bounds = quantiles(points, [], c, {f"_{c}_lo": low, f"_{c}_hi": high})
        joined = joined.join(F.broadcast(bounds)).where(F.col(c).between(F.col(f"_{c}_lo"), F.col(f"_{c}_hi")))
    return joined.select(*points.columns)


def soft_scores(distances: DataFrame, groups: list[str], distance: str, sigma: float, cutoff: float) -> DataFrame:
    """Per group: soft, the sum of exp(-distance / sigma) of what lies within the cutoff; 0 without any."""
    return distances.groupBy(*groups).agg(F.sum(F.when(F.col(distance) > cutoff, 0e0).otherwise(F.exp(-F.col(distance) / sigma))).alias("soft"))


def clip_bounds(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """One row: the bounds that a part of the values at either end lies beyond; the whole range where the bounds meet."""
    found = quantiles(df, [], value, {"a": low, "b": high, "_lo": 0.0, "_hi": 1.0})
    flat = F.col("b") <= F.col("a")
    return found.select(F.when(flat, F.col("_lo")).otherwise(F.col("a")).alias("low"), F.when(flat, F.col("_hi")).otherwise(F.col("b")).alias("high"))


def common_grid(points: DataFrame, x: str, y: str, size: int, pad: float = 0.02) -> DataFrame:
    """(i, j, gx, gy): places evenly over the box of all points, padded by a part of its sides."""
    side = lambda c: F.when(F.max(c) > F.min(c), (F.max(c) - F.min(c)) * pad).otherwise(1e-3)
    box = points.agg(*[(F.min(c) - side(c)).alias(f"_lo{n}") for n, c in (("x", x), ("y", y))], *[(F.max(c) + side(c)).alias(f"_hi{n}") for n, c in (("x", x), ("y", y))])
    n = points.sparkSession.range(size * size).select((F.col("id") / size).cast("long").alias("i"), (F.col("id") % size).alias("j"))
    at = lambda k, c: F.col(f"_lo{c}") + (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * F.col(k) / (size - 1)
    return n.join(F.broadcast(box)).select("i", "j", at("i", "x").alias("gx"), at("j", "y").alias("gy"))  # one row


def cluster_densities(points: DataFrame, cluster: str, x: str, y: str, low: float, high: float, size: int, width: float, least: int = 80) -> DataFrame:
    """(i, j, density): on a grid, the sum over clusters with enough points of each one's mean Gaussian kernel."""
    sizes = points.groupBy(cluster).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    grid = _grid(points, low, high, size).agg(F.array_sort(F.collect_list(F.struct("i", "j", "gx", "gy"))).alias("_grid"))
    spread = points.join(sizes, cluster).select(x, y, "_n").join(F.broadcast(grid)).select(x, y, "_n", F.explode("_grid").alias("g"))
    square = (F.col(x) - F.col("g.gx")) ** 2 + (F.col(y) - F.col("g.gy")) ** 2
    return spread.groupBy("g.i", "g.j").agg((F.sum(F.exp(-square / (2 * width * width)) / F.col("_n")) / (2 * math.pi * width * width)).alias("density"))
