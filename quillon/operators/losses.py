"""Losses and weights of training tables as aggregations: means by weight, ranking losses within groups, scores by mask, smoothed shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.prefix import numbered


def weighted_loss(df: DataFrame, groups: list[str], loss: str, weight: str, most: float = 20.0) -> DataFrame:
    """Per group: the mean loss by weight (0 without any weight), and the perplexity e^loss, the exponent held to `most`."""
    total, w = F.sum(F.col(loss) * F.col(weight)), F.sum(weight)
    mean = F.when(w > 0, total / w).otherwise(0e0)
    return df.groupBy(*groups).agg(mean.alias("loss"), F.exp(F.least(F.lit(most), mean)).alias("perplexity"))


def margin_sums(sa: np.ndarray, ta: np.ndarray, na: np.ndarray, sb: np.ndarray, tb: np.ndarray, nb: np.ndarray, apart: float, margin: float) -> tuple[int, float]:
    """Pairs (a, b) with ta - tb > apart, and the sum of max(0, margin - (sa - sb)) over them; na and nb are how often each row occurs. A NaN truth makes no pair, a NaN score no loss.

    A tree of sorted scores over the b in the order of their truths: each a asks the nodes that make up its prefix, one search a level, so no pair is formed.
    """
    a, b = ~np.isnan(ta), ~np.isnan(tb)
    sa, ta, na, sb, tb, nb = sa[a], ta[a], na[a], sb[b], tb[b], nb[b]
    order = np.argsort(tb, kind="stable")
    sb, tb, nb = sb[order], tb[order], nb[order]
    ends, first = np.unique(tb, return_index=True)
    upto = np.searchsorted(ends, ta - apart)  # distinct truths below, but for the rounding of the difference
    for _ in range(4):
        upto += (upto < len(ends)) & (ta - ends[np.minimum(upto, len(ends) - 1)] > apart) if len(ends) else 0
        upto -= (upto > 0) & ~(ta - ends[np.maximum(upto - 1, 0)] > apart) if len(ends) else 0
    end = np.append(first, len(tb))[upto]
    pairs = int((na * np.append(0, np.cumsum(nb))[end]).sum())
    weight = np.where(np.isnan(sb), 0, nb)
    filled = np.where(np.isnan(sb), -np.inf, sb)
    summed = np.where(np.isnan(sb), 0.0, sb) * nb
    asked = np.nonzero(~np.isnan(sa))[0]
    total = 0.0
    for level in range(len(sb).bit_length()):
        here = asked[(end[asked] >> level) & 1 == 1]
        if not len(here):
            continue
        node = np.arange(len(sb)) >> level
        by = np.lexsort((filled, node))
        scores, count, value = filled[by], np.append(0, np.cumsum(weight[by])), np.append(0.0, np.cumsum(summed[by]))
        low = ((end[here] >> level) - 1) << level
        high = low + (1 << level)
        at, right, wanted = low.copy(), high.copy(), sa[here] - margin
        for _ in range(level + 1):
            middle = (at + right) // 2
            smaller = (at < right) & (scores[np.minimum(middle, len(scores) - 1)] <= wanted)
            right = np.where((at < right) & ~smaller, middle, right)
            at = np.where(smaller, middle + 1, at)
        total += float((na[here] * ((value[high] - value[at]) - (count[high] - count[at]) * wanted)).sum())
    return pairs, total


def pairwise_rank_loss(df: DataFrame, group: str, score: str, truth: str, apart: float = 0.1, margin: float = 0.0, block: int = 50_000) -> DataFrame:
    """Per group with a pair: pairs whose truths differ by more than `apart`, and their mean of what the difference of scores lacks of the margin.

    Equal rows are counted first. The rest of a group is dealt into blocks of about `block` rows by a hash, and every two blocks meet in one task, where
    no pair is formed (see margin_sums). A small group is one block.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = df.where(F.col(group).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(truth).cast("double").alias("t")).agg(F.count("*").alias("n"))
    blocks = rows.groupBy("g").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_k"))
    dealt = rows.join(blocks, "g").withColumn("_own", F.pmod(F.xxhash64("s", "t"), F.col("_k")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    left = dealt.select("g", "s", "t", "n", F.lit(True).alias("left"), F.col("_own").alias("i"), others.alias("j"))
    right = dealt.select("g", "s", "t", "n", F.lit(False).alias("left"), others.alias("i"), F.col("_own").alias("j"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["left"] == side] for side in (True, False)]
        pairs, total = margin_sums(*[x[c].to_numpy() for x in sides for c in "stn"], apart, margin)
        return pd.DataFrame({"g": rows["g"].iloc[:1], "pairs": [pairs], "total": [total]})

    met = left.union(right).groupBy("g", "i", "j").applyInPandas(meet, f"g {kind}, pairs long, total double")
    return met.groupBy(F.col("g").alias(group)).agg(F.sum("pairs").alias("pairs"), (F.sum("total") / F.sum("pairs")).alias("loss")).where("pairs > 0")


def list_rank_loss(df: DataFrame, group: str, score: str, truth: str, tau: float = 1.0) -> DataFrame:
    """Per group of two rows or more: the cross entropy of the softmax of scores / tau against the softmax of truths. Two aggregations, no pairs."""
    of = Window.partitionBy(group)
    shifted = df.select(group, ((F.col(score) - F.max(score).over(of)) / F.lit(tau)).alias("_s"), (F.col(truth) - F.max(truth).over(of)).alias("_t"))
    sums = shifted.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.exp("_s")).alias("_es"), F.sum(F.exp("_t")).alias("_et"), F.sum(F.exp("_t") * F.col("_s")).alias("_ts"))
    return sums.where("n >= 2").select(group, "n", (F.log("_es") - F.col("_ts") / F.col("_et")).alias("loss"))


def masked_zscore(df: DataFrame, groups: list[str], value: str, valid: Column, eps: float = 1e-6) -> DataFrame:
    """df and z: by mean and population deviation of the valid rows of the group; 0 for the others."""
    of = Window.partitionBy(*groups)
    v = F.when(valid, F.col(value))
    return df.withColumn("z", F.when(valid, (F.col(value) - F.avg(v).over(of)) / F.sqrt(F.var_pop(v).over(of) + F.lit(eps))).otherwise(0e0))


def laplace(df: DataFrame, groups: list[str], n: str, eps: float = 1e-5) -> DataFrame:
    """df (a row per category) and share: (n + eps) / (total + categories * eps) of the group."""
    of = Window.partitionBy(*groups)
    return df.withColumn("share", (F.col(n) + eps) / (F.sum(n).over(of) + F.count("*").over(of) * F.lit(eps)))


def class_weights(sizes: DataFrame, k: str, alpha: float) -> DataFrame:
    """sizes (a row per class) and weight: k^alpha by its mean over the classes; alpha 0 gives 1 to each."""
    power = sizes.withColumn("weight", F.pow(F.col(k).cast("double"), F.lit(alpha)))
    mean = power.agg(F.avg("weight").alias("_mean"))
    return power.join(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("_mean")).drop("_mean")


def histogram_2d(df: DataFrame, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    """(i, j, n) for the filled cells of a square, numbered from 0; what lies outside is left out, the upper ends are in the last cells."""
    cell = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - low) / (high - low) * bins).cast("int"))
    inside = df.where(F.col(x).between(low, high) & F.col(y).between(low, high))
    return inside.groupBy(cell(x).alias("i"), cell(y).alias("j")).agg(F.count("*").alias("n"))


def first_seen_ids(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, id): distinct values, numbered from 0 by where they are first seen. Only the distinct values are sorted, by ranges."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    return numbered(first, ["_first", value], "id").select(value, "id")
