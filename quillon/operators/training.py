"""Training tables: masks of continuous features, reconstruction, attention masks, contact losses, ragged access, collation, normal noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.tokens import padded, uniform
from quillon.plans.prefix import numbered, totals_before


def normal(seed: int, *parts: Column) -> Column:
    """A number of the normal distribution, fixed by the seed and the parts (Box and Muller)."""
    u, v = uniform(seed, F.lit("radius"), *parts), uniform(seed, F.lit("angle"), *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def noise_mix(x: Column, alpha: float, seed: int, *parts: Column) -> Column:
    """(1 - alpha) of a number and alpha of normal noise."""
    return (1 - alpha) * x + alpha * normal(seed, *parts)


def mask_continuous(df: DataFrame, features: str, keys: list[str], keep: Column, prob: float = 0.3, mode: str = "learned", seed: int = 0) -> DataFrame:
    """df (a row per position) and masked, label and input: of the positions to keep a part prob is masked; their label is what they were, null for others; their input stays
    ("learned"), is zeros ("zero") or normal noise ("noise")."""
    masked = keep & (uniform(seed, F.lit("mask"), *[F.col(k) for k in keys]) < prob)
    change = {"learned": F.col(features), "zero": F.transform(features, lambda _: F.lit(0e0)), "noise": F.transform(features, lambda _, i: normal(seed, *[F.col(k) for k in keys], i))}[mode]
    return df.withColumns({"masked": masked, "label": F.when(masked, F.col(features)), "input": F.when(masked, change).otherwise(F.col(features))})


def reconstruction(df: DataFrame, predicted: str, target: str, masked: Column) -> DataFrame:
    """One row over the masked positions: mae, rmse, their number and that of their values; zeros without any."""
    each = df.where(masked).select(F.zip_with(predicted, target, lambda p, t: p - t).alias("_d"))
    values = each.select(F.explode("_d").alias("d")).agg(F.coalesce(F.avg(F.abs("d")), F.lit(0e0)).alias("mae"), F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), F.lit(0e0)).alias("rmse"), F.count("*").alias("masked_values"))
    return values.crossJoin(each.agg(F.count("*").alias("masked_rows")))  # one row with one row


def masked_mean(values: Column, pad: Column) -> Column:
    """The mean of an array's numbers that aren't padding; 0 without any."""
    kept = F.filter(F.arrays_zip(values.alias("x"), pad.alias("p")), lambda z: ~z["p"])
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0e0), lambda s, z: s + z["x"]) / F.size(kept)).otherwise(0e0)


def masked_max(values: Column, pad: Column) -> Column:
    """The largest of an array's numbers that aren't padding; 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.filter(F.arrays_zip(values.alias("x"), pad.alias("p")), lambda z: ~z["p"]), lambda z: z["x"])), F.lit(0e0))


def top_mask(weights: Column, share: float) -> Column:
    """An array with its largest numbers, a part of them and one at least, and zeros for the others; of equals the first stay. A share of 0 or 1 changes nothing."""
    if not 0 < share < 1:
        return weights
    k = F.greatest(F.lit(1), F.ceil(F.size(weights) * F.lit(share))).cast("int")
    let = lambda value, then: F.get(F.transform(F.array(value), then), 0)  # noqa: E731 - computed once, not for each number
    ranked = lambda w: F.sort_array(F.transform(w, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    kept = lambda w: F.transform(F.slice(ranked(w), F.lit(1), k), lambda z: z["i"])
    return let(weights, lambda w: let(kept(w), lambda js: F.transform(w, lambda x, i: F.when(F.array_contains(js, i), x).otherwise(0e0))))


def contact_loss(pairs: DataFrame, group: str, value: str, positive: str, tie: list[str], k: int = 8, weight: float = 0.3, margin: float = 0.0) -> DataFrame:
    """One row: values as deviations from the mean of all; per group with a contact, the mean of softplus(-x) over its k largest contacts, and weight times the mean of
    softplus(x - margin) over the others; the mean over groups, 0 without any."""
    fit = pairs.agg(F.avg(value).alias("_m"), F.greatest(F.stddev_pop(value), F.lit(1e-6)).alias("_s"))
    x = pairs.join(F.broadcast(fit)).withColumn("_x", (F.col(value) - F.col("_m")) / F.col("_s"))  # one row
    softplus = lambda c: F.greatest(c, F.lit(0e0)) + F.log1p(F.exp(-F.abs(c)))
    w = Window.partitionBy(group).orderBy(F.desc("_x"), *tie)
    best = x.where(positive).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).groupBy(group).agg(F.avg(softplus(-F.col("_x"))).alias("_p"))
    rest = x.where(f"NOT {positive}").groupBy(group).agg(F.avg(softplus(F.col("_x") - margin)).alias("_q"))
    return best.join(rest, group, "left").agg(F.coalesce(F.avg(F.col("_p") + weight * F.coalesce("_q", F.lit(0e0))), F.lit(0e0)).alias("loss"))


def cursor_slices(stream: DataFrame, place: str, batches: DataFrame, batch: str, need: str, block: int = 4096) -> DataFrame:
    """stream (a row per place, from 0) and the batch that takes it: batches in order take what they need, one after the other. An exhausted stream is an error.

    Batches and places meet by blocks of places, so that the join is by equality.
    """
    spans = totals_before(batches.select(batch, need), batch, {"_from": need}).select(batch, "_from", (F.col("_from") + F.col(need)).alias("_to"))
    wanted, there = batches.agg(F.sum(need)).first()[0] or 0, stream.count()
    if wanted > there:
        raise ValueError(f"the stream has {there} of {wanted} places")
    near = spans.where("_to > _from").withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    return stream.withColumn("_block", F.floor(F.col(place) / block)).join(near, "_block").where((F.col(place) >= F.col("_from")) & (F.col(place) < F.col("_to"))).drop("_block", "_from", "_to")


def atom_numbers(atoms: DataFrame, order: list[str]) -> DataFrame:
    """atoms and atom_id, counted over all molecules of all batches in order."""
    return numbered(atoms, order, "atom_id")


def node_numbers(nodes: DataFrame, graph: str, order: str) -> DataFrame:
    """nodes and node_id, counted from 0 in each graph."""
    return nodes.withColumn("node_id", (F.row_number().over(Window.partitionBy(graph).orderBy(order)) - 1).cast("long"))


def ragged_rows(batches: DataFrame, offsets: str, flat: str) -> DataFrame:
    """A row for each molecule of a batch: at and values, what lies between its offset and the next; offsets have a last one more than there are molecules."""
    spans = batches.select("*", F.posexplode(F.slice(offsets, 1, F.size(offsets) - 1)).alias("at", "_a")).withColumn("_b", F.get(F.col(offsets), F.col("at") + 1))
    return spans.withColumn("values", F.slice(flat, F.col("_a") + 1, F.col("_b") - F.col("_a"))).drop("_a", "_b")


def normalised(df: DataFrame, features: str, is_train: Column, eps: float = 1e-6) -> DataFrame:
    """df and z: features by the means and population deviations of the training rows, place by place."""
    parts = df.where(is_train).select(F.posexplode(features).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    fit = parts.agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("_fit"))  # a row for each place
    return df.join(F.broadcast(fit)).withColumn("z", F.zip_with(features, "_fit", lambda x, f: (x - f["m"]) / (f["s"] + F.lit(eps)))).drop("_fit")


def shard_index(shards: DataFrame, file: str, rows: str) -> DataFrame:
    """(file, at, value) of files whose lines are an array: trimmed, without blank ones."""
    kept = F.filter(F.transform(rows, lambda x: F.trim(x)), lambda x: x != "")
    return shards.select(file, F.posexplode(kept).alias("at", "value"))


def collated(samples: DataFrame, batch: str, order: str, tokens: str, edges: str, pad: int) -> DataFrame:
    """samples and, by batch: ids, its tokens filled up to the longest of the batch, length, and shifted, its edges (an array of structs src, dst) with the nodes of
    the samples before it added."""
    of = Window.partitionBy(batch)
    before = F.coalesce(F.sum(F.size(tokens)).over(of.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    wide = samples.withColumn("_longest", F.max(F.size(tokens)).over(of)).withColumn("_before", before)
    shifted = F.transform(edges, lambda e: F.struct((e["src"] + F.col("_before")).alias("src"), (e["dst"] + F.col("_before")).alias("dst")))
    return wide.withColumn("ids", padded(F.col(tokens), F.col("_longest"), pad)).withColumn("length", F.size(tokens).cast("long")).withColumn("shifted", shifted).drop("_longest", "_before")


def distance_bias(samples: DataFrame, profiles: DataFrame, key: str, label: str, ok: str, size: str, sigma: float, cutoff: float) -> DataFrame:
    """samples and bias: exp(-d / sigma) of the key's profile (distances), 0 beyond the cutoff; all zeros unless the label is 1, ok is 1 and the profile has the right size."""
    joined = samples.join(profiles.select(key, "distances"), key, "left")
    gate = F.coalesce((F.col(label) == 1) & (F.col(ok) == 1) & (F.size("distances") == F.col(size)), F.lit(False))
    biased = F.transform("distances", lambda d: F.when(d > cutoff, 0e0).otherwise(F.exp(-d / sigma)))
    return joined.withColumn("bias", F.when(gate, biased).otherwise(F.array_repeat(F.lit(0e0), F.col(size)))).drop("distances")
