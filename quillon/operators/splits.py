"""Samples, splits, deduplication and audits of splits. Every choice is by a seeded hash with a total order, so that it does not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.clean import stable_hash
from quillon.plans.prefix import numbered


def seeded(seed: int, *columns: str) -> Column:
    return stable_hash(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]), seed)


def sample_rows(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """Exactly n rows (all if there are fewer), without replacement: the sampling operator."""
    return df.orderBy(seeded(seed, *keys), *keys).limit(n)


def balanced(df: DataFrame, entity: str, label: str, seed: int, keys: list[str]) -> DataFrame:
    """Per entity as many rows of either label (0 and 1) as the rarer has; entities with one label only go."""
    of = Window.partitionBy(entity)
    n = lambda value: F.sum((F.col(label) == value).cast("long")).over(of)
    ranked = df.where(F.col(label).isin(0, 1)).select("*", F.least(n(0), n(1)).alias("_most"), F.row_number().over(Window.partitionBy(entity, label).orderBy(seeded(seed, *keys), *keys)).alias("_rn"))
    return ranked.where("_rn <= _most").drop("_rn", "_most")


def per_class(df: DataFrame, label: str, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows of each class, or all of a smaller one."""
    w = Window.partitionBy(label).orderBy(seeded(seed, *keys), *keys)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def block_split(clusters: DataFrame, order: list[Column], cluster: str, seed: int, block: int = 10, train: int = 8, valid: int = 1) -> DataFrame:
    """clusters (a row each) and split: in the given order blocks of ten are formed, and in each, by hash, eight go to train, one to valid and one to test.

    A short last block goes to train first. The order is sorted by ranges.
    """
    placed = numbered(clusters, [*order, F.col(cluster)], "_place").withColumn("_block", F.floor(F.col("_place") / block)).drop("_place")
    at = F.row_number().over(Window.partitionBy("_block").orderBy(seeded(seed, cluster), cluster))
    split = F.when(at <= train, "train").when(at <= train + valid, "valid").otherwise("test")
    return placed.withColumn("split", split).drop("_block")


def share_split(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """df (one of files or other units) and split: the first round(n * share), one at least, by hash are valid, the others train."""
    n = df.count()
    ranked = numbered(df.withColumn("_h", seeded(seed, *keys)), ["_h", *keys], "_place")
    return ranked.withColumn("split", F.when(F.col("_place") < F.greatest(F.lit(1), F.round(F.lit(n) * share)), "valid").otherwise("train")).drop("_place", "_h")


def guide_split(train: Column, valid: Column, final: Column) -> Column:
    """By which splits have a hit: neither valid nor final, guide_train; else not train, guide_test; else drop_overlap."""
    return F.when(~valid & ~final, "guide_train").when(~train, "guide_test").otherwise("drop_overlap")


def overlap(df: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """(split_a, split_b, n_common): distinct values that two splits share, for every pair of splits; values with a null are left out."""
    sound = df.dropna(subset=columns).groupBy(*columns).agg(F.array_sort(F.collect_set(split)).alias("_in")).where("size(_in) > 1")
    a = sound.select("_in", F.posexplode("_in").alias("_i", "split_a"))
    pairs = a.select("split_a", F.explode(F.slice("_in", F.col("_i") + 2, F.size("_in"))).alias("split_b"))
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("n_common"))


def dedup_pairs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def tiny_dropped(components: DataFrame, weight: str, least: int) -> DataFrame:
    """Components that weigh enough."""
    return components.where(F.col(weight) >= least)


def epoch_shards(shards: DataFrame, name: str, wanted: int, epoch: int, seed: int) -> DataFrame:
    """(pick, name) of an epoch: `wanted` of the shards without repeats, or with repeats where there are fewer. shards is a listing, which is small beside the data."""
    n = shards.count()
    if n == 0 or wanted <= 0:
        raise ValueError("no shards, or none wanted")
    ranked = numbered(shards.select(name).withColumn("_h", seeded(seed + epoch, name)), ["_h", name], "_place").drop("_h")
    if wanted <= n:
        return ranked.where(F.col("_place") < wanted).select(F.col("_place").alias("pick"), name)
    picks = shards.sparkSession.range(wanted).select(F.col("id").alias("pick"), F.pmod(stable_hash(F.concat_ws(":", F.lit("again"), "id"), seed + epoch), F.lit(n)).alias("_place"))
    return picks.join(ranked, "_place").select("pick", name)


def slices(df: DataFrame, order: list[str], sizes: dict[str, int]) -> DataFrame:
    """df and part: the first rows in order are the first part, those after them the second, and so on; a part of size -1 takes the rest; what is left over has none."""
    placed, part, start = numbered(df, order, "_place"), F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        inside = F.col("_place") >= start if size < 0 else F.col("_place").between(start, start + size - 1)
        part, start = F.coalesce(part, F.when(inside, name)), start + max(size, 0)
    return placed.withColumn("part", part).drop("_place")


def index_split(df: DataFrame, order: list[str], share: float, seed: int | None = None) -> DataFrame:
    """df and first: whether a row is among the first share of rows, in order or, with a seed, by hash."""
    n = df.count()
    by = order if seed is None else ["_h", *order]
    rows = df if seed is None else df.withColumn("_h", seeded(seed, *order))
    return numbered(rows, by, "_place").withColumn("first", F.col("_place") < int(n * share)).select(*df.columns, "first")


def graph_split(nodes: DataFrame, node: str, part: str, share: float, seed: int) -> DataFrame:
    """nodes and role: train and valid are observed, test nodes are cut by hash into observed ("test_tran") and hidden ones ("test_ind"), a share of them."""
    test = index_split(nodes.where(F.col(part) == "test"), [node], share, seed)
    hidden = test.withColumn("role", F.when(F.col("first"), "test_ind").otherwise("test_tran")).drop("first")
    return nodes.where(F.col(part) != "test").withColumn("role", F.col(part)).unionByName(hidden)


def sampled_groups(df: DataFrame, group: str, least: int, n: int, seed: int) -> DataFrame:
    """Rows of n groups, by hash, of those with enough rows: the sampling operator."""
    chosen = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group).orderBy(seeded(seed, group), group).limit(n)
    return df.join(chosen, group, "left_semi")


def sampled_again(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """(pick ...): n rows; without repeats if there are enough, else with."""
    ranked = numbered(df.withColumn("_h", seeded(seed, *keys)), ["_h", *keys], "_place").drop("_h")
    total = df.count()
    if n <= total:
        return ranked.where(F.col("_place") < n).withColumnRenamed("_place", "pick")
    picks = df.sparkSession.range(n).select(F.col("id").alias("pick"), F.pmod(stable_hash(F.concat_ws(":", F.lit("again"), "id"), seed), F.lit(max(1, total))).alias("_place"))
    return picks.join(ranked, "_place").drop("_place")


def existing_values(parts: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """(value, splits, last): the splits that have a value that isn't empty, and the last of them in order."""
    rows = None
    for k, (name, df) in enumerate(parts):
        own = df.where(F.coalesce(F.trim(value) != "", F.lit(False))).select(F.trim(value).alias(value), F.lit(k).alias("_k"), F.lit(name).alias("_s"))
        rows = own if rows is None else rows.union(own)
    return rows.groupBy(value).agg(F.transform(F.array_sort(F.collect_set(F.struct("_k", "_s"))), lambda x: x["_s"]).alias("splits"), F.max(F.struct("_k", "_s"))["_s"].alias("last"))
