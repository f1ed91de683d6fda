"""Aggregations and windows of curation and log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.quantiles import quantiles
from quillon.plans.prefix import totals_before


def entity_stats(df: DataFrame, key: str, label: str) -> DataFrame:
    """Per key that isn't null or empty: n, pos, neg and pos_rate of rows with a label."""
    sound = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & F.col(label).isNotNull())
    pos = F.sum(F.col(label).cast("long"))
    return sound.groupBy(key).agg(F.count("*").alias("n"), pos.alias("pos"), (F.count("*") - pos).alias("neg"), (pos / F.count("*")).alias("pos_rate"))


def two_level(df: DataFrame, outer: list[str], entity: str, value: Column) -> DataFrame:
    """Per outer key: over its entities, the mean, median, sample deviation, least and most of each entity's aggregate `value`, and their number."""
    inner = df.groupBy(*outer, entity).agg(value.cast("double").alias("_v"))
    return inner.groupBy(*outer).agg(
        F.count("*").alias("entities"), F.avg("_v").alias("mean"), F.percentile("_v", F.lit(0.5e0)).alias("median"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("least"), F.max("_v").alias("most")
    )


def most_common(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values, equals by value: a report, not a filter."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) for all bins from 1; values outside are left out, the upper end is in the last bin."""
    v = F.col(value)
    number = F.least(F.lit(bins), F.floor((v - low) / (high - low) * bins).cast("int") + 1)
    counts = df.where(v.between(low, high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_rollup(df: DataFrame, key: str, prefix: str, value: str) -> DataFrame:
    """Totals by what follows the prefix in the key; "(base)" for the prefix alone; other keys are left out."""
    bare = F.regexp_replace(key, f"^{prefix}_?", "")
    inside = df.where((F.col(key) == prefix) | F.col(key).startswith(f"{prefix}_"))
    return inside.groupBy(F.when(bare == "", "(base)").otherwise(bare).alias("suffix")).agg(F.sum(value).alias("total"))


def rolling_mean(df: DataFrame, groups: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """df and rolling: the mean of the last `width` rows of the group, fewer at its start."""
    return df.withColumn("rolling", F.avg(value).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(-(width - 1), 0)))


def running_offsets(df: DataFrame, key: str, size: str, groups: list[str] | None = None) -> DataFrame:
    """df (a row per key) and offset: the total size of the keys before it. Without groups the table has to be one of keys, not of data."""
    w = Window.partitionBy(*(groups or [])).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("offset", (F.sum(size).over(w) - F.col(size)).cast("long"))


def argmax_row(df: DataFrame, groups: list[str], value: str, tie: str) -> DataFrame:
    """Per group the row with the largest value that isn't null, the first by tie of equals."""
    w = Window.partitionBy(*groups).orderBy(F.desc(value), tie)
    return df.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def epoch_of_lines(df: DataFrame, groups: list[str], order: str, is_marker: Column) -> DataFrame:
    """df and epoch: the number of marker lines so far in the group, this one included."""
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("epoch", F.sum(is_marker.cast("long")).over(w))


def epoch_of_log(df: DataFrame, order: str, is_marker: Column) -> DataFrame:
    """As epoch_of_lines for one long log, whose lines are sorted by ranges."""
    marked = df.withColumn("_mark", is_marker.cast("long"))
    return totals_before(marked, order, {"epoch": "_mark"}).withColumn("epoch", F.col("epoch") + F.col("_mark")).drop("_mark")


def dense_mean(df: DataFrame, epoch: str, value: str) -> DataFrame:
    """(epoch, mean) for every epoch from 0 to the last: the mean of positive values, 0 without any."""
    means = df.where(F.col(value) > 0).groupBy(epoch).agg(F.avg(value).alias("mean"))
    spine = df.agg(F.max(epoch).alias("last")).select(F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("_e"))
    return spine.join(means, F.col("_e") == F.col(epoch), "left").select(F.col("_e").cast("long").alias(epoch), F.coalesce("mean", F.lit(0e0)).alias("mean"))


def entropy_metrics(counts: DataFrame, groups: list[str], n: str) -> DataFrame:
    """Per group of cluster counts: total, k_used, max_share, top5_share, entropy (natural), perplexity, singleton_clusters and singleton_points, as shares."""
    used = counts.where(F.col(n) > 0)
    of = Window.partitionBy(*groups)
    ranked = used.withColumn("_t", F.sum(n).over(of)).withColumn("_rn", F.row_number().over(of.orderBy(F.desc(n))))
    p = F.col(n) / F.col("_t")
    entropy = -F.sum(p * F.log(p))
    return ranked.groupBy(*groups).agg(
        F.sum(n).cast("long").alias("total"),
        F.count("*").alias("k_used"),
        F.max(p).alias("max_share"),
        F.sum(F.when(F.col("_rn") <= 5, p).otherwise(0e0)).alias("top5_share"),
        entropy.alias("entropy"),
        F.exp(entropy).alias("perplexity"),
        F.avg((F.col(n) == 1).cast("double")).alias("singleton_clusters"),
        F.sum(F.when(F.col(n) == 1, p).otherwise(0e0)).alias("singleton_points"),
    )


def contingency_entropy(df: DataFrame, code: str, kind: str) -> DataFrame:
    """(code, n, entropy): how mixed the kinds of each code are."""
    counts = df.groupBy(code, kind).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(code))
    return counts.withColumn("_p", p).groupBy(code).agg(F.sum("_n").alias("n"), (-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"))


def equivalence_groups(df: DataFrame, vector: str, row: str) -> DataFrame:
    """(size, first, last) of the rows with equal vectors, for groups of two or more."""
    return df.groupBy(vector).agg(F.count("*").alias("size"), F.min(row).alias("first"), F.max(row).alias("last")).where("size > 1").drop(vector)


def target_encoding(df: DataFrame, category: str, order: str, target: str, prior: float, strength: float) -> DataFrame:
    """df (rows with a category) and encoded: the mean target of earlier rows of the category, drawn to the prior. Rows are sorted by ranges, so that a category may be large."""
    one = F.when(F.col(target).isNotNull(), 1).otherwise(0).cast("long")
    run = totals_before(df.where(F.col(category).isNotNull()).withColumn("_one", one), [category, order], {"_total": target, "_n": "_one"})
    start = run.groupBy(category).agg(F.min(F.struct(order, "_total", "_n")).alias("_s")).select(category, F.col("_s._total").alias("_t0"), F.col("_s._n").alias("_n0"))
    encoded = (F.col("_total") - F.col("_t0") + prior * strength) / (F.col("_n") - F.col("_n0") + strength)
    return run.join(start, category).select(*df.columns, encoded.alias("encoded"))


def min_max(df: DataFrame, value: str, is_train: Column) -> DataFrame:
    """df and scaled: by the least and most of the training rows; a null counts as the least minus one before scaling."""
    fitted = df.where(is_train).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    filled = F.coalesce(F.col(value), F.col("_lo") - 1)
    return df.join(F.broadcast(fitted)).withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (filled - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0e0)).drop("_lo", "_hi")


def token_stats(df: DataFrame, token: str) -> DataFrame:
    """One row: the least, the largest, the distinct and all tokens."""
    return df.agg(F.min(token).alias("least"), F.max(token).alias("most"), F.countDistinct(token).alias("distinct_tokens"), F.count(token).alias("n"))


def frequent_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of classes with more than `least` of them."""
    return df.join(df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(label), label, "left_semi")


def values_at(df: DataFrame, key: str, places: tuple[int, ...], sep: str = "_") -> DataFrame:
    """(place, n, found): the distinct fields of a key at each place, from 0, and their number."""
    field = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.get(F.split(key, sep), p).alias("v")) for p in places])).alias("f")
    return df.select(field).where("f.v IS NOT NULL").groupBy("f.place").agg(F.countDistinct("f.v").alias("n"), F.array_join(F.array_sort(F.collect_set("f.v")), " ").alias("found"))


def last_epoch(df: DataFrame, epoch: str) -> DataFrame:
    """Rows of the largest epoch."""
    return df.join(F.broadcast(df.agg(F.max(epoch).alias(epoch))), epoch)


def boxes(df: DataFrame, epoch: str, value: str) -> DataFrame:
    """(epoch, n, least, q25, q50, q75, most): what a box of each epoch shows."""
    names = {f"q{round(100 * p)}": p for p in (0.25, 0.5, 0.75)}
    ends = df.groupBy(F.col(epoch).alias("_epoch")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    joined = ends.join(quantiles(df, [epoch], value, names), F.col("_epoch").eqNullSafe(F.col(epoch)), "left")
    return joined.select(F.col("_epoch").alias(epoch), "n", "least", *names, "most")


def top_scores(df: DataFrame, score: str, n: str, k: str, tie: str, least_n: int, least_k: int, rows: int = 30, strict: float = 0.35, loose: float = 0.25) -> DataFrame:
    """The best and the worst rows among those with enough points and classes, told apart by end, and whether each passes the strict and the loose bound: a report."""
    good = df.where((F.col(n) >= least_n) & (F.col(k) >= least_k)).withColumn("strict", F.col(score) >= strict).withColumn("loose", F.col(score) >= loose)
    return good.orderBy(F.desc(score), tie).limit(rows).withColumn("end", F.lit("best")).union(good.orderBy(score, tie).limit(rows).withColumn("end", F.lit("worst")))


def row_shares(df: DataFrame, row: str, value: str) -> DataFrame:
    """df and share: the value by the sum of its row; 0 for a row of zeros."""
    total = F.sum(value).over(Window.partitionBy(row))
    return df.withColumn("share", F.when(total != 0, F.col(value) / total).otherwise(0e0))


def one_hot(value: Column, categories: list) -> Column:
    """An array with 1 at the category of a value and 0 elsewhere."""
    return F.array(*[F.coalesce((value == c).cast("int"), F.lit(0)) for c in categories])


def bin_counts(df: DataFrame, value: str, size: int) -> DataFrame:
    """(bin, n) for every number from 0 below size; what lies outside is left out."""
    counts = df.where(F.col(value).between(0, size - 1)).groupBy(F.col(value).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(size).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_signature(counts: DataFrame, groups: list[str], n: str, eps: float = 1e-12) -> DataFrame:
    """Per group of counts: total, used (those above 0), most, max_share and entropy, of which eps keeps the logarithm finite."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*groups))
    rows = counts.withColumn("_p", F.when(F.sum(n).over(Window.partitionBy(*groups)) > 0, p).otherwise(0e0))
    return rows.groupBy(*groups).agg(F.sum(n).alias("total"), F.count(F.when(F.col(n) > 0, 1)).alias("used"), F.max(n).alias("most"), F.max("_p").alias("max_share"), (-F.sum(F.col("_p") * F.log(F.col("_p") + F.lit(eps)))).alias("entropy"))
