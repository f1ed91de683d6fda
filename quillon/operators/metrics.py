"""Ranking, classification and regression metrics of scored rows. Metrics of a whole table come from counts per distinct score, so that ties count right and no task sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.prefix import numbered, totals_before


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg): rows of either label at each distinct score; rows with a null or NaN score or a null label are left out."""
    sound = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    hit = (F.col(label) > 0).cast("long")
    return sound.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auroc with half credit for ties; 0 if there is one class only."""
    counted = totals_before(score_counts(df, score, label), "score", {"neg_below": "neg"})
    sums = counted.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5e0)).alias("won"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).otherwise(0e0).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the sum over distinct thresholds of precision times the gain in recall; 0 if there is one class only."""
    counts = score_counts(df, score, label).withColumn("down", -F.col("score"))
    counted = totals_before(counts, "down", {"pos_above": "pos", "neg_above": "neg"})
    hits = F.col("pos_above") + F.col("pos")
    sums = counted.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * hits / (hits + F.col("neg_above") + F.col("neg"))).alias("s"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("s") / F.col("p")).otherwise(0e0).alias("average_precision"))


def f1(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: f1 of score >= threshold; 0 without a hit."""
    said, true = F.col(score) >= threshold, F.col(label) > 0
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = df.agg(n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & true).alias("fn"))
    return sums.select("tp", "fp", "fn", F.when(F.col("tp") > 0, 2e0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0e0).alias("f1"))


def _top(df: DataFrame, score: str, label: str, tie: str, groups: list[str], size: Column) -> DataFrame:
    """Per group: n, hits, k (from size, a function of n) and top, the hits among the k rows with the highest scores."""
    of = Window.partitionBy(*groups)
    ranked = df.select(*groups, F.col(label).alias("_y"), F.row_number().over(of.orderBy(F.desc(score), tie)).alias("_rn"), F.count("*").over(of).alias("n"))
    ranked = ranked.withColumn("k", size)
    return ranked.groupBy(*groups).agg(F.max("n").alias("n"), F.max("k").alias("k"), F.sum((F.col("_y") > 0).cast("long")).alias("hits"), F.sum(((F.col("_y") > 0) & (F.col("_rn") <= F.col("k"))).cast("long")).alias("top"))


def top_count(frac: float, rounding: str = "ceil") -> Column:
    """Rows of a top fraction, 1 at least: rounded up, or to the nearest with halves to the even."""
    part = F.col("n") * F.lit(frac)
    return F.greatest(F.lit(1), (F.ceil(part) if rounding == "ceil" else F.bround(part, 0)).cast("long"))


def enrichment(df: DataFrame, score: str, label: str, tie: str, groups: list[str], frac: float, rounding: str = "ceil") -> DataFrame:
    """Per group: enrichment factor (0 without hits), recall and precision at the top fraction."""
    found = _top(df, score, label, tie, groups, top_count(frac, rounding))
    factor = F.when(F.col("hits") > 0, (F.col("top") / F.col("k")) / (F.col("hits") / F.col("n"))).otherwise(0e0)
    return found.select(*groups, "n", "k", factor.alias("enrichment"), F.when(F.col("hits") > 0, F.col("top") / F.col("hits")).otherwise(0e0).alias("recall"), (F.col("top") / F.col("k")).alias("precision"))


def group_ranking(df: DataFrame, score: str, truth: str, group: str, tie: str, fracs=(0.01, 0.05, 0.1), ks=(1, 5, 10)) -> DataFrame:
    """One row per group of two rows or more: top1, best_in_<percent> and ndcg<k>, gains 2^(truth - least truth) - 1."""
    of = Window.partitionBy(group)
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(
        F.col(group).alias("_group"), F.col(truth).alias("_y"), F.col(score).alias("_s"), F.col(tie).alias("_tie")
    )
    of = Window.partitionBy("_group")
    rows = rows.select(
        "_group",
        "_y",
        F.row_number().over(of.orderBy(F.desc("_s"), "_tie")).alias("by_score"),
        F.row_number().over(of.orderBy(F.desc("_y"), "_tie")).alias("by_truth"),
        F.count("*").over(of).alias("n"),
        F.min("_y").over(of).alias("least"),
        F.max("_y").over(of).alias("best"),
    ).where("n >= 2")
    gain = F.pow(F.lit(2e0), F.col("_y") - F.col("least")) - 1
    part = lambda rank, k: F.sum(F.when(F.col(rank) <= k, gain / F.log2(F.col(rank) + F.lit(1e0))).otherwise(0e0))
    is_best = F.col("_y") == F.col("best")
    aggregates = [F.max("n").alias("n"), F.max((is_best & (F.col("by_score") == 1)).cast("double")).alias("top1")]
    for f in fracs:
        aggregates.append(F.max((is_best & (F.col("by_score") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(f))))).cast("double")).alias(f"best_in_{round(100 * f)}"))
    for k in ks:
        ideal, got = part("by_truth", k), part("by_score", k)
        aggregates.append(F.when(ideal > 0, got / ideal).otherwise(0e0).alias(f"ndcg{k}"))
    return rows.groupBy(F.col("_group").alias(group)).agg(*aggregates)


def mean_over_groups(per_group: DataFrame, group: str) -> DataFrame:
    """One row: n_groups and the plain mean of every metric."""
    metrics = [c for c in per_group.columns if c not in (group, "n")]
    return per_group.agg(F.count("*").alias("n_groups"), *[F.avg(c).alias(c) for c in metrics])


def ndcg_by_rank(df: DataFrame, score: str, truth: str, group: str, tie: str, k: int = 10) -> DataFrame:
    """Per group of two rows or more: ndcg at k where the gain comes from the truth's rank, evenly from 0 to 1."""
    of = Window.partitionBy(group)
    rows = df.select(group, F.row_number().over(of.orderBy(truth, tie)).alias("up"), F.row_number().over(of.orderBy(F.desc(score), tie)).alias("by_score"), F.count("*").over(of).alias("n")).where("n >= 2")
    gain = F.pow(F.lit(2e0), (F.col("up") - 1) / (F.col("n") - 1)) - 1
    rows = rows.select(group, "n", gain.alias("gain"), "by_score", (F.col("n") - F.col("up") + 1).alias("by_truth"))
    part = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col("gain") / F.log2(F.col(rank) + F.lit(1e0))).otherwise(0e0))
    return rows.groupBy(group).agg(F.max("n").alias("n"), F.when(part("by_truth") > 0, part("by_score") / part("by_truth")).otherwise(0e0).alias("ndcg"))


def average_ranks(df: DataFrame, columns: dict[str, str], groups: list[str], large: bool = True) -> DataFrame:
    """df and ranks from 1 within each group, ties at their mean. They come from counts of distinct values, which are sorted by ranges, so that a group may be large; where
    groups are many and small, large=False sorts each in one task instead, which costs no extra pass."""
    if not large:
        for name, column in columns.items():
            ties = Window.partitionBy(*groups, column)
            df = df.withColumn(name, F.rank().over(Window.partitionBy(*groups).orderBy(column)) + (F.count("*").over(ties) - 1) / F.lit(2e0))
        return df
    for name, column in columns.items():
        keys = [*groups, column]
        counts = totals_before(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys, {"_before": "_n"})
        first = counts.groupBy(*groups).agg(F.min("_before").alias("_start")) if groups else counts.agg(F.min("_before").alias("_start"))
        ranks = _null_safe(counts, first, groups) if groups else counts.join(F.broadcast(first))
        ranks = ranks.select(*keys, (F.col("_before") - F.col("_start") + (F.col("_n") + 1) / F.lit(2e0)).alias(name))
        df = _null_safe(df, ranks, keys)
    return df


def _null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df joined with other by keys, of which nulls are equal; the keys once."""
    named = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(named, same).drop(*[f"_k_{k}" for k in keys])


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation as an aggregate; 0 where one side is constant, which F.corr takes for a division by zero."""
    return F.coalesce(F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0e0)), F.lit(0e0))


def regression(df: DataFrame, predicted: str, truth: str, groups: list[str], large: bool = False) -> DataFrame:
    """Per group: n, mae, rmse, pearson and spearman (mean ranks of ties); correlations are 0 where one side is constant. large: see average_ranks."""
    sound = df.where(F.col(predicted).isNotNull() & F.col(truth).isNotNull())
    ranked = average_ranks(sound, {"_rp": predicted, "_rt": truth}, groups, large)
    p, t = F.col(predicted), F.col(truth)
    return ranked.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(F.abs(p - t)).alias("mae"), F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"), correlation(p, t).alias("pearson"), correlation(F.col("_rp"), F.col("_rt")).alias("spearman")
    )


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives by positives, 1 at least; 1 without positives."""
    pos, neg = F.sum((F.col(label) > 0).cast("long")), F.sum((F.col(label) <= 0).cast("long"))
    return df.agg(pos.alias("pos"), neg.alias("neg"), F.when(pos > 0, F.greatest(neg / pos, F.lit(1e0))).otherwise(1e0).alias("pos_weight"))


def standardized(df: DataFrame, value: str, is_train: Column, eps: float = 1e-6) -> DataFrame:
    """df and z: value by the mean and population deviation of the training rows."""
    fitted = df.where(is_train).agg(F.avg(value).alias("_mean"), (F.stddev_pop(value) + F.lit(eps)).alias("_std"))
    return df.join(F.broadcast(fitted)).withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_std")).drop("_mean", "_std")


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def logit_block(df: DataFrame, logit: str, y: str, threshold: float = 0.5) -> DataFrame:
    """One row: auroc, average_precision and f1 of the probabilities, the threshold, and the probabilities' mean and population deviation; the metrics are 0 for one class."""
    rows = df.select(probability(F.col(logit)).alias("p"), (F.col(y) > 0.5).cast("int").alias("y"))
    spread = rows.agg(F.avg("p").alias("prob_mean"), F.stddev_pop("p").alias("prob_std"), (F.min("y") < F.max("y")).alias("_two"))
    found = auroc(rows, "p", "y").crossJoin(average_precision(rows, "p", "y")).crossJoin(f1(rows, "p", "y", threshold).select("f1")).crossJoin(spread)  # one row each
    return found.select("auroc", "average_precision", F.when(F.col("_two"), F.col("f1")).otherwise(0e0).alias("f1"), F.lit(threshold).alias("threshold"), "prob_mean", "prob_std")


def top_enrichment(df: DataFrame, score: str, label: str, tie: str, fracs: tuple[float, ...], rounding: str = "even") -> DataFrame:
    """One row over a whole table: ef<percent> of each top fraction, 0 without hits. Rows are placed by ranges, so that no task sorts the table."""
    placed = numbered(df.select(F.col(score).alias("_s"), F.col(tie).alias("_t"), (F.col(label) > 0.5).cast("long").alias("_y")), [F.desc("_s"), "_t"], "_place")
    all_of = df.agg(F.count("*").alias("n"), F.sum((F.col(label) > 0.5).cast("long")).alias("hits")).select("n", "hits", *[top_count(f, rounding).alias(f"k{i}") for i, f in enumerate(fracs)])
    tops = placed.join(F.broadcast(all_of)).agg(F.max("n").alias("n"), F.max("hits").alias("hits"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(len(fracs))], *[F.sum(F.when(F.col("_place") < F.col(f"k{i}"), F.col("_y")).otherwise(0)).alias(f"t{i}") for i in range(len(fracs))])
    return tops.select(*[F.when(F.col("hits") > 0, (F.col(f"t{i}") / F.col(f"k{i}")) / (F.col("hits") / F.col("n"))).otherwise(0e0).alias(f"ef{round(100 * f)}") for i, f in enumerate(fracs)])


def ranking_cls(df: DataFrame, logit: str, y: str, tie: str, fracs: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """One row: auroc, average_precision and the enrichment at top fractions of the probabilities."""
    rows = df.select(probability(F.col(logit)).alias("p"), (F.col(y) > 0.5).cast("int").alias("y"), tie)
    return auroc(rows, "p", "y").crossJoin(average_precision(rows, "p", "y")).crossJoin(top_enrichment(rows, "p", "y", tie, fracs))  # one row each


def affinity_ranking(df: DataFrame, predicted: str, truth: str, mask: Column, tie: str, ks: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """One row over the masked rows: aff_n, spearman, pearson and ndcg<k> with gains from the truth's rank; zeros for fewer than three."""
    rows = df.where(mask).select(F.col(predicted).alias("p"), F.col(truth).alias("t"), F.col(tie).alias("i"))
    ranked = average_ranks(rows, {"rp": "p", "rt": "t"}, [])
    sums = ranked.agg(F.count("*").alias("aff_n"), correlation("rp", "rt").alias("spearman"), correlation("p", "t").alias("pearson"))
    placed = numbered(numbered(rows, ["t", "i"], "up"), [F.desc("p"), "i"], "at").join(F.broadcast(sums.select(F.col("aff_n").alias("_n"))))
    gain = F.pow(F.lit(2e0), F.col("up") / (F.col("_n") - 1)) - 1
    part = lambda place, k: F.sum(F.when(place < k, gain / F.log2(place + F.lit(2e0))).otherwise(0e0))
    best = F.col("_n") - 1 - F.col("up")
    shares = placed.where("_n > 1").agg(*[(part(F.col("at"), k) / part(best, k)).alias(f"ndcg{k}") for k in ks])
    enough = F.col("aff_n") >= 3
    return sums.crossJoin(shares).select("aff_n", *[F.when(enough, F.coalesce(c, F.lit(0e0))).otherwise(0e0).alias(c) for c in ("spearman", "pearson", *[f"ndcg{k}" for k in ks])])  # one row each


def argmax_accuracy(df: DataFrame, scores: str, label: str) -> DataFrame:
    """One row: the share of rows whose largest score, the first of equals, is at the label."""
    return df.agg(F.avg((F.array_position(scores, F.array_max(scores)) - 1 == F.col(label)).cast("double")).alias("accuracy"))
