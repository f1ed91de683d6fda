"""Metrics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import metrics as M
from quillon.plans.common import SCORED, rounded, scored, table


def auroc(spark, d):
    return rounded(M.auroc(scored(spark, d), "score", "label"), "auroc")


def average_precision(spark, d):
    return rounded(M.average_precision(scored(spark, d), "score", "label"), "average_precision")


def f1_at_threshold(spark, d):
    return rounded(M.f1(scored(spark, d), "score", "label", 0.4), "f1")


def _enrichment(rounding):
    def query(spark, d):
        return rounded(M.enrichment(scored(spark, d), "score", "label", "event_id", ["user_id"], 0.1, rounding).select("user_id", "n", "k", "enrichment"), "enrichment")

    return query


def recall_at_frac(spark, d):
    return rounded(M.enrichment(scored(spark, d), "score", "label", "event_id", ["user_id"], 0.05).select("user_id", "recall"), "recall")


def precision_at_frac(spark, d):
    return rounded(M.enrichment(scored(spark, d), "score", "label", "event_id", ["user_id"], 0.05).select("user_id", "precision"), "precision")


METRICS = ["top1", "best_in_1", "best_in_5", "best_in_10", "ndcg1", "ndcg5", "ndcg10"]


def group_ranking_metrics(spark, d):
    return rounded(M.group_ranking(scored(spark, d), "score", "truth", "user_id", "event_id"), *METRICS)


def rank_metrics(spark, d):
    per_group = M.group_ranking(scored(spark, d), "score", "truth", "user_id", "event_id")
    return rounded(M.mean_over_groups(per_group, "user_id"), *METRICS)


def ndcg_rank_mode(spark, d):
    return rounded(M.ndcg_by_rank(scored(spark, d), "score", "truth", "user_id", "event_id"), "ndcg")


def regression_metrics(spark, d):
    return rounded(M.regression(scored(spark, d), "score", "truth", ["user_id"]), "mae", "rmse", "pearson", "spearman", digits=10)


def spearman_avg_ties(spark, d):
    ranks = M.average_ranks(scored(spark, d).withColumn("all", F.lit(1)), {"rank_score": "score", "rank_truth": "truth"}, ["event_type"])
    return rounded(ranks.groupBy("event_type").agg(M.correlation("rank_score", "rank_truth").alias("spearman")), "spearman")


def pos_weight(spark, d):
    return rounded(M.positive_weight(scored(spark, d), "label"), "pos_weight")


def standardize_train_stats(spark, d):
    found = M.standardized(table(spark, d, "events").select("event_id", "value"), "value", F.col("event_id") % 10 < 8)
    return rounded(found.groupBy((F.col("event_id") % 10).alias("part")).agg(F.avg("z").alias("mean_z"), F.max("z").alias("max_z")), "mean_z", "max_z")


QUERIES = {
    "auroc": auroc,
    "average_precision": average_precision,
    "f1_at_threshold": f1_at_threshold,
    "enrichment_factor_ceil": _enrichment("ceil"),
    "enrichment_factor_round": _enrichment("round"),
    "recall_at_frac": recall_at_frac,
    "precision_at_frac": precision_at_frac,
    "group_ranking_metrics": group_ranking_metrics,
    "rank_metrics": rank_metrics,
    "ndcg_rank_mode": ndcg_rank_mode,
    "regression_metrics": regression_metrics,
    "spearman_avg_ties": spearman_avg_ties,
    "pos_weight": pos_weight,
    "standardize_train_stats": standardize_train_stats,
}

_TOP = "SELECT user_id, max(n) AS n, max(k) AS k, sum(label) AS hits, sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS top FROM (SELECT *, {k} AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM scored)) GROUP BY user_id"
_CEIL = "greatest(1, CAST(ceil(n * CAST({f} AS DOUBLE)) AS BIGINT))"
_GROUPS = (
    SCORED
    + """,
r AS (SELECT user_id, truth, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS s, row_number() OVER (PARTITION BY user_id ORDER BY truth DESC, event_id) AS t,
 count(*) OVER (PARTITION BY user_id) AS n, min(truth) OVER (PARTITION BY user_id) AS lo, max(truth) OVER (PARTITION BY user_id) AS hi FROM scored),
g AS (SELECT *, pow(2e0, truth - lo) - 1 AS gain FROM r WHERE n >= 2),
per AS (SELECT user_id, max(n) AS n, max(CASE WHEN truth = hi AND s = 1 THEN 1e0 ELSE 0e0 END) AS top1, """
    + ", ".join(f"max(CASE WHEN truth = hi AND s <= greatest(1, ceil(n * CAST({p / 100} AS DOUBLE))) THEN 1e0 ELSE 0e0 END) AS best_in_{p}" for p in (1, 5, 10))
    + ", "
    + ", ".join(f"coalesce(sum(CASE WHEN s <= {k} THEN gain / log2(s + 1) ELSE 0e0 END) / nullif(sum(CASE WHEN t <= {k} THEN gain / log2(t + 1) ELSE 0e0 END), 0), 0e0) AS ndcg{k}" for k in (1, 5, 10))
    + " FROM g GROUP BY user_id)"
)
_RANKS = "(rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2e0)"

ORACLES = {
    "auroc": f"WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rk FROM scored), s AS (SELECT sum(label) AS p, sum(1 - label) AS n, sum(CASE WHEN label = 1 THEN rk ELSE 0e0 END) AS w FROM r) SELECT round((w - p * (p + 1) / 2e0) / (p * n), 6) AS auroc FROM s",
    "average_precision": f"WITH {SCORED}, c AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score), w AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM c) SELECT round(sum(pos * CAST(tp AS DOUBLE) / k) / sum(pos), 6) AS average_precision FROM w",
    "f1_at_threshold": f"WITH {SCORED}, c AS (SELECT count_if(score >= 0.4e0 AND label = 1) AS tp, count_if(score >= 0.4e0 AND label = 0) AS fp, count_if(score < 0.4e0 AND label = 1) AS fn FROM scored) SELECT tp, fp, fn, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
    "enrichment_factor_ceil": f"WITH {SCORED} SELECT user_id, n, k, round(coalesce((top / CAST(k AS DOUBLE)) / nullif(hits / CAST(n AS DOUBLE), 0), 0e0), 6) AS enrichment FROM ({_TOP.format(k=_CEIL.format(f=0.1))})",
    "enrichment_factor_round": f"WITH {SCORED} SELECT user_id, n, k, round(coalesce((top / CAST(k AS DOUBLE)) / nullif(hits / CAST(n AS DOUBLE), 0), 0e0), 6) AS enrichment FROM ({_TOP.format(k='greatest(1, CAST(round_even(n * 0.1e0, 0) AS BIGINT))')})",
    "recall_at_frac": f"WITH {SCORED} SELECT user_id, round(coalesce(top / nullif(CAST(hits AS DOUBLE), 0), 0e0), 6) AS recall FROM ({_TOP.format(k=_CEIL.format(f=0.05))})",
    "precision_at_frac": f"WITH {SCORED} SELECT user_id, round(top / CAST(k AS DOUBLE), 6) AS precision FROM ({_TOP.format(k=_CEIL.format(f=0.05))})",
    "group_ranking_metrics": f"WITH {_GROUPS} SELECT user_id, n, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM per",
    "rank_metrics": f"WITH {_GROUPS} SELECT count(*) AS n_groups, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM per",
    "ndcg_rank_mode": f"WITH {SCORED}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY truth, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM scored), g AS (SELECT *, pow(2e0, (up - 1) / CAST(n - 1 AS DOUBLE)) - 1 AS gain, n - up + 1 AS t FROM r WHERE n >= 2) SELECT user_id, max(n) AS n, round(coalesce(sum(CASE WHEN s <= 10 THEN gain / log2(s + 1) ELSE 0e0 END) / nullif(sum(CASE WHEN t <= 10 THEN gain / log2(t + 1) ELSE 0e0 END), 0), 0e0), 6) AS ndcg FROM g GROUP BY user_id",
    "regression_metrics": f"WITH {SCORED}, r AS (SELECT *, {_RANKS.format(g='user_id', c='score')} AS rp, {_RANKS.format(g='user_id', c='truth')} AS rt FROM scored) SELECT user_id, count(*) AS n, round(avg(abs(score - truth)), 10) AS mae, round(sqrt(avg((score - truth) * (score - truth))), 10) AS rmse, round(CASE WHEN var_pop(score) > 0 AND var_pop(truth) > 0 THEN corr(score, truth) ELSE 0e0 END, 10) AS pearson, round(CASE WHEN var_pop(rp) > 0 AND var_pop(rt) > 0 THEN corr(rp, rt) ELSE 0e0 END, 10) AS spearman FROM r GROUP BY user_id",
    "spearman_avg_ties": f"WITH {SCORED}, r AS (SELECT event_type, {_RANKS.format(g='event_type', c='score')} AS rp, {_RANKS.format(g='event_type', c='truth')} AS rt FROM scored) SELECT event_type, round(corr(rp, rt), 6) AS spearman FROM r GROUP BY event_type",
    "pos_weight": f"WITH {SCORED}, c AS (SELECT sum(label) AS pos, sum(1 - label) AS neg FROM scored) SELECT CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, round(CASE WHEN pos > 0 THEN greatest(neg / CAST(pos AS DOUBLE), 1e0) ELSE 1e0 END, 6) AS pos_weight FROM c",
    "standardize_train_stats": "WITH f AS (SELECT avg(value) AS m, stddev_pop(value) + 1e-6 AS s FROM events WHERE event_id % 10 < 8), z AS (SELECT event_id % 10 AS part, (value - m) / s AS z FROM events, f) SELECT part, round(avg(z), 6) AS mean_z, round(max(z), 6) AS max_z FROM z GROUP BY part",
}
