"""Queries of losses, weights and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import losses as L
from quillon.plans.common import SCORED, rounded, scored, table


def weighted_loss_mean(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("loss"), F.col("l_quantity").alias("masked"))
    return rounded(L.weighted_loss(rows, ["l_returnflag"], "loss", "masked"), "loss", "perplexity")


def pairwise_rank_loss(spark, d):
    return rounded(L.pairwise_rank_loss(scored(spark, d), "user_id", "score", "truth", 0.1, 0.05), "loss")


def list_rank_loss(spark, d):
    return rounded(L.list_rank_loss(scored(spark, d), "user_id", "score", "truth"), "loss")


def masked_zscore(spark, d):
    found = L.masked_zscore(table(spark, d, "events"), ["user_id"], "value", F.col("event_type") != "error")
    return rounded(found.select("event_id", "z"), "z")


def laplace_shares(spark, d):
    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return rounded(L.laplace(n, ["p_brand"], "n", 0.5), "share")


def class_weights(spark, d):
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("k"))
    return rounded(L.class_weights(n, "k", 0.5), "weight")


def two_way_histogram(spark, d):
    at = [F.round(F.get("embedding", i).cast("double") * 10, 4).alias(c) for i, c in enumerate("xy")]
    return L.histogram_2d(table(spark, d, "embeddings").select(*at), "x", "y", -4.0, 4.0, 9)


def first_seen_ids(spark, d):
    return L.first_seen_ids(table(spark, d, "events"), "event_type", "event_id")


QUERIES = {f.__name__: f for f in (weighted_loss_mean, pairwise_rank_loss, list_rank_loss, masked_zscore, laplace_shares, class_weights, two_way_histogram, first_seen_ids)}

_CELL = "least(8, CAST(floor(({c} + 4e0) / 8e0 * 9) AS INTEGER))"
ORACLES = {
    "weighted_loss_mean": "WITH w AS (SELECT l_returnflag, sum(l_discount * 10 * l_quantity) / sum(l_quantity) AS loss FROM lineitem GROUP BY 1) SELECT l_returnflag, round(loss, 6) AS loss, round(exp(least(20e0, loss)), 6) AS perplexity FROM w",
    "pairwise_rank_loss": f"WITH {SCORED}, p AS (SELECT a.user_id, a.score - b.score AS g FROM scored a JOIN scored b ON a.user_id = b.user_id AND a.truth - b.truth > 0.1e0) SELECT user_id, count(*) AS pairs, round(avg(greatest(0e0, 0.05e0 - g)), 6) AS loss FROM p GROUP BY user_id",
    "list_rank_loss": f"WITH {SCORED}, q AS (SELECT user_id, count(*) AS n, ln(sum(exp(score))) AS z, sum(exp(truth) * score) / sum(exp(truth)) AS m FROM scored GROUP BY user_id HAVING count(*) >= 2) SELECT user_id, n, round(z - m, 6) AS loss FROM q",
    "masked_zscore": "WITH f AS (SELECT user_id, avg(value) AS m, var_pop(value) AS v FROM events WHERE event_type <> 'error' GROUP BY user_id) SELECT event_id, round(CASE WHEN event_type <> 'error' THEN (value - m) / sqrt(v + 1e-6) ELSE 0e0 END, 6) AS z FROM events LEFT JOIN f USING (user_id)",
    "laplace_shares": "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type, n, round((n + 0.5e0) / (sum(n) OVER w + count(*) OVER w * 0.5e0), 6) AS share FROM c WINDOW w AS (PARTITION BY p_brand)",
    "class_weights": "WITH c AS (SELECT p_brand, count(*) AS k FROM part GROUP BY 1) SELECT p_brand, k, round(sqrt(CAST(k AS DOUBLE)) / avg(sqrt(CAST(k AS DOUBLE))) OVER (), 6) AS weight FROM c",
    "two_way_histogram": f"WITH e AS (SELECT round(CAST(embedding[1] AS DOUBLE) * 10, 4) AS x, round(CAST(embedding[2] AS DOUBLE) * 10, 4) AS y FROM embeddings) SELECT {_CELL.format(c='x')} AS i, {_CELL.format(c='y')} AS j, count(*) AS n FROM e WHERE x BETWEEN -4 AND 4 AND y BETWEEN -4 AND 4 GROUP BY ALL",
    "first_seen_ids": "SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS id FROM events GROUP BY event_type",
}
