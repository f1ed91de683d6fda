"""Logs, JSON documents and windows in time. Log lines are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.sources import logs as L
from quillon.streaming.codebook_stream import windowed_counts
from quillon.plans.common import rounded, table


def log_parse_init(spark, d):
    lines = table(spark, d, "part").select(F.format_string("x [init_embed_] Z=6_%d_%d N=%d K_req=%d K_run=%d K_used=%d/%d", F.col("p_size"), F.col("p_partkey") % 3, "p_partkey", F.col("p_size"), F.col("p_size"), F.col("p_size") - 1, F.col("p_size")).alias("line"))
    other = table(spark, d, "part").select(F.col("p_name").alias("line"))
    return L.init_lines(lines.union(other)).groupBy("key").agg(F.max("n").alias("n"), F.sum("k_used").alias("k_used"))


def log_parse_silhouette(spark, d):
    """Epochs from marker lines, then the mean of positive scores by epoch."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 500 == 0, F.lit("x [CODEBOOK] mode=init")).otherwise(F.format_string("x Silhouette Score (subsample): 6_%d %s0.%02d, sample size %d, K_e %d", F.col("user_id"), F.when(F.col("event_id") % 7 == 0, "-").otherwise(""), F.col("event_id") % 100, F.col("event_id"), F.col("user_id")))
    rows = A.epoch_of_log(e.select("event_id", line.alias("line")), "event_id", L.is_epoch_marker(F.col("line")))
    return rounded(A.dense_mean(L.silhouette_lines(rows), "epoch", "score"), "mean")


def json_metric_alias(spark, d):
    e = table(spark, d, "events")
    doc = F.when(F.col("event_id") % 2 == 0, F.format_string('{"valid_metrics": {"auroc": %d}}', F.col("event_id"))).when(F.col("event_id") % 3 == 0, F.format_string('{"valid": {"auroc": %d}}', F.col("event_id"))).otherwise(F.lit('{"valid": {"auroc": null}}'))
    return e.select("event_id", L.metric(doc, ["valid_metrics", "valid"], "auroc").alias("auroc"))


def event_windows(spark, d):
    """An extension: tumbling windows of a day."""
    found = windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return rounded(found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), "total", digits=4)


def grouping_cube(spark, d):
    """An extension: all totals of two flags."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


QUERIES = {f.__name__: f for f in (log_parse_init, log_parse_silhouette, json_metric_alias, event_windows, grouping_cube)}
ORACLES = {
    "log_parse_init": "SELECT '6_' || p_size || '_' || (p_partkey % 3) AS key, max(p_partkey) AS n, CAST(sum(p_size - 1) AS BIGINT) AS k_used FROM part GROUP BY 1",
    "log_parse_silhouette": "WITH r AS (SELECT event_id, CAST(sum(CASE WHEN event_id % 500 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS epoch, CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END * (event_id % 100) / 100e0 AS score FROM events), m AS (SELECT epoch, avg(score) AS mean FROM r WHERE event_id % 500 <> 0 AND score > 0 GROUP BY epoch) SELECT e AS epoch, round(coalesce(mean, 0e0), 6) AS mean FROM range(0, (SELECT max(epoch) + 1 FROM r)) s(e) LEFT JOIN m ON epoch = e",
    "json_metric_alias": "SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END AS auroc FROM events",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "grouping_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
