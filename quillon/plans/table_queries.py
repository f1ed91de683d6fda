"""Joins, aggregates, windows, splits and audits over the interaction tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.operators import joins as J
from quillon.operators import splits as S
from quillon.plans.common import INTERACTIONS, interactions, rounded, table


def _tokens(spark, d):
    """Tokens of parts: some are empty or missing."""
    p = table(spark, d, "part")
    return p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("lig"), F.when(F.col("p_size") < 10, "").otherwise(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))).alias("tok"))


_TOKENS = "tok AS (SELECT p_partkey AS lig, CASE WHEN p_size < 10 THEN '' ELSE p_brand || ' ' || p_size END AS tok FROM part WHERE p_partkey % 7 <> 0)"


def _labelled(spark, d):
    return interactions(spark, d).withColumn("label", (F.col("y") >= 25).cast("int"))


_LABELLED = f"{INTERACTIONS}, lab AS (SELECT *, CASE WHEN y >= 25 THEN 1 ELSE 0 END AS label FROM inter)"


def token_join_inner(spark, d):
    return J.token_join(interactions(spark, d), _tokens(spark, d), "lig", "tok").groupBy("tok").agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"))


def token_join_missing(spark, d):
    return J.missing_tokens(interactions(spark, d), _tokens(spark, d), "lig", "tok").groupBy("lig").agg(F.count("*").alias("n"))


def entity_semi_join(spark, d):
    kept = J.entity_semi_join(_labelled(spark, d), {"prot": 8, "lig": 25}, "label", 0.4, 0.6)
    return kept.groupBy("prot").agg(F.count("*").alias("n"), F.countDistinct("lig").alias("ligs"))


def cluster_semi_join(spark, d):
    rows = _labelled(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("prot"), F.col("s_nationkey").alias("cluster")), "prot")
    good = J.good_entities(rows, "cluster", "label", 8, 0.51, 0.9)
    return rows.join(good, "cluster", "left_semi").groupBy("cluster").agg(F.count("*").alias("n"))


def left_lookup(spark, d):
    clusters = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("prot"), F.col("s_nationkey").alias("cluster"))
    return interactions(spark, d).join(clusters, "prot", "left").groupBy("cluster").agg(F.count("*").alias("n"))


def priority_lookup(spark, d):
    """The best order of each customer: finished ones first, then by price, then by number."""
    o = table(spark, d, "orders")
    order = [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.desc("o_totalprice"), F.col("o_orderkey")]
    return J.first_by(o, ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderstatus")


def match_cascade(spark, d):
    """A value for each part from three tables in order."""
    p = table(spark, d, "part")
    by_key = p.where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("k1"), F.concat(F.lit("key "), F.col("p_partkey").cast("string")).alias("match"))
    by_brand = p.where("p_size < 5").groupBy(F.col("p_brand").alias("k2")).agg(F.concat(F.lit("brand "), F.max("p_partkey").cast("string")).alias("match"))
    by_type = p.where("p_size > 45").groupBy(F.col("p_type").alias("k3")).agg(F.concat(F.lit("type "), F.max("p_partkey").cast("string")).alias("match"))
    found = J.cascade(p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand"), "p_type"), [(by_key, F.col("p_partkey") == F.col("k1")), (by_brand, F.col("brand") == F.col("k2")), (by_type, F.col("p_type") == F.col("k3"))], "match")
    return found.select("p_partkey", "match")


def exclusion_anti(spark, d):
    core = interactions(spark, d).where("ord % 10 = 0").select("prot", "lig").distinct()
    return interactions(spark, d).join(core, ["prot", "lig"], "left_anti").groupBy("prot").agg(F.count("*").alias("n"))


def matrix_expansion(spark, d):
    """Long rows of a matrix in an array column: every component."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "value"))
    return e.select("vec_id", F.col("col").cast("long").alias("col"), F.round(F.col("value").cast("double"), 6).alias("value"))


def entity_stats(spark, d):
    return rounded(A.entity_stats(_labelled(spark, d), "lig", "label"), "pos_rate")


def split_summary(spark, d):
    rows = interactions(spark, d).withColumn("split", F.when(F.col("ord") % 10 < 8, "train").when(F.col("ord") % 10 == 8, "valid").otherwise("test"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("prot").alias("prots"), F.countDistinct("lig").alias("ligs"))


def balance_summary(spark, d):
    found = A.two_level(_labelled(spark, d).withColumn("split", F.col("ord") % 3), ["split"], "prot", F.avg("label"))
    return rounded(found, "mean", "median", "std", "least", "most")


def pair_stats(spark, d):
    return rounded(A.two_level(interactions(spark, d).withColumn("split", F.col("ord") % 3), ["split"], "lig", F.count("*")), "mean", "median", "std")


def describe_groups(spark, d):
    sizes = interactions(spark, d).groupBy("ord").agg(F.count("*").alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return rounded(sizes.agg(F.count("*").alias("groups"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.avg((F.col("n") == 1).cast("double")).alias("single")), "mean", "std", "single")


def key_freq_sum(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("most"))


def histogram_bins(spark, d):
    return A.histogram(table(spark, d, "lineitem").withColumn("share", F.col("l_discount") * 10), "share", 0.0, 1.0, 10)


def rolling_mean_20(spark, d):
    found = A.rolling_mean(table(spark, d, "events").where("event_id >= 1000"), ["user_id"], ["event_id"], "value", 20)
    return rounded(found.select("event_id", "rolling"), "rolling")


def running_offsets(spark, d):
    sizes = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("k"))
    return A.running_offsets(sizes, "p_brand", "k")


def argmax_per_run(spark, d):
    return A.argmax_row(table(spark, d, "events"), ["user_id"], "value", "event_id").select("user_id", "event_id", "event_type", "value")


def mean_std_by_method(spark, d):
    found = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("std"), F.stddev_pop("l_quantity").alias("std_pop"))
    return rounded(found, "mean", "std", "std_pop")


def epoch_from_markers(spark, d):
    found = A.epoch_of_lines(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error")
    return found.groupBy("user_id", "epoch").agg(F.count("*").alias("n"))


def dense_epoch_mean(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 40 * 2).alias("epoch"), F.when(F.col("event_id") % 40 < 30, F.col("value")).otherwise(-1.0).alias("ss"))
    return rounded(A.dense_mean(rows, "epoch", "ss"), "mean")


def prefix_rollup(spark, d):
    rows = table(spark, d, "part").select(F.when(F.col("p_size") < 5, F.lit("6_0")).otherwise(F.concat_ws("_", F.lit("6_0"), F.col("p_size") % 10)).alias("key"), F.col("p_size").alias("n"))
    return A.prefix_rollup(rows, "key", "6_0", "n")


def top20_reasons(spark, d):
    return A.most_common(table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("reason")), "reason", 20)


def equivalence_groups(spark, d):
    return A.equivalence_groups(table(spark, d, "part"), "p_retailprice", "p_partkey")


def contingency_entropy(spark, d):
    return rounded(A.contingency_entropy(table(spark, d, "part"), "p_brand", "p_type"), "entropy")


def target_encoding(spark, d):
    cents = table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return A.target_encoding(cents, "event_type", "event_id", "cents", 4000.0, 1.0).select("event_id", "encoded")


def min_max_scale(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 > 0, F.col("p_retailprice")).alias("v"))
    return rounded(A.min_max(rows, "v", F.col("p_partkey") % 2 == 0).select("p_partkey", "scaled"), "scaled")


def status_shares(spark, d):
    n = table(spark, d, "orders").groupBy(F.substring_index("o_orderpriority", "-", 1).alias("class")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def _clusters(spark, d):
    rows = _labelled(spark, d).groupBy(F.col("lig").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate"))
    return rows


def stratified_block_split(spark, d):
    return S.block_split(_clusters(spark, d), [F.desc("n"), F.desc(F.abs(F.col("rate") - 0.5e0))], "cluster", 11).select("cluster", "n", "split")


def balanced_undersample(spark, d):
    kept = S.balanced(_labelled(spark, d), "lig", "label", 5, ["prot", "ord", "line"])
    return kept.groupBy("lig", "label").agg(F.count("*").alias("n"), F.sum("ord").alias("sum_ord"))


def file_split(spark, d):
    return S.share_split(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 0.13, 3)


def per_class_sample(spark, d):
    return S.per_class(table(spark, d, "part"), "p_brand", 3, 9, ["p_partkey"]).select("p_brand", "p_partkey")


def random_sample(spark, d):
    return S.sample_rows(table(spark, d, "orders").select("o_orderkey"), 500, 123, ["o_orderkey"])


def _split_rows(spark, d):
    return interactions(spark, d).withColumn("split", F.when(F.col("ord") % 10 < 8, "train").when(F.col("ord") % 10 == 8, "valid").otherwise("test"))


_SPLIT = "sp AS (SELECT *, CASE WHEN ord % 10 < 8 THEN 'train' WHEN ord % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM inter)"


def entity_overlap(spark, d):
    return S.overlap(_split_rows(spark, d), "split", ["lig"])


def pair_overlap(spark, d):
    return S.overlap(_split_rows(spark, d), "split", ["prot", "lig"])


def leakage_audit(spark, d):
    found = _split_rows(spark, d).groupBy("ord").agg(F.countDistinct("split").alias("splits"))
    return found.groupBy("splits").agg(F.count("*").alias("n"))


def guide_split_case(spark, d):
    flags = _split_rows(spark, d).groupBy("prot", "lig").agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "valid", "test")])
    return flags.groupBy(S.guide_split(F.col("train") == 1, F.col("valid") == 1, F.col("test") == 1).alias("guide")).agg(F.count("*").alias("n"))


def dedup_pairs(spark, d):
    return S.dedup_pairs(interactions(spark, d), ["prot", "lig"], ["ord", "line", "y"]).groupBy("prot").agg(F.count("*").alias("n"), F.sum("ord").alias("sum_ord"), F.sum("y").alias("sum_y"))


def token_intersection(spark, d):
    words = lambda name, key: table(spark, d, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    return words("benchmark", "item_id").intersect(words("documents", "doc_id")).groupBy(F.length("w").cast("long").alias("length")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (token_join_inner, token_join_missing, entity_semi_join, cluster_semi_join, left_lookup, priority_lookup, match_cascade, exclusion_anti, matrix_expansion, entity_stats, split_summary, balance_summary, pair_stats, describe_groups, key_freq_sum, histogram_bins, rolling_mean_20, running_offsets, argmax_per_run, mean_std_by_method, epoch_from_markers, dense_epoch_mean, prefix_rollup, top20_reasons, equivalence_groups, contingency_entropy, target_encoding, min_max_scale, status_shares, stratified_block_split, balanced_undersample, file_split, per_class_sample, random_sample, entity_overlap, pair_overlap, leakage_audit, guide_split_case, dedup_pairs, token_intersection)}


def _h(seed: int, text: str) -> str:
    return f"('0x' || substring(sha1('{seed}|' || {text}), 1, 15))::BIGINT"


_OVERLAP = "SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_common FROM (SELECT DISTINCT split, {c} FROM sp) a JOIN (SELECT DISTINCT split, {c} FROM sp) b USING ({c}) WHERE a.split < b.split GROUP BY ALL"
_TWO = "round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std"
ORACLES = {
    "token_join_inner": f"WITH {INTERACTIONS}, {_TOKENS} SELECT tok, count(*) AS n, sum(y) AS sum_y FROM inter JOIN tok USING (lig) WHERE trim(tok) <> '' GROUP BY tok",
    "token_join_missing": f"WITH {INTERACTIONS}, {_TOKENS} SELECT lig, count(*) AS n FROM inter WHERE lig NOT IN (SELECT lig FROM tok WHERE trim(tok) <> '') GROUP BY lig",
    "entity_semi_join": f"WITH {_LABELLED}, p AS (SELECT prot FROM lab GROUP BY prot HAVING count(*) >= 8 AND avg(label) BETWEEN 0.4 AND 0.6), l AS (SELECT lig FROM lab GROUP BY lig HAVING count(*) >= 25 AND avg(label) BETWEEN 0.4 AND 0.6) SELECT prot, count(*) AS n, count(DISTINCT lig) AS ligs FROM lab WHERE prot IN (SELECT prot FROM p) AND lig IN (SELECT lig FROM l) GROUP BY prot",
    "cluster_semi_join": f"WITH {_LABELLED} SELECT s_nationkey AS cluster, count(*) AS n FROM lab JOIN supplier ON s_suppkey = prot GROUP BY 1 HAVING count(*) >= 8 AND avg(label) BETWEEN 0.51 AND 0.9",
    "left_lookup": f"WITH {INTERACTIONS} SELECT s_nationkey AS cluster, count(*) AS n FROM inter LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_suppkey = prot GROUP BY 1",
    "priority_lookup": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) = 1",
    "match_cascade": "WITH b AS (SELECT p_brand AS k2, 'brand ' || max(p_partkey) AS m FROM part WHERE p_size < 5 GROUP BY 1), t AS (SELECT p_type AS k3, 'type ' || max(p_partkey) AS m FROM part WHERE p_size > 45 GROUP BY 1) SELECT p_partkey, coalesce(CASE WHEN p_partkey % 11 = 0 THEN 'key ' || p_partkey END, b.m, t.m) AS match FROM part LEFT JOIN b ON p_partkey % 2 = 0 AND k2 = p_brand LEFT JOIN t ON k3 = p_type",
    "exclusion_anti": f"WITH {INTERACTIONS} SELECT prot, count(*) AS n FROM inter i WHERE NOT EXISTS (SELECT 1 FROM inter c WHERE c.ord % 10 = 0 AND c.prot = i.prot AND c.lig = i.lig) GROUP BY prot",
    "matrix_expansion": "SELECT vec_id, c AS col, round(CAST(embedding[c + 1] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS c FROM embeddings)",
    "entity_stats": f"WITH {_LABELLED} SELECT lig, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg, round(avg(label), 6) AS pos_rate FROM lab GROUP BY lig",
    "split_summary": f"WITH {INTERACTIONS}, {_SPLIT} SELECT split, count(*) AS n, count(DISTINCT prot) AS prots, count(DISTINCT lig) AS ligs FROM sp GROUP BY split",
    "balance_summary": f"WITH {_LABELLED}, e AS (SELECT ord % 3 AS split, prot, avg(label) AS v FROM lab GROUP BY 1, 2) SELECT split, count(*) AS entities, {_TWO}, round(min(v), 6) AS least, round(max(v), 6) AS most FROM e GROUP BY split",
    "pair_stats": f"WITH {INTERACTIONS}, e AS (SELECT ord % 3 AS split, lig, CAST(count(*) AS DOUBLE) AS v FROM inter GROUP BY 1, 2) SELECT split, count(*) AS entities, {_TWO}, min(v) AS least, max(v) AS most FROM e GROUP BY split",
    "describe_groups": "WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS groups, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, round(avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END), 6) AS single FROM s",
    "key_freq_sum": "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'$.k' AS BIGINT)) AS most FROM events GROUP BY event_type",
    "histogram_bins": "WITH h AS (SELECT least(10, CAST(floor(l_discount * 10 * 10) AS INTEGER) + 1) AS bin, count(*) AS n FROM lineitem WHERE l_discount * 10 BETWEEN 0 AND 1 GROUP BY 1) SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(1, 11) r(b) LEFT JOIN h ON bin = b",
    "rolling_mean_20": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events WHERE event_id >= 1000",
    "running_offsets": "SELECT p_brand, k, CAST(sum(k) OVER (ORDER BY p_brand) - k AS BIGINT) AS offset FROM (SELECT p_brand, count(*) AS k FROM part GROUP BY 1)",
    "argmax_per_run": "SELECT user_id, event_id, event_type, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1",
    "mean_std_by_method": "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(stddev_pop(l_quantity), 6) AS std_pop FROM lineitem GROUP BY ALL",
    "epoch_from_markers": "WITH e AS (SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS epoch FROM events) SELECT user_id, epoch, count(*) AS n FROM e GROUP BY ALL",
    "dense_epoch_mean": "WITH r AS (SELECT event_id % 40 * 2 AS epoch, CASE WHEN event_id % 40 < 30 THEN value ELSE -1 END AS ss FROM events), m AS (SELECT epoch, avg(ss) AS mean FROM r WHERE ss > 0 GROUP BY epoch) SELECT e AS epoch, round(coalesce(mean, 0e0), 6) AS mean FROM range(0, (SELECT max(epoch) + 1 FROM r)) s(e) LEFT JOIN m ON epoch = e",
    "prefix_rollup": "SELECT CASE WHEN p_size < 5 THEN '(base)' ELSE CAST(p_size % 10 AS VARCHAR) END AS suffix, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1",
    "top20_reasons": "SELECT strftime(l_shipdate, '%Y-%m') AS reason, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, reason LIMIT 20",
    "equivalence_groups": "SELECT count(*) AS size, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY p_retailprice HAVING count(*) > 1",
    "contingency_entropy": "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY p_brand) AS DOUBLE) AS p FROM c) SELECT p_brand, CAST(sum(n) AS BIGINT) AS n, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY p_brand",
    "target_encoding": "SELECT event_id, (coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER w, 0) + 4000e0) / (count(value) OVER w + 1e0) AS encoded FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "min_max_scale": "WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice END AS v FROM part), f AS (SELECT min(v) AS lo, max(v) AS hi FROM r WHERE p_partkey % 2 = 0) SELECT p_partkey, round((coalesce(v, lo - 1) - lo) / (hi - lo), 6) AS scaled FROM r, f",
    "status_shares": "SELECT string_split(o_orderpriority, '-')[1] AS class, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM orders GROUP BY 1",
    "stratified_block_split": f"WITH {_LABELLED}, c AS (SELECT lig AS cluster, count(*) AS n, round(avg(label), 6) AS rate FROM lab GROUP BY lig), b AS (SELECT *, (row_number() OVER (ORDER BY n DESC, abs(rate - 0.5e0) DESC, cluster) - 1) // 10 AS block FROM c), a AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY {_h(11, 'cluster')}, cluster) AS pos FROM b) SELECT cluster, n, CASE WHEN pos <= 8 THEN 'train' WHEN pos <= 9 THEN 'valid' ELSE 'test' END AS split FROM a",
    "balanced_undersample": f"WITH {_LABELLED}, r AS (SELECT *, least(sum(label) OVER (PARTITION BY lig), sum(1 - label) OVER (PARTITION BY lig)) AS most, row_number() OVER (PARTITION BY lig, label ORDER BY {_h(5, 'concat_ws(chr(58), prot, ord, line)')}, prot, ord, line) AS rn FROM lab) SELECT lig, label, count(*) AS n, CAST(sum(ord) AS BIGINT) AS sum_ord FROM r WHERE rn <= most GROUP BY lig, label",
    "file_split": f"WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY {_h(3, 's_suppkey')}, s_suppkey) AS rn, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CASE WHEN rn <= greatest(1, round(n * 0.13e0)) THEN 'valid' ELSE 'train' END AS split FROM r",
    "per_class_sample": f"SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {_h(9, 'p_partkey')}, p_partkey) <= 3",
    "random_sample": f"SELECT o_orderkey FROM orders ORDER BY {_h(123, 'o_orderkey')}, o_orderkey LIMIT 500",
    "entity_overlap": f"WITH {INTERACTIONS}, {_SPLIT} {_OVERLAP.format(c='lig')}",
    "pair_overlap": f"WITH {INTERACTIONS}, {_SPLIT} {_OVERLAP.format(c='prot, lig')}",
    "leakage_audit": f"WITH {INTERACTIONS}, {_SPLIT}, o AS (SELECT ord, count(DISTINCT split) AS splits FROM sp GROUP BY ord) SELECT splits, count(*) AS n FROM o GROUP BY splits",
    "guide_split_case": f"WITH {INTERACTIONS}, {_SPLIT}, f AS (SELECT prot, lig, bool_or(split = 'train') AS a, bool_or(split = 'valid') AS b, bool_or(split = 'test') AS c FROM sp GROUP BY prot, lig) SELECT CASE WHEN NOT b AND NOT c THEN 'guide_train' WHEN NOT a THEN 'guide_test' ELSE 'drop_overlap' END AS guide, count(*) AS n FROM f GROUP BY 1",
    "dedup_pairs": f"WITH {INTERACTIONS}, r AS (SELECT * FROM inter QUALIFY row_number() OVER (PARTITION BY prot, lig ORDER BY ord, line, y) = 1) SELECT prot, count(*) AS n, CAST(sum(ord) AS BIGINT) AS sum_ord, sum(y) AS sum_y FROM r GROUP BY prot",
    "token_intersection": "WITH b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) SELECT length(w) AS length, count(*) AS n FROM (SELECT w FROM b WHERE w <> '' INTERSECT SELECT w FROM d) GROUP BY 1",
}
