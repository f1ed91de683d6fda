"""Further bindings: cascades, signatures of histograms, grids, soft scores, weights of graphs, masks of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import clean as N
from quillon.functions import tokens as K
from quillon.operators import aggregates as A
from quillon.operators import codebook as C
from quillon.operators import geometry as Y
from quillon.operators import graph as G
from quillon.operators import joins as J
from quillon.operators import metrics as M
from quillon.plans.common import SCORED, rounded, scored, table
from quillon.plans.vector_queries import _ATO, _assigned, _atoms, _edges, _molecules, _sides


def first_valid_sequence(spark, d):
    """Of two cells the first that holds a sound sequence; every third item has none in its first."""
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z ]", "").alias("s"))
    first = F.when(F.col("item_id") % 3 == 0, F.lit("AC1")).otherwise(F.col("s"))
    return b.select("item_id", F.length(N.first_sequence([first, F.concat(F.lit("MKV"), F.col("s"))], foreign=0.3)).cast("long").alias("length"))


def cluster_id_inference(spark, d):
    """Clusters known by a name itself or by its short hash, or not at all."""
    p = table(spark, d, "part").select("p_name").distinct()
    member = F.when(F.length("p_name") % 3 == 0, F.col("p_name")).when(F.length("p_name") % 3 == 1, F.substring(F.sha1("p_name"), 1, 16))
    members = p.select(member.alias("member"), F.concat(F.lit("c"), F.length("p_name")).alias("cluster")).where("member IS NOT NULL")
    return J.cluster_of(p, "p_name", members)


def affinity_join(spark, d):
    c = table(spark, d, "part").select(F.concat(F.lit("1AB"), "p_partkey").alias("pdb"))
    index = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("1ab"), "p_partkey").alias("id"), F.col("p_retailprice").alias("y"))
    return J.affinity_join(c, "pdb", index)


def bin_counts(spark, d):
    return A.bin_counts(table(spark, d, "part").withColumn("v", F.col("p_size") - 5), "v", 60)


def histogram_signature(spark, d):
    n = _assigned(spark, d).groupBy("label", "cid").agg(F.count("*").alias("n"))
    return rounded(A.histogram_signature(n, ["label"], "n"), "max_share", "entropy")


def l2_normalise(spark, d):
    """Unit vectors, NaN as 0, and a vector of zeros as it is."""
    v = F.transform("embedding", lambda x, i: F.when(F.col("vec_id") % 9 == 0, F.lit(0e0)).when((i == 3) & (F.col("vec_id") % 2 == 0), F.lit(float("nan"))).otherwise(x.cast("double") * 3))
    return rounded(table(spark, d, "embeddings").select("vec_id", C.normalized(v).alias("u")).select("vec_id", F.get("u", 0).alias("u0"), F.get("u", 3).alias("u3")), "u0", "u3")


def adjacency_weights(spark, d):
    """Entries of the row and of the symmetrically normalised adjacency, summed by node."""
    w = G.normalised(G.symmetric(_edges(spark, d)))
    return rounded(w.groupBy("src").agg(F.sum("both").alias("both"), F.sum("row").alias("row")), "both", "row")


def extended_graph(spark, d):
    return rounded(G.weighted_hops(_molecules(spark, d)).groupBy("src", "kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "weight")


def soft_min_cut(spark, d):
    e = G.symmetric(_edges(spark, d))
    share = (F.col("src") % 5) / F.lit(5e0)
    parts = e.select("src").distinct().select(F.col("src").alias("node"), F.array(share, 1 - share).alias("s"))
    return rounded(G.soft_min_cut(e, parts, "node", "s"), "min_cut")


def residue_soft_scores(spark, d):
    lig, res = _sides(spark, d)
    near = J.within_distance(lig, res, ("x", "y", "z"), 1.0, ["label"])
    return rounded(Y.soft_scores(near, ["label", "res"], "distance", 0.5, 0.8), "soft")


def percentile_clip(spark, d):
    return rounded(Y.clip_bounds(table(spark, d, "events"), "value", 0.05, 0.99), "low", "high")


def common_grid(spark, d):
    return rounded(Y.common_grid(_atoms(spark, d), "x", "y", 9), "gx", "gy")


def cluster_densities(spark, d):
    """Densities of clusters with forty points or more."""
    a = _atoms(spark, d).withColumn("c", F.col("vec_id") % 4 * F.col("label"))
    return rounded(Y.cluster_densities(a, "c", "x", "y", -4.0, 4.0, 6, 0.8, 40), "density")


def metric_block(spark, d):
    """Area under the curve, average precision and f1 at a half: the block without recall and ranking."""
    rows = scored(spark, d)
    found = M.auroc(rows, "score", "label").crossJoin(M.average_precision(rows, "score", "label")).crossJoin(M.f1(rows, "score", "label", 0.5).select("f1"))  # one row each
    return rounded(found, "auroc", "average_precision", "f1")


def text_mask_shares(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 53).alias("token"))
    found = K.masked_text(rows, "token", ["event_id"], 53, 1, (0, 2), 0.15, seed=4)
    kind = F.when(F.col("label") < 0, "kept out").when(F.col("input") == 1, "mask").when(F.col("input") == F.col("label"), "same").otherwise("random")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("input").alias("sum_input"), F.sum("label").alias("sum_label"))


def wide_hash(spark, d):
    """Sixteen digits of a seeded SHA-1, beyond a long, as text."""
    return table(spark, d, "part").select("p_partkey", N.stable_hash(F.col("p_partkey").cast("string"), 123, 16).cast("string").alias("h"))


QUERIES = {f.__name__: f for f in (first_valid_sequence, cluster_id_inference, affinity_join, bin_counts, histogram_signature, l2_normalise, adjacency_weights, extended_graph, soft_min_cut, residue_soft_scores, percentile_clip, common_grid, cluster_densities, metric_block, text_mask_shares, wide_hash)}


def _oracles() -> dict[str, str]:
    from quillon.plans.vector_queries import _ASS, _HOPS, _SID, _SYM

    u = lambda salt: f"(('0x' || substring(sha1('4|{salt}:' || event_id), 1, 13))::BIGINT / 4503599627370496e0)"
    norm = "WITH v AS (SELECT vec_id, [CASE WHEN vec_id % 9 = 0 OR (i = 4 AND vec_id % 2 = 0) THEN 0e0 ELSE CAST(x AS DOUBLE) * 3 END FOR x, i IN embedding] AS v FROM embeddings), n AS (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n FROM v)"
    return {
        "first_valid_sequence": "WITH s AS (SELECT item_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), '\\s+', '', 'g') AS s FROM benchmark), c AS (SELECT item_id, unnest([CASE WHEN item_id % 3 = 0 THEN 'AC1' ELSE s END, 'MKV' || s]) AS c, unnest([1, 2]) AS k FROM s), g AS (SELECT item_id, arg_min(length(c), k) AS length FROM c WHERE regexp_matches(c, '^[A-Z]+$') AND length(c) BETWEEN 50 AND 1022 AND length(regexp_replace(c, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) / CAST(length(c) AS DOUBLE) <= 0.3e0 GROUP BY item_id) SELECT item_id, length FROM s LEFT JOIN g USING (item_id)",
        "cluster_id_inference": "SELECT DISTINCT p_name, CASE WHEN length(p_name) % 3 < 2 THEN 'c' || length(p_name) ELSE '' END AS cluster FROM part",
        "affinity_join": "SELECT '1AB' || p_partkey AS pdb, p_retailprice AS y FROM part WHERE p_size > 25",
        "bin_counts": "SELECT b AS bin, (SELECT count(*) FROM part WHERE p_size - 5 = b) AS n FROM range(60) r(b)",
        "histogram_signature": f"WITH {_ASS}, n AS (SELECT label, cid, count(*) AS n FROM ass GROUP BY ALL), p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE) AS p FROM n) SELECT label, CAST(sum(n) AS BIGINT) AS total, count(*) AS used, max(n) AS most, round(max(p), 6) AS max_share, round(-sum(p * ln(p + 1e-12)), 6) AS entropy FROM p GROUP BY label",
        "l2_normalise": f"{norm} SELECT vec_id, round(v[1] / n, 6) AS u0, round(v[4] / n, 6) AS u3 FROM n",
        "adjacency_weights": f"WITH {_SYM}, g AS (SELECT src AS n, count(*) AS k FROM sym GROUP BY src) SELECT src, round(sum(1 / sqrt(a.k * b.k)), 6) AS both, 1e0 AS row FROM sym JOIN g a ON a.n = src JOIN g b ON b.n = dst GROUP BY src",
        "extended_graph": f"WITH {_HOPS} SELECT src, 1 AS kind, count(*) AS n, round(count(*) * 1e0, 6) AS weight FROM h1 GROUP BY src UNION ALL SELECT src, 2, count(*), round(count(*) * 0.5e0, 6) FROM h2 GROUP BY src UNION ALL SELECT src, 3, count(*), round(count(*) * 0.3e0, 6) FROM h3 GROUP BY src UNION ALL SELECT DISTINCT src, 0, 1, 1e0 FROM h1",
        "soft_min_cut": f"WITH {_SYM} SELECT round(sum((src % 5) / 5e0 * ((dst % 5) / 5e0) + (1 - (src % 5) / 5e0) * (1 - (dst % 5) / 5e0)) / sum((dst % 5) / 5e0 * ((dst % 5) / 5e0) + (1 - (dst % 5) / 5e0) * (1 - (dst % 5) / 5e0)), 6) AS min_cut FROM sym",
        "residue_soft_scores": f"WITH {_SID} SELECT label, res, round(sum(CASE WHEN d > 0.8e0 THEN 0e0 ELSE exp(-d / 0.5e0) END), 6) AS soft FROM prs WHERE d <= 1.0 GROUP BY label, res",
        "percentile_clip": "SELECT round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.99), 6) AS high FROM events",
        "common_grid": f"WITH {_ATO}, b AS (SELECT min(x) - (max(x) - min(x)) * 0.02e0 AS a, max(x) + (max(x) - min(x)) * 0.02e0 AS b, min(y) - (max(y) - min(y)) * 0.02e0 AS c, max(y) + (max(y) - min(y)) * 0.02e0 AS d FROM ato) SELECT i, j, round(a + (b - a) * i / 8, 6) AS gx, round(c + (d - c) * j / 8, 6) AS gy FROM b, range(9) r(i), range(9) s(j)",
        "cluster_densities": f"WITH {_ATO}, k AS (SELECT x, y, vec_id % 4 * label AS c FROM ato), n AS (SELECT c, count(*) AS n FROM k GROUP BY c HAVING count(*) >= 40), g AS (SELECT i, j, -4e0 + 8e0 * i / 5 AS gx, -4e0 + 8e0 * j / 5 AS gy FROM range(6) a(i), range(6) b(j)) SELECT i, j, round(sum(exp(-((x - gx) * (x - gx) + (y - gy) * (y - gy)) / (2 * 0.8e0 * 0.8e0)) / n) / (2 * pi() * 0.8e0 * 0.8e0), 6) AS density FROM k JOIN n USING (c), g GROUP BY i, j",
        "metric_block": f"WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rk FROM scored), a AS (SELECT (sum(CASE WHEN label = 1 THEN rk ELSE 0e0 END) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * sum(1 - label)) AS a FROM r), c AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score), w AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM c), p AS (SELECT sum(pos * CAST(tp AS DOUBLE) / k) / sum(pos) AS p FROM w), f AS (SELECT coalesce(2e0 * count_if(score >= 0.5e0 AND label = 1) / nullif(count_if(score >= 0.5e0) + sum(label), 0), 0e0) AS f FROM scored) SELECT round(a, 6) AS auroc, round(p, 6) AS average_precision, round(f, 6) AS f1 FROM a, p, f",
        "text_mask_shares": f"""WITH u AS (SELECT event_id % 53 AS token, {u('pick')} AS p, {u('how')} AS h, {u('token')} AS t FROM events),
 m AS (SELECT CASE WHEN p >= 0.15e0 OR token IN (0, 2) THEN token WHEN h < 0.8e0 THEN 1 WHEN h < 0.9e0 THEN floor(t * 53) ELSE token END AS input, CASE WHEN p < 0.15e0 AND token NOT IN (0, 2) THEN token ELSE -100 END AS label FROM u)
 SELECT CASE WHEN label < 0 THEN 'kept out' WHEN input = 1 THEN 'mask' WHEN input = label THEN 'same' ELSE 'random' END AS kind, count(*) AS n, CAST(sum(input) AS BIGINT) AS sum_input, CAST(sum(label) AS BIGINT) AS sum_label FROM m GROUP BY kind""",
        "wide_hash": "SELECT p_partkey, CAST(CAST('0x' || substring(sha1('123|' || p_partkey), 1, 16) AS UBIGINT) AS VARCHAR) AS h FROM part",
    }


ORACLES = _oracles()
