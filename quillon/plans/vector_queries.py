"""Codebook, graph and geometry queries. Keys are the labels of embeddings; the graph joins suppliers and parts by all line items, and hops run in a small graph of each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.operators import codebook as C
from quillon.operators import geometry as Y
from quillon.operators import graph as G
from quillon.operators import joins as J
from quillon.plans.common import rounded, table
from quillon.plans.cut import finely


def _points(spark, d):
    return table(spark, d, "embeddings").select("label", "vec_id", "embedding")


def _centers(spark, d, k=4):
    return C.first_centers(_points(spark, d), "label", "vec_id", "embedding", k)


def _assigned(spark, d):
    return C.assign(_points(spark, d), _centers(spark, d), "label", "embedding")


def vq_assign(spark, d):
    return rounded(_assigned(spark, d).select("vec_id", "label", "cid", "similarity"), "similarity")


def vq_assign_unknown(spark, d):
    found = C.assign_all(_points(spark, d), _centers(spark, d).where("label < 7"), "label", "embedding", "vec_id")
    return found.groupBy("label", "cid").agg(F.count("*").alias("n"))


def vq_global_ids(spark, d):
    ids = C.global_ids(_centers(spark, d).where("cid <= label"), "label")
    return ids.select("label", "safe", "k", "offset")


def vq_ema_update(spark, d):
    sums = C.batch_sums(_assigned(spark, d), "label", "embedding")
    after = C.ema_step(C.start_state(_centers(spark, d)), sums, "label")
    return rounded(after.select("label", "cid", "cs", "ue", F.get("center", 0).alias("c0"), F.get("ea", 1).alias("ea1")), "cs", "ue", "c0", "ea1")


def vq_cluster_metrics(spark, d):
    counts = _assigned(spark, d).groupBy("label", "cid").agg(F.count("*").alias("n"))
    return rounded(A.entropy_metrics(counts, ["label"], "n"), "max_share", "top5_share", "entropy", "perplexity", "singleton_clusters", "singleton_points")


def vq_max_share(spark, d):
    sums = C.batch_sums(_assigned(spark, d), "label", "embedding")
    return rounded(C.max_share(C.ema_step(C.start_state(_centers(spark, d)), sums, "label"), "label"), "max_share")


def vq_commitment(spark, d):
    return rounded(C.commitment(_assigned(spark, d), _centers(spark, d), "label", "embedding"), "commitment")


def wcss(spark, d):
    return rounded(C.wcss(_assigned(spark, d), _centers(spark, d), "label", "embedding"), "wcss", "mse")


def silhouette(spark, d):
    return rounded(C.silhouette(_assigned(spark, d), "label", "cid", "embedding", "vec_id"), "silhouette")


def codebook_usage(spark, d):
    used = _assigned(spark, d).groupBy("label").agg(F.countDistinct("cid").alias("used"))
    sizes = _centers(spark, d).groupBy("label").agg(F.count("*").alias("k"))
    return sizes.join(used, "label", "left").select("label", "k", F.coalesce("used", F.lit(0)).alias("used"))


def kmeans_fixed_init(spark, d):
    found = C.kmeans(_points(spark, d), _centers(spark, d, 2), "label", "embedding", 2)
    return rounded(found.select("label", "cid", F.get("center", 0).alias("c0"), F.get("center", 63).alias("c63")), "c0", "c63")


def kmeanspp(spark, d):
    found = C.per_key_seeds(_points(spark, d), "label", "vec_id", "embedding", 4)
    return found.select("label", "cid", F.get("center", 0).alias("c0"))


def codebook_reshape(spark, d):
    """Split, revive and prune after one step."""
    assigned = _assigned(spark, d)
    after = C.ema_step(C.start_state(_centers(spark, d)), C.batch_sums(assigned, "label", "embedding"), "label")
    return C.reshaped(after, assigned, "label", "embedding", epoch=3).select("label", "cid", "cs", "ue", "last_ep", "cooldown")


def _edges(spark, d):
    """Every pair of a supplier and a part in lineitem, as often as it occurs."""
    finely(spark)
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (10_000_000 + F.col("l_partkey")).alias("dst"))


def _molecules(spark, d):
    """A small graph for each order, as molecules are: every line item joins two of its seven nodes; some pairs are repeated."""
    node = lambda c: (F.col("l_orderkey") * 100 + F.col(c) % 7)
    return table(spark, d, "lineitem").select(node("l_suppkey").alias("src"), node("l_partkey").alias("dst")).where("src <> dst")


def symmetrize(spark, d):
    return G.degree(G.symmetric(_edges(spark, d)))


def self_loops(spark, d):
    return G.with_loops(_edges(spark, d)).groupBy((F.col("src") == F.col("dst")).cast("int").alias("is_loop")).agg(F.count("*").alias("n"))


def one_way_edges(spark, d):
    half = G.symmetric(_edges(spark, d)).where("NOT (src > dst AND src % 3 = 0)")
    return G.one_way(half)


def undirected_bonds(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mol"), (F.col("l_suppkey") % 20).alias("src"), (F.col("l_partkey") % 20).alias("dst"), "l_linenumber")
    return G.undirected_max(li, ["mol"], "l_linenumber")


def hop_edges(spark, d):
    return G.hops(_molecules(spark, d), 3).groupBy("src", "hop").agg(F.count("*").alias("n"))


def het_two_hop_code(spark, d):
    edges = _molecules(spark, d)
    kinds = edges.select("src").union(edges.select("dst")).distinct().withColumn("kind", F.col("src") % 3)
    return G.two_hop_code(edges, kinds.withColumnRenamed("src", "node"), "node", "kind", {0: 1, 1: 3, 2: 9})


def _values(spark, d):
    e = _edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    return nodes.withColumn("x", (F.col("node") % 17).cast("double"))


def neighbor_mean(spark, d):
    return rounded(G.neighbor_mean(G.symmetric(_edges(spark, d)), _values(spark, d), "node", "x", 0.3).select("node", "smooth"), "smooth")


def sgc_propagation(spark, d):
    return rounded(G.propagate(G.symmetric(_edges(spark, d)), _values(spark, d), "node", "x", 2), "x")


def subgraph(spark, d):
    nodes = _values(spark, d).where("node % 5 < 3").select("node")
    return G.subgraph(_edges(spark, d).distinct(), nodes, "node")


def neighborhood(spark, d):
    seeds = _values(spark, d).where("node < 2").select("node")
    return G.neighborhood(G.symmetric(_edges(spark, d)), seeds, "node", 3).groupBy("distance").agg(F.count("*").alias("n"))


def min_cut(spark, d):
    parts = _values(spark, d).select("node", (F.col("node") % 4).alias("part"))
    return rounded(G.min_cut(G.symmetric(_edges(spark, d)), parts, "node", "part"), "min_cut")


def connected_components(spark, d):
    return G.components(_edges(spark, d))


def largest_component(spark, d):
    return G.largest_components(_edges(spark, d), 3)


def _atoms(spark, d):
    """Points in space: the first three components, scaled."""
    at = [F.round(F.get("embedding", i).cast("double") * 10, 4).alias(c) for i, c in enumerate("xyz")]
    return table(spark, d, "embeddings").select("label", "vec_id", *at)


def _sides(spark, d):
    a = _atoms(spark, d)
    return a.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "lig"), a.where("vec_id % 5 <> 0").withColumnRenamed("vec_id", "res")


def contact_range_join(spark, d):
    lig, res = _sides(spark, d)
    return rounded(J.within_distance(lig, res, ("x", "y", "z"), 1.0, ["label"]).select("label", "lig", "res", "distance"), "distance")


def contact_mask(spark, d):
    lig, res = _sides(spark, d)
    return Y.contact_mask(res, J.within_distance(lig, res, ("x", "y", "z"), 1.0, ["label"]), "label", "res")


def chain_ranking(spark, d):
    lig, res = _sides(spark, d)
    return rounded(Y.chain_ranking(res.withColumn("structure", F.col("label") % 3), lig, ("x", "y", "z"), "structure", "label", "res", 1.0, 4.0), "soft", "best")


def pair_quantiles(spark, d):
    return rounded(Y.pair_quantiles(_points(spark, d), "label", "vec_id", "embedding", (0.1, 0.25, 0.75)), "q10", "q25", "q75")


def kde_grid(spark, d):
    return rounded(Y.kde_grid(_atoms(spark, d), "x", "y", -4.0, 4.0, 8, 0.8), "density")


def voronoi(spark, d):
    centers = _atoms(spark, d).where("vec_id < 6").select(F.col("vec_id").alias("cid"), "x", "y")
    return Y.voronoi_grid(centers, "cid", "x", "y", -4.0, 4.0, 8)


def percentile_zoom(spark, d):
    return Y.percentile_zoom(_atoms(spark, d), ["x", "y"], 0.05, 0.95).select("vec_id")


QUERIES = {f.__name__: f for f in (vq_assign, vq_assign_unknown, vq_global_ids, vq_ema_update, vq_cluster_metrics, vq_max_share, vq_commitment, wcss, silhouette, codebook_usage, kmeans_fixed_init, kmeanspp, codebook_reshape, symmetrize, self_loops, one_way_edges, undirected_bonds, hop_edges, het_two_hop_code, neighbor_mean, sgc_propagation, subgraph, neighborhood, min_cut, connected_components, largest_component, contact_range_join, contact_mask, chain_ranking, pair_quantiles, kde_grid, voronoi, percentile_zoom)}

_PTS = "pts AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_CEN = f"{_PTS}, ranked AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, v AS c FROM pts), cen AS (SELECT label, rn - 1 AS cid, c FROM ranked WHERE rn <= 4)"
_ASS = f"{_CEN}, ass AS (SELECT label, vec_id, v, cid, c, list_dot_product(v, c) AS s FROM pts JOIN cen USING (label) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, c) DESC, cid) = 1)"
_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_EMA = f"""{_ASS}, x AS (SELECT label, cid, i, sum(v[i]) AS s, count(*) AS n FROM ass, range(1, 65) r(i) GROUP BY label, cid, i),
 m AS (SELECT c.label, c.cid, r.i, c.c[r.i] AS old, coalesce(n, 0) AS n, 0.8e0 + 0.2e0 * coalesce(n, 0) AS cs, 0.8e0 * c.c[r.i] + 0.2e0 * coalesce(s, 0e0) AS ea FROM cen c CROSS JOIN range(1, 65) r(i) LEFT JOIN x ON x.label = c.label AND x.cid = c.cid AND x.i = r.i),
 l AS (SELECT *, sqrt(sum(ea * ea) OVER (PARTITION BY label, cid)) AS len FROM m),
 ema AS (SELECT label, cid, i, n, cs, 0.03e0 * n AS ue, CASE WHEN n > 0 THEN ea / len ELSE old END AS center FROM l)"""
_EDG = "edg AS (SELECT DISTINCT l_suppkey AS src, 10000000 + l_partkey AS dst FROM lineitem)"
_SYM = f"{_EDG}, sym AS (SELECT src, dst FROM edg UNION SELECT dst, src FROM edg)"
_VAL = f"{_SYM}, val AS (SELECT DISTINCT src AS node, CAST(src % 17 AS DOUBLE) AS x FROM sym)"
_MOL = "edg AS (SELECT DISTINCT l_orderkey * 100 + l_suppkey % 7 AS src, l_orderkey * 100 + l_partkey % 7 AS dst FROM lineitem WHERE l_suppkey % 7 <> l_partkey % 7)"
_HOPS = f"{_MOL}, h1 AS (SELECT src, dst FROM edg UNION SELECT dst, src FROM edg), h2 AS (SELECT DISTINCT a.src, b.dst FROM h1 a JOIN h1 b ON a.dst = b.src WHERE a.src <> b.dst EXCEPT SELECT * FROM h1), h3 AS (SELECT DISTINCT a.src, b.dst FROM h2 a JOIN h1 b ON a.dst = b.src WHERE a.src <> b.dst EXCEPT (SELECT * FROM h1 UNION SELECT * FROM h2))"
_COMP = f"{_EDG}, e AS (SELECT src AS a, dst AS b FROM edg UNION SELECT dst, src FROM edg), comp(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT p.node, min(c.component) FROM recurring.comp p JOIN e ON e.a = p.node JOIN comp c ON c.node = e.b WHERE c.component < p.component GROUP BY p.node)"
_ATO = "ato AS (SELECT label, vec_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE) * 10, 4) AS {c}" for i, c in enumerate("xyz")) + " FROM embeddings)"
_SID = f"{_ATO}, prs AS (SELECT a.label, a.vec_id AS lig, b.vec_id AS res, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM ato a JOIN ato b ON a.label = b.label AND a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0)"
_GRID = "grid AS (SELECT i, j, -4e0 + 8e0 * i / 7 AS gx, -4e0 + 8e0 * j / 7 AS gy FROM range(8) a(i), range(8) b(j))"
ORACLES = {
    "vq_assign": f"WITH {_ASS} SELECT vec_id, label, cid, round(s, 6) AS similarity FROM ass",
    "vq_assign_unknown": f"WITH {_ASS} SELECT label, CASE WHEN label < 7 THEN cid ELSE -1 END AS cid, count(*) AS n FROM ass GROUP BY ALL",
    "vq_global_ids": f"WITH {_CEN}, k AS (SELECT label, 'k_' || label AS safe, count(*) AS k FROM cen WHERE cid <= label GROUP BY label) SELECT label, safe, k, CAST(sum(k) OVER (ORDER BY safe) - k AS BIGINT) AS offset FROM k",
    "vq_ema_update": f"WITH {_EMA} SELECT label, cid, round(max(cs), 6) AS cs, round(max(ue), 6) AS ue, round(max(CASE WHEN i = 1 THEN center END), 6) AS c0, round(max(CASE WHEN i = 2 THEN center * cs END), 6) AS ea1 FROM ema GROUP BY label, cid",
    "vq_cluster_metrics": f"WITH {_ASS}, n AS (SELECT label, cid, count(*) AS n FROM ass GROUP BY ALL), p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE) AS p FROM n) SELECT label, CAST(sum(n) AS BIGINT) AS total, count(*) AS k_used, round(max(p), 6) AS max_share, round(sum(p), 6) AS top5_share, round(-sum(p * ln(p)), 6) AS entropy, round(exp(-sum(p * ln(p))), 6) AS perplexity, round(avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END), 6) AS singleton_clusters, round(sum(CASE WHEN n = 1 THEN p ELSE 0e0 END), 6) AS singleton_points FROM p GROUP BY label",
    "vq_max_share": f"WITH {_EMA}, s AS (SELECT label, cid, max(cs) AS cs, max(ue) AS ue FROM ema GROUP BY ALL) SELECT label, round(max(p), 6) AS max_share FROM (SELECT label, 0.5e0 * cs / sum(cs) OVER (PARTITION BY label) + 0.5e0 * ue / sum(ue) OVER (PARTITION BY label) AS p FROM s) GROUP BY label",
    "vq_commitment": f"WITH {_ASS} SELECT round(0.25e0 * sum({_DIST.format(a='v', b='c')}) / sum(len(v)), 6) AS commitment FROM ass",
    "wcss": f"WITH {_ASS} SELECT label, count(*) AS n, round(sum({_DIST.format(a='v', b='c')}), 6) AS wcss, round(sum({_DIST.format(a='v', b='c')}) / sum(len(v)), 6) AS mse FROM ass GROUP BY label",
    "silhouette": f"WITH {_ASS}, m AS (SELECT a.label, a.vec_id, a.cid, b.cid AS c2, avg(sqrt({_DIST.format(a='a.v', b='b.v')})) AS m FROM ass a JOIN ass b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL), p AS (SELECT label, vec_id, coalesce(max(CASE WHEN cid = c2 THEN m END), 0e0) AS a, min(CASE WHEN cid <> c2 THEN m END) AS b FROM m GROUP BY ALL) SELECT label, count(*) AS n, round(avg(CASE WHEN b IS NULL THEN 0e0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM p GROUP BY label",
    "codebook_usage": f"WITH {_ASS} SELECT label, (SELECT count(*) FROM cen WHERE cen.label = a.label) AS k, count(DISTINCT cid) AS used FROM ass a GROUP BY label",
    "kmeans_fixed_init": f"WITH {_PTS}, c0 AS (SELECT label, rn - 1 AS cid, c FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, v AS c FROM pts) WHERE rn <= 2)"
    + "".join(
        f", a{k} AS (SELECT label, v, cid FROM pts JOIN c{k} USING (label) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, c) DESC, cid) = 1), s{k} AS (SELECT label, cid, i, avg(v[i]) AS m FROM a{k}, range(1, 65) r(i) GROUP BY ALL), n{k} AS (SELECT label, cid, i, m / sqrt(sum(m * m) OVER (PARTITION BY label, cid)) AS m FROM s{k}), c{k + 1} AS (SELECT o.label, o.cid, coalesce(any_value(q.c), any_value(o.c)) AS c FROM c{k} o LEFT JOIN (SELECT label, cid, list(m ORDER BY i) AS c FROM n{k} GROUP BY ALL) q ON q.label = o.label AND q.cid = o.cid GROUP BY o.label, o.cid)"
        for k in range(2)
    )
    + " SELECT label, cid, round(c[1], 6) AS c0, round(c[64], 6) AS c63 FROM c2",
    "symmetrize": f"WITH {_SYM} SELECT src, count(*) AS degree FROM sym GROUP BY src",
    "self_loops": f"WITH {_SYM} SELECT 0 AS is_loop, (SELECT count(*) FROM edg) AS n UNION ALL SELECT 1, count(DISTINCT src) FROM sym",
    "one_way_edges": f"WITH {_SYM}, half AS (SELECT * FROM sym WHERE NOT (src > dst AND src % 3 = 0)) SELECT src, dst FROM half EXCEPT SELECT dst, src FROM half",
    "undirected_bonds": "SELECT l_returnflag AS mol, least(l_suppkey % 20, l_partkey % 20) AS src, greatest(l_suppkey % 20, l_partkey % 20) AS dst, max(l_linenumber) AS l_linenumber FROM lineitem WHERE l_suppkey % 20 <> l_partkey % 20 GROUP BY ALL",
    "hop_edges": f"WITH {_HOPS} SELECT src, 1 AS hop, count(*) AS n FROM h1 GROUP BY src UNION ALL SELECT src, 2, count(*) FROM h2 GROUP BY src UNION ALL SELECT src, 3, count(*) FROM h3 GROUP BY src",
    "het_two_hop_code": f"WITH {_HOPS}, c AS (SELECT src, least(2, count_if(dst % 3 = 0)) + 3 * least(2, count_if(dst % 3 = 1)) + 9 * least(2, count_if(dst % 3 = 2)) AS code FROM h2 GROUP BY src) SELECT n.src, CAST(coalesce(code, 0) AS BIGINT) AS code FROM (SELECT DISTINCT src FROM h1) n LEFT JOIN c USING (src)",
    "neighbor_mean": f"WITH {_VAL} SELECT a.node, round(0.7e0 * max(a.x) + 0.3e0 * avg(b.x), 6) AS smooth FROM val a JOIN sym ON sym.src = a.node JOIN val b ON b.node = sym.dst GROUP BY a.node",
    "sgc_propagation": f"WITH {_VAL}, deg AS (SELECT dst AS node, count(*) AS d FROM sym GROUP BY dst), p1 AS (SELECT sym.dst AS node, sum(x / sqrt(ds.d)) / sqrt(max(dd.d)) AS x FROM sym JOIN val ON val.node = sym.src JOIN deg ds ON ds.node = sym.src JOIN deg dd ON dd.node = sym.dst GROUP BY sym.dst) SELECT sym.dst AS node, round(sum(x / sqrt(ds.d)) / sqrt(max(dd.d)), 6) AS x FROM sym JOIN p1 ON p1.node = sym.src JOIN deg ds ON ds.node = sym.src JOIN deg dd ON dd.node = sym.dst GROUP BY sym.dst",
    "subgraph": f"WITH {_EDG} SELECT src, dst FROM edg WHERE src % 5 < 3 AND dst % 5 < 3",
    "neighborhood": f"WITH RECURSIVE {_SYM}, d0 AS (SELECT DISTINCT src AS n FROM sym WHERE src < 2), d1 AS (SELECT DISTINCT dst AS n FROM sym JOIN d0 ON src = n EXCEPT SELECT * FROM d0), d2 AS (SELECT DISTINCT dst AS n FROM sym JOIN d1 ON src = n EXCEPT (SELECT * FROM d0 UNION SELECT * FROM d1)), d3 AS (SELECT DISTINCT dst AS n FROM sym JOIN d2 ON src = n EXCEPT (SELECT * FROM d0 UNION SELECT * FROM d1 UNION SELECT * FROM d2)) SELECT distance, n FROM (SELECT 0 AS distance, count(*) AS n FROM d0 UNION ALL SELECT 1, count(*) FROM d1 UNION ALL SELECT 2, count(*) FROM d2 UNION ALL SELECT 3, count(*) FROM d3) WHERE n > 0",
    "min_cut": f"WITH {_SYM} SELECT round(avg(CASE WHEN src % 4 = dst % 4 THEN 1e0 ELSE 0e0 END), 6) AS min_cut FROM sym",
    "connected_components": f"WITH RECURSIVE {_COMP} SELECT node, component FROM comp",
    "largest_component": f"WITH RECURSIVE {_COMP} SELECT component, count(*) AS size FROM comp GROUP BY component ORDER BY size DESC, component LIMIT 3",
    "contact_range_join": f"WITH {_SID} SELECT label, lig, res, round(d, 6) AS distance FROM prs WHERE d <= 1.0",
    "contact_mask": f"WITH {_SID} SELECT label, string_agg(CASE WHEN near THEN '1' ELSE '0' END, '' ORDER BY res) AS mask, count_if(near) AS contact_n FROM (SELECT b.label, b.vec_id AS res, EXISTS (SELECT 1 FROM prs WHERE prs.res = b.vec_id AND d <= 1.0) AS near FROM ato b WHERE b.vec_id % 5 <> 0) GROUP BY label",
    "chain_ranking": f"WITH {_SID}, m AS (SELECT label, res, min(d) AS d FROM prs GROUP BY ALL), c AS (SELECT label, count_if(d < 1.0) AS contacts, sum(exp(-d / 4e0)) AS soft, min(d) AS best FROM m GROUP BY label) SELECT label % 3 AS structure, label, contacts, round(soft, 6) AS soft, round(best, 6) AS best, row_number() OVER (PARTITION BY label % 3 ORDER BY contacts DESC, soft DESC, best, label) AS place FROM c",
    "pair_quantiles": f"WITH {_PTS}, q AS (SELECT a.label, sqrt({_DIST.format(a='a.v', b='b.v')}) AS d FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, count(*) AS pairs, round(quantile_cont(d, 0.1), 6) AS q10, round(quantile_cont(d, 0.25), 6) AS q25, round(quantile_cont(d, 0.75), 6) AS q75 FROM q GROUP BY label",
    "kde_grid": f"WITH {_ATO}, {_GRID} SELECT i, j, round(sum(exp(-((x - gx) * (x - gx) + (y - gy) * (y - gy)) / (2 * 0.8e0 * 0.8e0))) / (count(*) * 2 * pi() * 0.8e0 * 0.8e0), 6) AS density FROM ato, grid GROUP BY i, j",
    "voronoi": f"WITH {_ATO}, {_GRID} SELECT i, j, vec_id AS cid FROM grid, ato WHERE vec_id < 6 QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY (x - gx) * (x - gx) + (y - gy) * (y - gy), vec_id) = 1",
    "percentile_zoom": f"WITH {_ATO}, b AS (SELECT quantile_cont(x, 0.05) AS xl, quantile_cont(x, 0.95) AS xh, quantile_cont(y, 0.05) AS yl, quantile_cont(y, 0.95) AS yh FROM ato) SELECT vec_id FROM ato, b WHERE x BETWEEN xl AND xh AND y BETWEEN yl AND yh",
}
