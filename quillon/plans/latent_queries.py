"""Queries of latent vectors: covariances, principal components, soft clusters. Keys are the labels of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import codebook as C
from quillon.operators import latents as L
from quillon.plans.common import rounded, table

ROUNDS = 2


def _points(spark, d):
    return table(spark, d, "embeddings").select("label", "vec_id", "embedding")


def covariance(spark, d):
    """Covariances of all pairs of components of all vectors."""
    return L.covariances(_points(spark, d), "embedding").select("i", "j", (F.round("covariance", 9) + F.lit(0e0)).alias("covariance"))


def latent_projection(spark, d):
    """Every vector along the two directions of most variance."""
    p = _points(spark, d)
    mean, directions, _ = L.principal_components(p, "embedding", 2)
    found = L.project(p, "embedding", mean, directions)
    return rounded(found.select("vec_id", F.get("projection", 0).alias("pc1"), F.get("projection", 1).alias("pc2")), "pc1", "pc2")


def _soft(spark, d):
    p = _points(spark, d)
    return L.soft_clusters(p, C.first_centers(p, "label", "vec_id", "embedding", 2), "label", "embedding", "center", "cid", ROUNDS)


def soft_clustering(spark, d):
    """Two Gaussians for each label after two rounds: weights, and the first mean and the last variance."""
    found = _soft(spark, d)[0].select("label", "cid", "weight", F.get("mean", 0).alias("m0"), F.get("var", 63).alias("v63"))
    return rounded(found, "weight", "m0", "v63")


def soft_likelihood(spark, d):
    return rounded(_soft(spark, d)[1], "likelihood", digits=4)


QUERIES = {f.__name__: f for f in (covariance, latent_projection, soft_clustering, soft_likelihood)}

_STEP = """,
logs{r} AS (SELECT label, vec_id, cid, ln(w) - 0.5e0 * l AS l FROM (
  SELECT p.label, vec_id, cid, any_value(w) AS w, sum((x - m) * (x - m) / v + ln(2e0 * pi() * v)) AS l FROM xs p JOIN par{r} USING (label, i) GROUP BY p.label, vec_id, cid)),
tops{r} AS (SELECT label, vec_id, max(l) AS top FROM logs{r} GROUP BY ALL),
tots{r} AS (SELECT label, vec_id, any_value(top) + ln(sum(exp(l - top))) AS tot FROM logs{r} JOIN tops{r} USING (label, vec_id) GROUP BY label, vec_id),
resp{r} AS (SELECT label, vec_id, cid, exp(l - tot) AS r FROM logs{r} JOIN tots{r} USING (label, vec_id)),
mass{r} AS (SELECT label, cid, sum(r) AS n, sum(r) / sum(sum(r)) OVER (PARTITION BY label) AS w FROM resp{r} GROUP BY label, cid),
par{s} AS (SELECT label, cid, i, w, a AS m, greatest(b - a * a, 1e-6) AS v FROM (SELECT label, cid, i, sum(r * x) / any_value(n) AS a, sum(r * x * x) / any_value(n) AS b, any_value(w) AS w FROM resp{r} JOIN xs USING (label, vec_id) JOIN mass{r} USING (label, cid) GROUP BY label, cid, i))"""
_EM = """WITH xs AS (SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)),
ranked AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cid FROM embeddings QUALIFY cid < 2),
par0 AS (SELECT label, cid, i, 1e0 / (count(*) OVER (PARTITION BY label, i)) AS w, x AS m, v FROM ranked JOIN xs USING (label, vec_id) JOIN (SELECT label, i, greatest(var_pop(x), 1e-6) AS v FROM xs GROUP BY ALL) USING (label, i))""" + "".join(_STEP.format(r=r, s=r + 1) for r in range(ROUNDS))
ORACLES = {
    "covariance": "WITH xs AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.x, b.x), 9) + 0e0 AS covariance FROM xs a JOIN xs b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i",
    "soft_clustering": _EM + f" SELECT label, CAST(cid AS BIGINT) AS cid, round(max(w), 6) AS weight, round(max(CASE WHEN i = 1 THEN m END), 6) AS m0, round(max(CASE WHEN i = 64 THEN v END), 6) AS v63 FROM par{ROUNDS} GROUP BY label, cid",
    "soft_likelihood": _EM + " SELECT label, 0 AS round, round(sum(tot), 4) AS likelihood FROM tots0 GROUP BY label UNION ALL SELECT label, 1, round(sum(tot), 4) FROM tots1 GROUP BY label",
}
