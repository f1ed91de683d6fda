"""Near-duplicate vectors by an exact metric range join.

Vectors are compared as points of the unit sphere, where cosine >= c means a chord of at most r = sqrt(2 - 2c). Pivots, vectors of the data, cut
a large label into cells: each vector is at home in the cell of its nearest pivot h, and goes as a guest to every cell q in which
a neighbour of its may be at home. For such a neighbour y, d(y,q) <= d(y,h), so the triangle inequality d(x,q) <= d(x,y) + d(y,q) <= r + d(y,h)
<= 2r + d(x,h) bounds how far q may be; on the sphere, where y also lies beyond the plane between h and q, x.(h - q) <= r |h - q|
bounds it closer. Each cell is joined on its own: every vector at home meets all others there, so its links
are counted in one cell only. A cell with more than BLOCK vectors is cut into pairs of blocks, so that its work is spread; a block's
result is a count for each vector and a forest of links, never the pairs.

Equal vectors are one class before anything is compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, join_hot, table
from quillon.operators.graph import components

THRESHOLD = 0.98
#: A label with more classes than this gets pivots, one for each so many.
CELL = 2048
#: Pivots of all labels at most, as they are broadcast. Where more are wanted, all labels get the same part of what they want; beyond that, cells and not their number grow.
ALL_PIVOTS = 8192
#: Vectors on each side of a comparison.
BLOCK = 2048


def _classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(label, vec, id, weight): equal vectors together, those that can have links only."""
    v = F.col(vec_col)
    sound = v.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(sound & F.coalesce(finite, F.lit(False))).groupBy(F.col(label_col).alias("label"), v.alias("vec")).agg(F.min(id_col).alias("id"), F.count("*").alias("weight"))


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares nor their sum go out of range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pivots(classes: DataFrame) -> dict:
    """(label, length) to pivots, for large labels; the number of pivots is bounded."""
    sizes = classes.groupBy("label", F.size("vec").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    wanted = sizes.orderBy(F.desc("n"), "label", "d").limit(ALL_PIVOTS // 2).collect()  # more large labels than this have one cell each
    part = min(1.0, ALL_PIVOTS / max(1, sum(math.ceil(r["n"] / CELL) for r in wanted)))
    given = [(r["label"], r["d"], math.floor(part * math.ceil(r["n"] / CELL)), r["n"]) for r in wanted if part * math.ceil(r["n"] / CELL) >= 2]
    if not given:
        return {}
    spark = classes.sparkSession
    quota = F.broadcast(spark.createDataFrame(given, classes.select("label", F.lit(0).alias("d"), F.lit(0).alias("quota"), F.lit(0).cast("long").alias("n")).schema))  # at most ALL_PIVOTS / 2 rows
    bound = (2.0 * F.col("quota") + 100) / F.col("n")  # about twice as many vectors as are needed have a hash below, and only they are ranked
    chosen = classes.withColumn("d", F.size("vec")).join(quota, ["label", "d"]).where(F.xxhash64("id") / F.lit(2.0**64) + F.lit(0.5) <= bound)
    order = Window.partitionBy("label", "d").orderBy(F.xxhash64("id"), "id")
    rows = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("quota")).select("label", "d", "rank", "vec").collect()
    found: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault((r["label"], r["d"]), []).append(r["vec"])
    return {key: _unit(vectors) for key, vectors in found.items()}


def _cells(classes: DataFrame, pivots: dict, threshold: float) -> DataFrame:
    """A row for each cell that a class is at home or a guest in."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    chord, angle, slack = math.sqrt(2 - 2 * threshold), math.acos(threshold), 1e-7

    @F.pandas_udf("array<int>")
    def cells(label: pd.Series, vec: pd.Series) -> pd.Series:
        """The home cell first, then those where it is a guest."""
        known, out = shared.value, np.empty(len(vec), object)
        out[:] = [[0]] * len(vec)
        lengths = np.array([len(v) for v in vec])
        for key in set(zip(label, lengths.tolist(), strict=True)):
            if key not in known:
                continue
            at, p = np.nonzero((label == key[0]).to_numpy() & (lengths == key[1]))[0], known[key]
            dots = np.clip(_unit([vec.iloc[i] for i in at]) @ p.T, -1.0, 1.0)
            home = dots.argmax(axis=1)
            best = dots[np.arange(len(at)), home][:, None]
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T))[home]
            guest = (best - dots <= chord * apart + slack) & (np.arccos(dots) <= np.arccos(best) + 2 * angle + slack)
            guest[np.arange(len(at)), home] = False
            for i, h, g in zip(at, home, guest, strict=True):
                out[i] = [int(h), *np.nonzero(g)[0].tolist()]
        return pd.Series(out)

    placed = classes.withColumn("d", F.size("vec")).select("*", F.posexplode(cells("label", "vec")).alias("k", "cell"))
    return placed.withColumn("home", F.col("k") == 0).drop("k")


UNIT = "id long, links long, root long"


def _compare(threshold: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of the vectors on the left with those on the right, and for all that have any the least id joined to it here."""
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        near = (_unit(left["vec"].tolist()) @ _unit(right["vec"].tolist()).T >= threshold) & ((a[:, None] != b[None, :]) | (left["nth"].to_numpy()[:, None] != right["nth"].to_numpy()[None, :]))
        links = near @ right["weight"].to_numpy(np.float64)
        rows_at, cols_at = near.any(axis=1), near.any(axis=0)
        near = near[rows_at][:, cols_at]
        of_a, of_b = a[rows_at].copy(), b[cols_at].copy()
        far = np.iinfo(np.int64).max
        while len(of_a):
            new_a = np.minimum(of_a, np.where(near, of_b[None, :], far).min(axis=1))
            new_b = np.minimum(of_b, np.where(near, new_a[:, None], far).min(axis=0))
            if (new_a == of_a).all() and (new_b == of_b).all():
                break
            of_a, of_b = new_a, new_b
        counted = pd.DataFrame({"id": a[rows_at], "links": links[rows_at].astype(np.int64), "root": of_a})
        return pd.concat([counted, pd.DataFrame({"id": b[cols_at], "links": 0, "root": of_b})]).astype("int64")

    return compare


def _joined(placed: DataFrame, threshold: float) -> DataFrame:
    """Counts and forests of all blocks."""
    cell = ["label", "d", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n_all"), F.count(F.when(F.col("home"), 1)).alias("n_home"))
    parts = sizes.select(*cell, F.ceil(F.col("n_home") / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("rights")).where("n_home > 0 and n_all > 1")
    known = placed.join(parts, cell)
    block = F.xxhash64(F.lit("block"), "id", "nth")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = known.where("home").withColumn("side", F.lit(0)).withColumn("i", F.pmod(block, F.col("lefts"))).withColumn("j", F.explode(all_of("rights")))
    right = known.withColumn("side", F.lit(1)).withColumn("j", F.pmod(block, F.col("rights"))).withColumn("i", F.explode(all_of("lefts")))
    columns = [*cell, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "side", "id", "nth", "weight", "vec"]
    return left.select(*columns).union(right.select(*columns)).groupBy(*cell, "i", "j").applyInPandas(_compare(threshold), UNIT)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: links are with rows of the same label and a cosine of threshold or more, in double precision.

    A null id or label, and a vector that is null, empty, zero or holds null or non-finite numbers, links with nothing: 0 links, its own component, kept
    (null for a null id). Vectors of different lengths don't link. Repeated rows are rows of their own: they link with each other. Rows that
    share an id are one node of a component.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    classes = cut(_classes(rows, "id", "vec", "label").withColumn("nth", F.xxhash64("label", "vec")))
    found = cut(_joined(_cells(classes, _pivots(classes), threshold), threshold))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> root"), "id", "root").withColumnRenamed("node", "id")
    of_class = classes.join(counts, "id", "left").join(groups, "id", "left")
    of_class = cut(of_class.select("label", F.col("vec").alias("_vec"), "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("root")))
    named = join_hot(rows.withColumn("_vec", F.when(F.col("id").isNotNull(), F.col("vec"))), of_class, ["label", "_vec"], "weight", "left")
    component = F.coalesce("root", "id")
    return named.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op1_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_near_vectors": op1_near_vectors}
ORACLES = {
    "op1_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a),
comps AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comps LEFT JOIN counts ON a = vec_id
"""
}
