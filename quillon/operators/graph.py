"""Graphs as tables of edges (src, dst): closure, hops, smoothing, propagation, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.cut import cut, drop_stored, finely, new_path, stored
from quillon.plans.prefix import totals_before


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions, without loops. Each unordered pair is made distinct once and then turned, so edges may come repeated. They are joined by
    sorting: by the size of a compressed file Spark would take them for small and broadcast them."""
    finely(edges.sparkSession)
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a")))).hint("merge")


def with_loops(edges: DataFrame) -> DataFrame:
    """Edges without their loops, and a loop at every node."""
    finely(edges.sparkSession)
    e = edges.where("src <> dst").select("src", "dst")
    nodes = e.select("src").union(e.select("dst")).distinct()
    return e.distinct().union(nodes.select("src", F.col("src").alias("dst")))


def undirected_max(edges: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One row for each unordered pair, with the largest value; loops go."""
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    return edges.where("src <> dst").groupBy(*groups, low, high).agg(F.max(value).alias(value))


def one_way(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").join(back, ["src", "dst"], "left_anti")


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def _hops(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Symmetric edges, as a table, and hops. A pair's least hop is found in one grouping of the new pairs with those before; only pairs from which a further step starts are written."""
    first = stored(symmetric(edges))
    onward = first.select(F.col("src").alias("dst"), F.col("dst").alias("_far")).hint("merge")
    found = last = first.withColumn("hop", F.lit(1))
    for hop in range(2, most + 1):
        step = last.join(onward, "dst").where("src <> _far").select("src", F.col("_far").alias("dst"), F.lit(hop).alias("hop"))
        least = found.union(step).groupBy("src", "dst").agg(F.min("hop").alias("hop"))
        if hop == most:
            return first, least
        last = stored(least.where(F.col("hop") == hop))
        found = found.union(last)
    return first, found


def hops(edges: DataFrame, most: int = 3) -> DataFrame:
    """(src, dst, hop): the least number of steps between two nodes, up to `most`, over symmetric edges; a node itself is no neighbour."""
    return _hops(edges, most)[1]


def two_hop_code(edges: DataFrame, kinds: DataFrame, node: str, kind: str, weights: dict) -> DataFrame:
    """(src, code): by how many nodes of each kind are exactly two steps away, 0, 1 or more counting as 0, 1, 2, times the kind's weight. Every node of an edge has a row."""
    first, found = _hops(edges, 2)
    away = found.where("hop = 2").join(kinds.select(F.col(node).alias("dst"), F.col(kind).alias("_kind")), "dst")
    counted = away.groupBy("src").agg(*[F.least(F.lit(2), F.sum((F.col("_kind") == k).cast("int"))).alias(f"_n{i}") for i, k in enumerate(weights)])
    code = sum((F.coalesce(F.col(f"_n{i}"), F.lit(0)) * w for i, w in enumerate(weights.values())), F.lit(0))
    return first.select("src").distinct().join(counted, "src", "left").select("src", code.cast("long").alias("code"))


def neighbor_mean(edges: DataFrame, values: DataFrame, node: str, value: str, alpha: float) -> DataFrame:
    """values and smooth: (1 - alpha) of the own value and alpha of the neighbours' mean; a node without neighbours keeps its own."""
    near = edges.join(values.select(F.col(node).alias("dst"), F.col(value).alias("_v")), "dst").groupBy(F.col("src").alias(node)).agg(F.avg("_v").alias("_mean"))
    joined = values.join(near, node, "left")
    return joined.withColumn("smooth", F.when(F.col("_mean").isNull(), F.col(value)).otherwise((1 - alpha) * F.col(value) + alpha * F.col("_mean"))).drop("_mean")


def propagate(edges: DataFrame, values: DataFrame, node: str, value: str, steps: int) -> DataFrame:
    """(node, value): the values after some steps of the symmetrically normalised adjacency; in-degrees count as 1 at least."""
    now = values.select(node, F.col(value).cast("double").alias(value))
    if steps < 1:
        return now
    edges = stored(edges.select("src", "dst"))
    degrees = edges.groupBy(F.col("dst").alias(node)).agg(F.count("*").alias("_d"))
    norm = stored(values.select(node).distinct().join(degrees, node, "left").select(node, (F.lit(1e0) / F.sqrt(F.greatest(F.coalesce("_d", F.lit(1)), F.lit(1)))).alias("_norm")))
    now = now.join(norm, node)
    for _ in range(steps):  # a value travels with its norm
        sent = now.select(F.col(node).alias("src"), (F.col(value) * F.col("_norm")).alias("_v"))
        got = edges.hint("merge").join(sent, "src").groupBy(F.col("dst").alias(node)).agg(F.sum("_v").alias("_s"))
        now = cut(norm.join(got, node, "left").select(node, (F.coalesce("_s", F.lit(0e0)) * F.col("_norm")).alias(value), "_norm"))
    return now.drop("_norm")


def subgraph(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    keep = lambda end: nodes.select(F.col(node).alias(end)).distinct()
    return edges.join(keep("src"), "src", "left_semi").join(keep("dst"), "dst", "left_semi").select(*edges.columns)


def neighborhood(edges: DataFrame, seeds: DataFrame, node: str, steps: int) -> DataFrame:
    """(node, distance): all nodes within some steps of the seeds, and the least number of them."""
    finely(edges.sparkSession)
    edges = stored(edges.select("src", "dst"))
    found = seeds.select(F.col(node)).distinct().withColumn("distance", F.lit(0))
    last = found
    for k in range(1, steps + 1):
        reached = edges.join(last.select(F.col(node).alias("src")), "src").select(F.col("dst").alias(node)).distinct()
        last = cut(reached.join(found, node, "left_anti").withColumn("distance", F.lit(k)))
        found = found.union(last)
    return found


def min_cut(edges: DataFrame, parts: DataFrame, node: str, part: str) -> DataFrame:
    """One row: the edges inside parts by the sum of degrees, for a hard assignment to parts."""
    end = lambda name, as_: parts.select(F.col(node).alias(name), F.col(part).alias(as_))
    inside = edges.join(end("src", "_a"), "src").join(end("dst", "_b"), "dst")
    return inside.agg((F.sum((F.col("_a") == F.col("_b")).cast("double")) / F.count("*")).alias("min_cut"))


def edge_offsets(nodes: DataFrame, batch: str, n: str) -> DataFrame:
    """(batch, offset): nodes of the batches before; a row per batch."""
    return totals_before(nodes.select(batch, n), batch, {"offset": n}).select(batch, "offset")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it sees."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them. Edges run from the larger node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until nothing changes. Null ends and loops are left out. Rounds grow with the logarithm of the
    longest chain; every round is a table in the shared folder, which the next but one replaces, and only a count and a checksum of the edges come to the driver.
    """
    spark, a, b = edges.sparkSession, F.col(left), F.col(right)
    path, seen = new_path(spark), None
    now = stored(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), path)
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, old, path = mark, path, new_path(spark)
        now = stored(_small_star(_large_star(now)), path)
        drop_stored(spark, old)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def largest_components(edges: DataFrame, n: int) -> DataFrame:
    """(component, size) of the n largest, the smaller name first of equals."""
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "component").limit(n)


def normalised(edges: DataFrame) -> DataFrame:
    """edges and both, 1 by the root of the product of the ends' degrees, and row, 1 by the degree of the source."""
    out = edges.groupBy("src").agg(F.count("*").alias("_a"))
    into = edges.groupBy("dst").agg(F.count("*").alias("_b"))
    joined = edges.join(out, "src").join(into, "dst")
    return joined.select("src", "dst", (1 / F.sqrt(F.col("_a") * F.col("_b"))).alias("both"), (1 / F.col("_a")).alias("row"))


def weighted_hops(edges: DataFrame, second: float = 0.5, third: float = 0.3) -> DataFrame:
    """(src, dst, kind, weight): edges of one, two and three steps, each pair once by its least number of steps, with their weights, and a loop of weight 1 at every node (kind 0)."""
    first, found = _hops(edges, 3)
    found = found.select("src", "dst", F.col("hop").alias("kind"), F.when(F.col("hop") == 1, 1e0).when(F.col("hop") == 2, second).otherwise(third).alias("weight"))
    nodes = first.select("src").distinct()  # a node has neighbours at one step, or none
    return found.union(nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("kind"), F.lit(1e0).alias("weight")))


def soft_min_cut(edges: DataFrame, parts: DataFrame, node: str, shares: str) -> DataFrame:
    """One row: trace(S'AS) by trace(S'DS) for a soft assignment, an array of shares of each node."""
    end = lambda name, as_: parts.select(F.col(node).alias(name), F.col(shares).alias(as_))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0e0), lambda s, x: s + x)
    both = edges.join(end("src", "_a"), "src").join(end("dst", "_b"), "dst")
    return both.agg((F.sum(dot("_a", "_b")) / F.sum(dot("_b", "_b"))).alias("min_cut"))
