"""Queries over whole tables: nothing is left out by filters that only serve to make the input small."""

import os

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.operators import codebook as V
from quillon.operators import geometry as Y
from quillon.operators import graph as G
from quillon.operators import joins as J
from quillon.operators import losses as L
from quillon.operators import metrics as M
from quillon.plans import prefix as P
from quillon.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def pairs():
    li = pd.read_parquet(f"{DATA}/lineitem.parquet", columns=["l_suppkey", "l_partkey"]).drop_duplicates()
    return [(s, 10_000_000 + p) for s, p in li.itertuples(index=False)]


def test_components_and_degrees_of_the_whole_graph(spark, pairs):
    parent = {n: n for e in pairs for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = registry.queries()["connected_components"](spark, DATA).collect()
    assert {r.node: r.component for r in found} == {n: root(n) for n in parent}
    degrees = {r.src: r.degree for r in registry.queries()["symmetrize"](spark, DATA).collect()}
    wanted = pd.Series([n for e in pairs for n in e]).value_counts().to_dict()
    assert degrees == wanted


def test_hops_of_every_molecule(spark):
    li = pd.read_parquet(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_suppkey", "l_partkey"]).drop_duplicates()
    near = {}
    for o, s, p in li.itertuples(index=False):
        a, b = int(o * 100 + s % 7), int(o * 100 + p % 7)
        if a == b:
            continue
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    wanted = {}
    for n in near:
        seen, last = {n}, {n}
        for hop in (1, 2, 3):
            last = set().union(*(near[m] for m in last)) - seen
            seen |= last
            if last:
                wanted[n, hop] = len(last)
    assert {(r.src, r.hop): r.n for r in registry.queries()["hop_edges"](spark, DATA).collect()} == wanted


def test_ranking_losses_over_all_events(spark):
    users = spark.read.parquet(f"{DATA}/events.parquet").groupBy("user_id").count().where("count >= 2").collect()
    found = registry.queries()["list_rank_loss"](spark, DATA).collect()
    assert {r.user_id: r.n for r in found} == {r.user_id: r["count"] for r in users}


@pytest.mark.parametrize("block", [7, 50_000])
def test_pairs_of_a_hot_group_by_blocks(spark, block):
    rng = np.random.default_rng(0)
    rows = [(int(g > 0.9), float(s), float(t)) for g, s, t in zip(rng.random(300), rng.integers(0, 20, 300) / 20, rng.integers(0, 15, 300) / 10)]
    df = spark.createDataFrame(rows + [(2, 0.5, 0.5), (2, 0.5, 0.55)] + rows[:20] + [(0, None, 0.1), (0, 0.3, None)], "g int, s double, t double")
    wanted = {}
    for g in (0, 1):
        own = [(s, t) for k, s, t in rows + rows[:20] if k == g] + [(None, 0.1)] * (g == 0)
        lost = [0.0 if None in (a[0], b[0]) else max(0.0, 0.05 - (a[0] - b[0])) for a in own for b in own if a[1] - b[1] > 0.1]
        wanted[g] = (len(lost), pytest.approx(sum(lost) / len(lost)))
    found = L.pairwise_rank_loss(df, "g", "s", "t", 0.1, 0.05, block).collect()
    assert {r.g: (r.pairs, r.loss) for r in found} == wanted


def test_reshaping_goes_by_all_points_of_a_key(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal([3, 0, 0], [0.1, 0.8, 0.1], (140, 3)), rng.normal([0, 3, 0], 0.1, (860, 3))])
    cid = [int(i >= 140) for i in range(1000)]
    points = spark.createDataFrame([(1, c, v.tolist()) for c, v in zip(cid, x)], "k int, cid int, v array<double>").repartition(3)
    cs, rests = [140.0, 860.0, 1.0], [0, 5, 0]
    state = spark.createDataFrame([(1, i, np.eye(3)[i].tolist(), cs[i], np.eye(3)[i].tolist(), cs[i] / 4, 1, 3, rests[i]) for i in range(3)], "k int, cid int, center array<double>, cs double, ea array<double>, ue double, ever int, last_ep int, cooldown int")
    center, want, _, rest = V.split_winner(np.eye(3), np.array(cs), np.array(cs) / 4, np.array(rests), np.vstack([x] * 60), np.array(cid * 60))
    assert want.tolist() == [70, 860, 70]  # 0.14 of the points, above 0.12 from 50000 points on
    many = points.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("_")
    got = V.reshaped(state, many, "k", "v", 3, sample=500).orderBy("cid").collect()
    assert [r.cs for r in got] == want.tolist() and [r.cooldown for r in got] == rest.tolist()
    assert np.allclose([r.center for r in got], center)
    own = x[:140] - x[:140].mean(axis=0)
    _, s, axes = np.linalg.svd(own, full_matrices=False)
    axis = axes[0] * np.sign(axes[0][np.abs(axes[0]).argmax()])
    split = x[:140].mean(axis=0) + 0.5 * s[0] / np.sqrt(140) * axis
    assert np.allclose(center[0], split / np.linalg.norm(split))


def test_quantiles_of_all_pairs_of_a_large_group(spark):
    x = np.random.default_rng(2).normal(size=4200)
    rows = [(0, i, [float(v)]) for i, v in enumerate(x)] + [(1, i, [float(i * i)]) for i in range(3)] + [(2, 0, [1.0]), (2, 1, [1.0])]
    got = {r.g: r for r in Y.pair_quantiles(spark.createDataFrame(rows, "g int, i int, v array<double>"), "g", "i", "v", (0.1, 0.75)).collect()}
    d = np.abs(x[:, None] - x)[np.triu_indices(4200, 1)]
    assert got[0].pairs == len(d) and [got[0].q10, got[0].q75] == pytest.approx(np.quantile(d, [0.1, 0.75]).tolist())
    assert [got[1].pairs, got[1].q10, got[1].q75] == [3, pytest.approx(1.4), pytest.approx(3.5)]
    assert [got[2].pairs, got[2].q10, got[2].q75] == [1, 0, 0]


def test_matrix_expansion_has_every_cell(spark):
    cells = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.sum(F.size("embedding"))).first()[0]
    assert registry.queries()["matrix_expansion"](spark, DATA).count() == cells


def test_a_key_with_many_centers(spark):
    """30000 centres and 3000 points of one key, by blocks, against one product; equal centres give the smallest id."""
    rng = np.random.default_rng(3)
    book = rng.normal(size=(30_000, 16))
    book[29_999], book[17] = book[5], book[16]
    x = np.vstack([rng.normal(size=(3000, 16)), book[5] * 3, book[17] * 3])
    points = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(len(x)), "v": x.tolist()})).repartition(4)
    centers = spark.createDataFrame(pd.DataFrame({"k": 1, "cid": np.arange(len(book)), "c": book.tolist()})).repartition(4)
    got = {r.i: (r.cid, r.similarity) for r in J.nearest_center(points, centers, "k", "v", "c", "cid").select("i", "cid", "similarity").collect()}
    score = np.round(x @ book.T, 12)
    assert [got[i][0] for i in range(len(x))] == score.argmax(axis=1).tolist()
    assert np.allclose([got[i][1] for i in range(len(x))], score.max(axis=1))
    far = {r.i: r.cid for r in J.nearest_center(points.where("i < 50"), centers, "k", "v", "c", "cid", cosine=False).collect()}
    assert [far[i] for i in range(50)] == ((x[:50, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_nearest_center_of_odd_vectors(spark):
    points = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, None), (1, 2, []), (1, 3, [1.0, None]), (1, 4, [1.0, 2.0, 3.0]), (2, 5, [1.0, 0.0]), (3, 6, [0.0, 1.0])], "k int, i int, v array<double>")
    centers = spark.createDataFrame([(1, 7, [1.0, 0.0]), (1, 8, [0.0, 1.0]), (3, 9, [1.0, 0.0])], "k int, cid int, c array<double>")
    found = {r.i: (r.cid, r.similarity) for r in J.nearest_center(points, centers, "k", "v", "c", "cid").collect()}
    assert found == {0: (7, 1.0), 1: (None, None), 2: (None, None), 3: (None, None), 4: (None, None), 6: (9, 0.0)}
    assert J.nearest_center(points.limit(0), centers, "k", "v", "c", "cid").count() == 0


@pytest.mark.parametrize("block", [3, 7, 2048])
def test_silhouette_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    rows = [(k, int(c), i, rng.normal(size=3).tolist()) for k in (1, 2) for i, c in enumerate(np.append(rng.integers(0, 4, 40) ** 2, 77))] + [(3, 0, 0, [1.0, 2.0, 3.0])]
    found = {r.k: (r.n, r.silhouette) for r in V.silhouette(spark.createDataFrame(rows, "k int, c int, i int, v array<double>"), "k", "c", "v", "i", block=block).collect()}
    for key in (1, 2):
        own = [(c, np.array(v)) for k, c, _, v in rows if k == key]
        total = 0.0
        for i, (c, v) in enumerate(own):
            mean = {d: np.mean([np.linalg.norm(v - w) for j, (e, w) in enumerate(own) if e == d and j != i] or [0.0]) for d in {e for e, _ in own}}
            a, b = mean[c], min(m for d, m in mean.items() if d != c)
            total += (b - a) / max(a, b)
        assert found[key] == (len(own), pytest.approx(total / len(own)))
    assert found[3] == (1, 0.0)


def test_running_totals_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("o"), F.col("id").alias("v"))
    run, want = 0, {}
    for r in sorted(df.collect()):
        want[r.o], run = run, run + r.v
    assert {r.o: r.t for r in P.totals_before(df, "o", {"t": "v"}).collect()} == want
    assert [r.n for r in P.numbered(df, [F.desc("o")], "n", 5).orderBy(F.desc("o")).collect()] == list(range(5, 1005))
    assert P.totals_before(df.limit(0), "o", {"t": "v"}).count() == 0


def test_ranks_and_encodings_of_large_groups(spark):
    df = spark.createDataFrame([(g, float(v), i) for i, (g, v) in enumerate([("a", 3), ("a", 1), ("a", 3), ("b", 2), (None, 5), (None, 4), ("a", 2)])], "g string, v double, i int")
    for large in (True, False):
        assert {r.i: r.r for r in M.average_ranks(df, {"r": "v"}, ["g"], large).collect()} == {0: 3.5, 1: 1, 2: 3.5, 3: 1, 4: 2, 5: 1, 6: 2}
        flat = M.regression(df.withColumn("c", F.lit(1.0)), "c", "v", ["g"], large).collect()
        assert all(r.pearson == r.spearman == 0 for r in flat) and sum(r.n for r in flat) == 7
    assert {r.i: r.encoded for r in A.target_encoding(df, "g", "i", "v", 1.0, 1.0).collect()} == {0: 1, 1: 2, 2: 5 / 3, 3: 1, 6: 2}


def test_many_partitions_at_the_start(spark):
    """Distinct edges start from many partitions; a user's greater number stays."""
    name, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    G.symmetric(spark.createDataFrame([(1, 2)], "src int, dst int"))
    assert int(spark.conf.get(name)) >= 1024 and spark.conf.get(size) == f"{16 << 20}b"
    spark.conf.set(size, "8m")
    spark.conf.set(name, "5000")
    G.symmetric(spark.createDataFrame([(1, 2)], "src int, dst int"))
    assert spark.conf.get(name) == "5000" and spark.conf.get(size) == "8m"
    spark.conf.unset(name)
    spark.conf.unset(size)


def test_files_in_small_pieces(spark):
    """A task that makes the edges of a table distinct reads a piece of it that doesn't grow with the table; a user's smaller pieces stay."""
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.unset(name)
    registry.queries()["self_loops"](spark, DATA)
    assert spark.conf.get(name) == f"{16 << 20}b"
    spark.conf.set(name, "8MB")
    G.symmetric(spark.createDataFrame([(1, 2)], "src int, dst int"))
    assert spark.conf.get(name) == "8MB"
    spark.conf.unset(name)


def test_edges_are_made_distinct_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (3, 2), (None, 1), (4, None)], "src long, dst long")
    assert sorted(map(tuple, G.symmetric(edges).collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert sorted(map(tuple, G.with_loops(edges).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 3)]
    plan = lambda name: registry.queries()[name](spark, DATA)._jdf.queryExecution()
    assert plan("symmetrize").optimizedPlan().toString().count("Aggregate [") == 2  # the pairs and the degrees
    assert plan("neighbor_mean").optimizedPlan().toString().count("Aggregate [") == 4  # the pairs, the nodes twice, the means


def test_edges_are_not_broadcast(spark):
    plan = registry.queries()["one_way_edges"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_propagation_makes_the_nodes_once(spark):
    """The nodes are not made anew for each step, and the values are those of the normalised matrix."""
    rng, made = np.random.default_rng(5), spark.sparkContext.accumulator(0)

    def node(i):
        made.add(1)
        return i, float(i)

    a = np.triu(rng.random((12, 12)) < 0.3, 1)
    a[:, 11] = False
    a = a + a.T
    edges = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a))], "src long, dst long")
    values = spark.createDataFrame(spark.sparkContext.parallelize(range(12), 2).map(node), "n long, x double")
    root = 1 / np.sqrt(np.maximum(a.sum(axis=0), 1))
    wanted = np.linalg.matrix_power(root[:, None] * a * root, 3) @ np.arange(12)
    got = {r.n: r.x for r in G.propagate(edges, values, "n", "x", 3).collect()}
    assert [got[i] for i in range(12)] == pytest.approx(wanted.tolist()) and len(got) == 12
    assert made.value <= 2 * 12
    assert {r.n: r.x for r in G.propagate(edges, values, "n", "x", 0).collect()} == {i: float(i) for i in range(12)}


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_hops_write_what_further_steps_start_from(spark, monkeypatch, most):
    written = []
    for name in ("cut", "stored"):
        monkeypatch.setattr(G, name, lambda df, *rest, real=getattr(G, name): written.append(1) or real(df, *rest))
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2))] + [(0, i) for i in range(40, 50)] + [(41, 0)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wanted = set()
    for n in near:
        seen = last = {n}
        for hop in range(1, most + 1):
            last = set().union(*(near[m] for m in last)) - seen
            seen = seen | last
            wanted |= {(n, m, hop) for m in last}
    df = spark.createDataFrame(edges, "src long, dst long")
    found = [tuple(r) for r in G.hops(df, most).select("src", "dst", "hop").collect()]
    assert len(found) == len(wanted) and set(found) == wanted and len(written) == max(1, most - 1)
    if most == 3:
        weights = {(r.src, r.dst, r.kind): r.weight for r in G.weighted_hops(df).collect()}
        assert weights == {(a, b, k): {1: 1.0, 2: 0.5, 3: 0.3}[k] for a, b, k in wanted} | {(n, n, 0): 1.0 for n in near}
