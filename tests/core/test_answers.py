"""Answers worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import clean as C
from quillon.functions import tokens as T
from quillon.operators import aggregates as A
from quillon.operators import codebook as V
from quillon.operators import graph as G
from quillon.operators import metrics as M
from quillon.operators import splits as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def scored(spark):
    return spark.createDataFrame([(1, 0.9, 1, 0), (1, 0.9, 0, 1), (1, 0.5, 1, 2), (1, 0.1, 0, 3)], "g int, s double, y int, i int")


def test_ranking(spark):
    assert M.auroc(scored(spark), "s", "y").first()[0] == pytest.approx(0.625)
    assert M.average_precision(scored(spark), "s", "y").first()[0] == pytest.approx(0.583333, abs=1e-6)
    assert M.auroc(scored(spark).where("y = 1"), "s", "y").first()[0] == 0
    df = spark.createDataFrame([(1, 0.9, 3.0, 0), (1, 0.8, 1.0, 1), (1, 0.1, 2.0, 2), (2, 0.3, 1.0, 0)], "g int, s double, y double, i int")
    found = M.group_ranking(df, "s", "y", "g", "i").collect()
    assert len(found) == 1 and found[0]["ndcg10"] == pytest.approx(0.963940433)


@pytest.mark.parametrize(("n", "ceil", "even"), [(5, 1, 1), (14, 2, 1), (15, 2, 2), (25, 3, 2)])
def test_top_counts(spark, n, ceil, even):
    r = spark.range(1).select(F.lit(n).alias("n")).select(M.top_count(0.1).alias("a"), M.top_count(0.1, "even").alias("b")).first()
    assert (r.a, r.b) == (ceil, even)


def test_cluster_metrics(spark):
    r = A.entropy_metrics(spark.createDataFrame([(1, 4), (1, 2), (1, 1), (1, 1), (1, 0)], "k int, n int"), ["k"], "n").first()
    assert (r.entropy, r.perplexity, r.max_share, r.singleton_clusters, r.singleton_points) == pytest.approx((1.213007566, 3.363585661, 0.5, 0.5, 0.25))


def test_silhouette(spark):
    df = spark.createDataFrame([(1, "a", [0.0], 0), (1, "a", [1.0], 1), (1, "b", [10.0], 2)], "k int, c string, v array<double>, i int")
    assert V.silhouette(df, "k", "c", "v", "i").first()["silhouette"] == pytest.approx(0.929630, abs=1e-6)


def test_moving_average(spark):
    state = spark.createDataFrame([(1, 0, [1.0, 0.0], 10.0, [10.0, 0.0], 0.0, 0, -1, 0), (1, 1, [0.0, 1.0], 1.0, [0.0, 1.0], 0.0, 0, -1, 0)], "k int, cid int, center array<double>, cs double, ea array<double>, ue double, ever int, last_ep int, cooldown int")
    sums = spark.createDataFrame([(1, 0, 5, [0.0, 5.0])], "k int, cid int, n long, sums array<double>")
    a, b = V.ema_step(state, sums, "k", 0.8, epoch=4).orderBy("cid").collect()
    assert a.cs == pytest.approx(9) and a.center == pytest.approx([0.992277877, 0.124034735]) and a.ea == pytest.approx([8.930500890, 1.116312611])
    assert (a.ever, a.last_ep) == (1, 4) and b.center == [0.0, 1.0] and (b.ever, b.last_ep) == (0, -1)


def test_global_ids(spark):
    book = spark.createDataFrame([("6_0", i) for i in range(3)] + [("16_0", i) for i in range(2)] + [("6_-1", 0)], "key string, cid int")
    assert [(r.safe, r.offset) for r in V.global_ids(book, "key").orderBy("offset").collect()] == [("k_16_0", 0), ("k_6_0", 2), ("k_6__1", 5)]


@pytest.mark.parametrize(("n", "a", "b"), [(30, 1, 1), (31, 2, 1), (999, 34, 10), (1000, 34, 34)])
def test_codebook_sizes(spark, n, a, b):
    r = one(spark, a=T.codebook_size(F.lit(n)), b=T.codebook_size_by_bands(F.lit(n)))
    assert (r.a, r.b) == (a, b)


def test_cells(spark):
    got = lambda text: one(spark, x=C.number(F.lit(text))).x
    assert [got(x) for x in (">1,200", "-5", "", "abc", "inf", "nan", None)] == [1200.0, None, None, None, None, None, None]
    r = one(spark, a=C.p_value(F.lit(1200.0)), b=C.typed_affinity(F.lit("IC50=12.5uM")), c=C.typed_affinity(F.lit("Kd=3M")), d=C.typed_affinity(F.lit("x Kd 12 nM")), e=C.typed_affinity(F.lit("kd12NM")))
    assert (r.d.kind, r.d.op, r.d.nanomolar) == ("Kd", "", 12.0) and (r.e.kind, r.e.nanomolar) == ("kd", 12.0)
    assert r.a == pytest.approx(5.920818754) and r.b.p == pytest.approx(4.903089987) and r.c is None
    assert one(spark, x=C.binarize(F.lit(float("nan")), 1.0)).x == 0
    r = one(spark, a=C.stable_hash(F.lit("abc"), 123, 16).cast("string"), b=C.stable_hash(F.lit("abc"), 123))
    assert (r.a, r.b) == ("17295056049108219599", 1080941003069263724)
    assert C.resolve_column(["Target Name", "pdb_id"], ["PDB", "target name"]) == "Target Name"


def test_tokens(spark):
    got = lambda text: one(spark, x=T.regex_tokens(F.lit(text))).x
    assert got("CCl") == ["C", "Cl"] and got("c1ccccc1O") == ["O"] and got("Cn1cccc1") == ["Cn"] and got("CC(=O)O") == ["C", "C", "(", "=", "O", ")", "O"]
    assert got("[C@@H](O)Mg.N\\C-1%12") == ["[", "C", "@@", "H", "]", "(", "O", ")", "Mg", ".", "N", "\\", "C"]
    assert one(spark, x=T.ints(F.lit(" 1,2 x 3 "))).x == [1, 2, 3] and one(spark, x=T.ints_or_json(F.lit("[4, 5]"))).x == [4, 5]
    df = spark.createDataFrame([(0, 0, ["a"] * 3), (0, 1, ["b"]), (0, 2, ["c"] * 2)], "b int, i int, t array<string>")
    assert [r.offset for r in T.ragged(df, "b", "i", "t").orderBy("i").collect()] == [0, 3, 4]
    assert [one(spark, x=T.unknown_to_mask(F.lit(t), 11)).x for t in (5, -1, 7)] == [5, 11, 7]
    assert one(spark, x=T.padded(F.array(F.lit(1)), 3, 0)).x == [1, 0, 0]


def test_splits(spark):
    hits = lambda *h: one(spark, x=S.guide_split(*[F.lit(bool(x)) for x in h])).x
    assert [hits(1, 0, 0), hits(0, 1, 0), hits(1, 1, 0), hits(0, 0, 0)] == ["guide_train", "guide_test", "drop_overlap", "guide_train"]
    clusters = spark.createDataFrame([(i, 5) for i in range(23)], "c int, n int")
    counts = {r.split: r["count"] for r in S.block_split(clusters, [F.desc("n")], "c", 1).groupBy("split").count().collect()}
    assert counts == {"train": 19, "valid": 2, "test": 2}


def test_two_hop_code(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src int, dst int")
    kinds = spark.createDataFrame([(0, "C"), (1, "C"), (2, "N")], "node int, z string")
    assert {r.src: r.code for r in G.two_hop_code(edges, kinds, "node", "z", {"N": 1, "O": 3, "R": 9}).collect()} == {0: 1, 1: 0, 2: 0}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(500, i) for i in range(501, 600)] + [(None, 3), (9, 9)]
    found = G.components(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert {r.node: r.component for r in found} == {i: 100 for i in range(100, 165)} | {i: 500 for i in range(500, 600)}


def test_codebook_changes():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal([3, 0], 0.5, (300, 2)), rng.normal([0, 3], 0.1, (20, 2))])
    cid = np.array([0] * 300 + [1] * 20)
    book, use = np.array([[1.0, 0], [0, 1.0], [-1.0, 0]]), np.array([300.0, 20, 0.0])
    center, cs, ue, cooldown = V.split_winner(book, use, use / 2, np.zeros(3, int), x, cid)
    assert cs.tolist() == [150, 20, 150] and ue.tolist() == [75, 10, 75] and cooldown.tolist() == [2000, 0, 2000] and not np.allclose(center[0], center[2])
    even = np.array([250.0, 250, 250, 250, 250, 250])
    split = lambda ue, before: not np.array_equal(V.split_winner(np.eye(6), even, ue, np.zeros(6, int), np.ones((300, 6)), np.zeros(300, int), before)[2], ue)
    rising = np.array([22.0, 17, 16, 15, 15, 15])  # a share of 0.22 of use, 0.193 mixed: only growth lets it split
    assert split(rising, 0.1) and not split(rising, 0.18) and not split(even, 0.0)
    center, cs, ue = V.revive(np.eye(2), np.array([0.05, 9.0]), np.array([0.0, 1.0]), x)
    assert cs.tolist() == [32, 9] and ue.tolist() == [32, 1]
    assert V.prune(np.array([0, 2]), 3).tolist() == [True, False]
    chosen = V.seeds(x, 5, 1)
    assert len(set(chosen)) == 5


def test_masking_shares(spark):
    df = T.masked(spark.range(20000).withColumn("t", F.col("id") % 50), "t", ["id"], 50, 51, 0.3, 1)
    assert df.where("label >= 0").count() / 20000 == pytest.approx(0.3, abs=0.02)
    assert df.where("label >= 0 AND input = 51").count() / df.where("label >= 0").count() == pytest.approx(0.8, abs=0.03)
    assert df.where("label < 0 AND input <> t").count() == 0
