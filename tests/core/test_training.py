"""Operators whose answers SQL can't give, or whose edges the tables don't have."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import clean as N
from quillon.functions import molecules as M
from quillon.operators import codebook as C
from quillon.operators import metrics as R
from quillon.operators import splits as S
from quillon.operators import training as T
from quillon.plans import cut as U
from quillon.sources import files as X
from quillon.sources import logs as L
from quillon.sources import sinks as K


def points(spark, n=60, keys=2, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(k, i, rng.normal(size=3).tolist()) for k in range(keys) for i in range(n)], "k int, i int, v array<double>")


def test_a_fresh_codebook(spark):
    few = points(spark).unionByName(spark.createDataFrame([(7, i, [float(i), 0.0, 1.0]) for i in range(3)], "k int, i int, v array<double>"))
    rows = C.init_codebook(few, "k", "i", "v", 5, 2).collect()
    again = C.init_codebook(few.repartition(3), "k", "i", "v", 5, 2).collect()
    key = lambda r: (r.k, r.cid, [round(x, 9) for x in r.center])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert {k: sorted(r.cid for r in rows if r.k == k) for k in (0, 1, 7)} == {k: list(range(5)) for k in (0, 1, 7)}
    padded = [r for r in rows if r.padded]
    assert {(r.k, r.cid) for r in padded} == {(7, 3), (7, 4)} and all(np.abs(np.array(r.center) - [1, 0, 1]).max() <= 0.01 + 1e-9 for r in padded)


def test_seeds_are_distinct_and_far(spark):
    df = spark.createDataFrame([(0, i, [float(i // 10 * 100), float(i % 10) / 100]) for i in range(40)], "k int, i int, v array<double>")
    found = C.per_key_seeds(df, "k", "i", "v", 4).collect()
    assert len({tuple(r.center) for r in found}) == 4 and {round(r.center[0] / 100) for r in found} == {0, 1, 2, 3}


def test_fills(spark):
    book = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [5.0])], "k int, cid int, center array<double>")
    got = lambda mode, **more: sorted((r.k, r.cid, r.center[0]) for r in C.filled(book, "k", 4, mode, **more).collect())
    assert got("repeat") == [(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 3, 2), (2, 0, 5), (2, 1, 5), (2, 2, 5), (2, 3, 5)]
    assert got("first")[2:4] == [(1, 2, 1), (1, 3, 1)]
    data = spark.createDataFrame([(k, i, [10.0 * k + i]) for k in (1, 2) for i in range(3)], "k int, i int, v array<double>")
    filled = got("data", points=data, row="i", vector="v")
    assert len(filled) == 8 and all(v in {10.0 * k + i for i in range(3)} for k, c, v in filled if (k, c) not in {(1, 0), (1, 1), (2, 0)})


def test_mini_batches_come_to_the_means_of_far_clusters(spark):
    rows = [(0, i, [100.0 * (i % 3) + i / 1000, 0.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, i int, v array<double>")
    start = spark.createDataFrame([(0, c, [100.0 * c + 5, 1.0]) for c in range(3)], "k int, cid int, center array<double>")
    found = {r.cid: r.center for r in C.mini_batches(df, start, "k", "i", "v", 4).collect()}
    assert {c: [pytest.approx(np.mean([v[0] for _, i, v in rows if i % 3 == c])), 0.0] for c in range(3)} == found


def test_gaussians_tell_far_clusters_apart(spark):
    df = spark.createDataFrame([(i, [float(i % 2 * 50) + i % 7 / 10, i % 5 / 10]) for i in range(80)], "i int, v array<double>").coalesce(1)  # Spark starts from a sample that goes by partitions
    of = {r.i: r.cid for r in C.gaussian_mixture(df, "i", "v", 2, seed=1).collect()}
    assert len({of[i] for i in range(0, 80, 2)}) == 1 and len({of[i] for i in range(1, 80, 2)}) == 1 and of[0] != of[1]


@pytest.mark.parametrize("block", [7, 2048])
def test_pair_loss_by_blocks(spark, block):
    rng = np.random.default_rng(2)
    x, t = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    df = spark.createDataFrame([(int(k), i, v.tolist()) for i, (k, v) in enumerate(zip(t, x, strict=True))], "t int, i int, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    same = t[:, None] == t[None]
    assert C.same_type_loss(df, "t", "i", "v", block).first()["loss"] == pytest.approx((same * d + np.exp(-(1 - same) * d)).mean() / 10000)


def test_metrics_of_one_class_and_few_rows(spark):
    df = spark.createDataFrame([(i, 0.1 * i, 1.0) for i in range(5)], "i int, logit double, y double")
    r = R.logit_block(df, "logit", "y").first()
    assert (r.auroc, r.average_precision, r.f1) == (0, 0, 0) and r.prob_mean > 0.5
    few = R.affinity_ranking(df, "logit", "y", F.col("i") < 2, "i").first()
    assert few.aff_n == 2 and few.spearman == few.pearson == few.ndcg20 == 0
    assert R.affinity_ranking(df, "logit", "y", F.lit(False), "i").first().aff_n == 0


def test_cursor_and_its_end(spark):
    stream = spark.range(10).select(F.col("id").alias("place"), (F.col("id") * 2).alias("t"))
    batches = spark.createDataFrame([(3, 4), (1, 3), (2, 0)], "b int, need int")
    got = {(r.place, r.b) for r in T.cursor_slices(stream, "place", batches, "b", "need", block=2).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 3)}
    with pytest.raises(ValueError):
        T.cursor_slices(stream, "place", batches.union(batches), "b", "need")


def test_rows_of_tables(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(T.top_mask(a(3.0, 1.0, 3.0, 2.0), 0.25)) == [3, 0, 0, 0] and one(T.top_mask(a(1.0, 2.0), 1.0)) == [1, 2]
    assert one(T.masked_mean(a(1.0, 3.0), a(True, True))) == 0 and one(T.masked_max(a(-1.0, -3.0), a(True, False))) == -3
    assert one(N.shape_fault(F.lit(None).cast("array<array<double>>"), 3, 9)) == "empty" and one(N.superscript(F.lit(-12))) == "⁻¹²"
    assert one(M.letter(F.lit(None).cast("string"))) == "X" and one(M.letter(F.lit("mse"))) == "M" and not one(M.is_protein_residue(F.lit("HETATM"), F.lit("ALA")))
    f = one(M.bond_features(F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("boolean"), F.lit(None).cast("array<int>"), F.lit("STEREOZ"), F.lit("NONE")))
    assert f == [0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0]
    short = one(M.bond_features(F.lit("SINGLE"), F.lit(False), F.lit(False), F.lit(None).cast("array<int>"), F.lit("Z"), F.lit("NONE")))
    assert short[14:19] == [0, 0, 0, 0, 1]  # a name without its prefix is none of the known ones


def test_counts_of_two_grammars(spark):
    lines = ["x Silhouette Score (subsample): 6_1 0.50, sample size 9, K_e 3", '  "6_1": 4,', "6_2 7", "6_2: 1", "[VQ_COMMIT] 1 2", "", "a b c"]
    assert {r.key: r.n for r in L.raw_counts(spark.createDataFrame([(x,) for x in lines], "line string")).collect()} == {"6_1": 13, "6_2": 8}


def test_archives(spark, tmp_path):
    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        for name, text in (("run/attr_10.npy", b"ten"), ("run/attr_2.npy", b"two"), ("run/x.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    members = X.tar_members(spark, str(path), r"\.npy$")
    assert {r.member: bytes(r.content) for r in members.collect()} == {"run/attr_10.npy": b"ten", "run/attr_2.npy": b"two"}
    r = X.tar_batches(members).first()
    assert (r.prefix, r.batches) == ("run/", [2, 10])


def test_files_that_lack(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    assert X.delimited(spark, str(tmp_path / "a.csv")).count() == 0
    with pytest.raises(ValueError):
        X.delimited(spark, str(tmp_path / "a.csv"), required=["c"])
    with pytest.raises(ValueError):
        X.shards(X.listing(spark, str(tmp_path)), r"\.npy$")
    assert [r.name for r in X.shards(X.listing(spark, str(tmp_path)), r"\.csv$").collect()] == ["a.csv"]
    (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines"\n')
    assert X.delimited(spark, str(tmp_path / "q.csv"), multi_line=True).first()["b"] == "two\nlines"
    K.append_log(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "log"))
    K.append_log(spark.createDataFrame([(2,)], "a int"), str(tmp_path / "log"))
    assert sorted(r.a for r in spark.read.schema("a int").json(str(tmp_path / "log")).collect()) == [1, 2]


def test_shards_of_an_epoch(spark):
    names = spark.createDataFrame([(f"s{i}",) for i in range(6)], "name string")
    one, two = ([r.name for r in S.epoch_shards(names, "name", 4, e, 1).orderBy("pick").collect()] for e in (0, 1))
    assert len(set(one)) == 4 and one != two
    assert len(S.epoch_shards(names, "name", 20, 0, 1).collect()) == 20
    with pytest.raises(ValueError):
        S.epoch_shards(names.limit(0), "name", 4, 0, 1)


def test_a_shared_folder_is_asked_for_off_a_local_master():
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        U.shared_folder(Session())


def test_pair_loss_of_many_blocks_on_a_side(spark):
    """Where a task takes several blocks of both sides, parts meet once, and the loss is that of all pairs."""
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=(200, 3)), rng.integers(0, 3, 200)
    df = spark.createDataFrame([(int(k), i, v.tolist()) for i, (k, v) in enumerate(zip(t, x, strict=True))], "t int, i int, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    same = t[:, None] == t[None]
    assert C.SIDE == 8 and C.same_type_loss(df, "t", "i", "v", 3).first()["loss"] == pytest.approx((same * (d + 1) + (~same) * np.exp(-d)).mean() / 10000)


def test_top_mask_ranks_once(spark):
    """The ranking of an array is bound once, not made for each of its numbers."""
    df = spark.createDataFrame([([0.5, -1.0, 0.5, 0.25, 0.0, 0.5],)], "w array<double>").select(T.top_mask(F.col("w"), 0.3).alias("m"))
    assert df.first().m == [0.5, 0.0, 0.5, 0.0, 0.0, 0.0]
    assert " transform(array(transform(slice(" in df._jdf.queryExecution().analyzed().toString().replace("get(", " ")
