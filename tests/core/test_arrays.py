"""Shards of arrays: what numpy writes is read, what is written numpy reads, and failures leave nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import arrays as A


def test_reads_what_numpy_writes(spark, tmp_path):
    rng = np.random.default_rng(1)
    for k, n in ((0, 7), (1, 0), (10, 300)):
        np.save(tmp_path / f"attr_{k}.npy", rng.random((n, 4, 3)).astype("f4"))
        np.save(tmp_path / f"adj_{k}.npy", rng.integers(0, 5, (n, 2)).astype("i4"))
        np.save(tmp_path / f"y_{k}.npy", np.arange(n) / 2)
    np.save(tmp_path / "other_0.npy", np.array([{}], dtype=object), allow_pickle=True)
    df = A.read(spark, str(tmp_path), "shard string, row long, attr array<array<float>>, adj array<long>, y double", task_bytes=4096)
    assert df.rdd.getNumPartitions() > 5  # a file is cut
    rows = {(r.shard, r.row): r for r in df.collect()}
    assert len(rows) == 307
    for k in (0, 10):
        attr, adj = np.load(tmp_path / f"attr_{k}.npy"), np.load(tmp_path / f"adj_{k}.npy")
        for i in range(len(attr)):
            r = rows[str(k), i]
            assert np.array_equal(np.array(r.attr, "f4"), attr[i]) and r.adj == adj[i].tolist() and r.y == i / 2
    assert A.read(spark, str(tmp_path), "y double").agg(F.sum("y")).first()[0] == sum(i / 2 for n in (7, 300) for i in range(n))


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz(spark, tmp_path, save):
    save(tmp_path / "a.npz", x=np.arange(5000.0).reshape(500, 10), n=np.arange(500))
    df = A.read(spark, str(tmp_path), "n long, x array<double>", kind="npz", task_bytes=8000)
    assert (df.rdd.getNumPartitions() > 1) == (save is np.savez)
    assert all(r.x == [10.0 * r.n + j for j in range(10)] for r in df.collect()) and df.count() == 500


def test_errors(spark, tmp_path):
    def fails(folder, schema="x array<double>", **more):
        with pytest.raises(Exception):  # noqa: B017
            A.read(spark, str(folder), schema, **more).collect()

    for name, files in {"empty": {}, "objects": {"x_0": np.array([[None]], dtype=object)}, "order": {"x_0": np.asfortranarray(np.ones((3, 2)))}, "single": {"x_0": np.float64(1)}, "deep": {"x_0": np.ones((2, 2, 2))}, "words": {"x_0": np.array([["a"]])}}.items():
        (tmp_path / name).mkdir()
        for f, a in files.items():
            np.save(tmp_path / name / f"{f}.npy", a)
        fails(tmp_path / name)
    pair = tmp_path / "pair"
    pair.mkdir()
    np.save(pair / "x_0.npy", np.ones((3, 2))), np.save(pair / "y_0.npy", np.ones(2)), np.save(pair / "x_1.npy", np.ones((3, 2)))
    fails(pair, "x array<double>, y double")
    fails(pair, "shard string")
    (pair / "x_1.npy").write_bytes((pair / "x_1.npy").read_bytes()[:-8])
    fails(pair)


@pytest.mark.parametrize("kind", ["npy", "npz"])
def test_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    df = spark.range(0, 2500, 1, 3).select("id", F.array(F.col("id") * 0.5, F.lit(1.0)).cast("array<float>").alias("v"), (F.col("id") % 2 == 0).alias("even"))
    A.write(df, path, kind, rows=400)
    assert len(os.listdir(path)) == 9 * (3 if kind == "npy" else 1)
    back = A.read(spark, path, "id long, v array<float>, even boolean", kind)
    assert sorted(back.collect()) == sorted(df.collect())
    if kind == "npy":
        assert np.load(os.path.join(path, "v_0.npy")).shape == (400, 2) and np.load(os.path.join(path, "id_0.npy"))[:3].tolist() == [0, 1, 2]
    A.write(df.limit(5), path, kind, mode="append")
    assert A.read(spark, path, "id long", kind).count() == 2505
    A.write(df.limit(5), path, kind)
    assert A.read(spark, path, "id long", kind).count() == 5


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    A.write(spark.range(3), path)
    bad = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 99, F.array(F.lit(1.0))).when(F.col("id") != 60, F.array(F.lit(1.0), F.lit(2.0))).alias("v"))
    for df in (bad, bad.where("id <> 60"), bad.where("id <> 99")):  # nulls, and rows of different lengths
        with pytest.raises(Exception):  # noqa: B017
            A.write(df, path, mode="append")
    assert A.read(spark, path, "id long").count() == 3
    assert not [f for f in os.listdir(path) if f.startswith("_writing") or f.startswith("v_")]
    A.write(spark.range(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []
