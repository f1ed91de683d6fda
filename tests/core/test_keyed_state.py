"""Keyed state over a stream: as the batches, however the stream is cut, and after a restart."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import codebook as C
from quillon.streaming import keyed_state as K

SCHEMA = "label int, step long, vec_id int, embedding array<double>"


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, i // 20, i, [float((i * 7 + k) % 5) - 1, 1.0 + i % 3, float(k)]) for k in range(3) for i in range(60 if k < 2 else 20)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def run(spark, points, book, tmp, cuts, stop=None):
    """The stream over files in an order, one a micro-batch; restarted after stop of them."""
    K.use_rocks(spark)
    ends = spark.createDataFrame([(k, 3, None, None) for k in range(3)] + [(None, 1, None, None), (9, 1, 1, [1.0, 1.0, 1.0])], SCHEMA)
    parts = [points.where(c) for c in cuts] + [ends]

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
        out = K.follow(stream, book, "label", "step", "embedding")
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp}/cp").option("path", f"{tmp}/out").trigger(availableNow=True).start().awaitTermination()

    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp}/in/{i}")
        if i == stop or i == len(parts) - 1:
            go()
    return spark.read.parquet(f"{tmp}/out")


def plain(rows):
    return sorted((r.label, r.step, r.cid, r.n, round(r.cs, 9), round(r.ue, 9), [round(x, 9) for x in r.center], r.last_ep, r.late) for r in rows.collect())


def test_as_the_batches_however_cut(spark, points, tmp_path):
    book = C.first_centers(points, "label", "vec_id", "embedding", 3).cache()
    one = run(spark, points, book, tmp_path / "a", ["true"])
    many = run(spark, points, book, tmp_path / "b", ["vec_id < 7", "vec_id between 7 and 33", "vec_id > 33 and label <> 1", "vec_id > 33 and label = 1"], stop=1)
    assert plain(one) == plain(many)
    state = C.start_state(book)
    for step in range(3):
        part = points.where(F.col("step") == step)
        state = C.ema_step(state, C.batch_sums(C.assign(part, state, "label", "embedding"), "label", "embedding"), "label", epoch=step)
        wanted = sorted((r.label, r.cid, round(r.cs, 9), round(r.ue, 9), [round(x, 9) for x in r.center], r.last_ep) for r in state.where(f"label < 2 or {step} = 0").collect())
        assert sorted((r.label, r.cid, round(r.cs, 9), round(r.ue, 9), [round(x, 9) for x in r.center], r.last_ep) for r in one.where(F.col("step") == step).collect()) == wanted
    assert {(r.label, r.step) for r in K.latest(one, "label").collect()} == {(0, 2), (1, 2), (2, 0)}


def test_late_and_unfit_points(spark, points, tmp_path):
    book = C.first_centers(points, "label", "vec_id", "embedding", 3).cache()
    odd = spark.createDataFrame([(0, 1, 1, [1.0]), (0, 1, 2, [float("nan"), 0.0, 0.0]), (0, 1, 3, None), (0, None, 4, [1.0, 1.0, 1.0])], SCHEMA)
    both = points.where("label = 0").union(odd)
    got = run(spark, both, book, tmp_path, ["step = 0", "step = 1 and (vec_id < 35)", "step is null", "step = 2", "step = 1 and vec_id >= 35"])
    assert {(r.step, r.late) for r in got.collect()} == {(0, 0), (1, 0), (2, 5)}
    assert got.groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect() == [(0, 20), (1, 15), (2, 20)]
