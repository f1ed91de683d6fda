"""A codebook that follows a stream with a state for each key, kept by Spark's state store: only keys that get points are touched, and a restart goes on from the last snapshot.

Points carry the number of their step, so that results don't hang on how the stream is cut into micro-batches: a step's points are assigned to the centres as they were when it began, and the centres move once a
point of a later step of the key comes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType

from quillon.operators.codebook import LEAST_COUNT

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have the package on their path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state of a key: the open step (-1: none yet), rows that came too late, ids of centres, counts and usage as moving averages, last step of use, and of the open step counts; centres and sums are laid flat.
STATE = "step long, late long, cids array<long>, cs array<double>, ue array<double>, last array<long>, n array<long>, centers array<double>, sums array<double>"
OUT = "step long, cid long, n long, center array<double>, cs double, ue double, last_ep long, late long"


class Follower(StatefulProcessor):
    """Moves the centres of a key as codebook.ema_step does."""

    def __init__(self, key: str, gamma: float, usage: float, ttl_ms: int | None, least: float):
        self.key, self.gamma, self.usage, self.ttl_ms, self.least = key, gamma, usage, ttl_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("centres", STATE, self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values("cid")
        k, flat = len(rows), [float(x) for c in rows["center"] for x in c]
        self.state.update((-1, 0, [int(c) for c in rows["cid"]], [1.0] * k, [0.0] * k, [-1] * k, [0] * k, flat, [0.0] * len(flat)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        parts = [r for r in rows if len(r)]
        if not self.state.exists() or not parts:
            return
        step, late, cids, *rest = self.state.get()
        k = len(cids)
        cs, ue, last, n, centers, sums = (np.array(list(x)) for x in rest)
        centers, sums = centers.reshape(k, -1), sums.reshape(k, -1)
        for number, own in pd.concat(parts).groupby("step", sort=True):
            if number < step:
                late += len(own)
                continue
            if 0 <= step < number:
                centers, cs, ue, last = self._moved(step, centers, cs, ue, last, n, sums)
                yield pd.DataFrame({self.key: [key[0]] * k, "step": step, "cid": list(cids), "n": n, "center": centers.tolist(), "cs": cs, "ue": ue, "last_ep": last, "late": late})
                n, sums = np.zeros_like(n), np.zeros_like(sums)
            step = int(number)
            vectors = [v for v in own["vector"] if v is not None and len(v) == centers.shape[1]]
            x = np.array(vectors, np.float64).reshape(-1, centers.shape[1])
            x = x[np.isfinite(x).all(axis=1)]
            alike = x @ centers.T
            best = (alike >= alike.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
            n = n + np.bincount(best, minlength=k)
            np.add.at(sums, best, x)
        self.state.update((step, late, list(cids), cs.tolist(), ue.tolist(), last.tolist(), n.tolist(), centers.ravel().tolist(), sums.ravel().tolist()))

    def _moved(self, step: int, centers, cs, ue, last, n, sums):
        """Centres, counts, usage and last use after a step."""
        import numpy as np

        active, ea = n > 0, centers * np.maximum(cs, self.least)[:, None]
        cs = self.gamma * cs + (1 - self.gamma) * n
        mixed = (self.gamma * ea + (1 - self.gamma) * sums) / np.maximum(cs, self.least)[:, None]
        unit = mixed / np.maximum(np.sqrt((mixed * mixed).sum(axis=1, keepdims=True)), 1e-12)
        return np.where(active[:, None], unit, centers), cs, self.usage * ue + (1 - self.usage) * n, np.where(active, step, last)

    def close(self) -> None:
        pass


def follow(points: DataFrame, codebook: DataFrame, key: str, step: str, vector: str, gamma: float = 0.8, usage: float = 0.97, ttl_ms: int | None = None) -> DataFrame:
    """(key, step, cid, n, center, cs, ue, last_ep, late): the state of a key's centres after each of its steps that is closed, final once it appears; for writeStream in append or update mode.

    codebook (key, cid, center) is the start of keys, taken up by the first micro-batch of a new checkpoint. A step of a key closes when a point of a later one comes; a row with a null vector closes steps
    without being a point, as do vectors of another length or with values that aren't finite. Points of a step that is closed already change nothing and are counted in late. Points of keys without centres, null
    keys and null steps go. Steps are 0 or more. A micro-batch's points of one key are in one task's memory, so the source's own bound on a micro-batch (maxFilesPerTrigger, maxBytesPerTrigger) bounds it;
    the state itself is as large as the key's centres. With ttl_ms a key that has no points for so long is forgotten and then unknown. The session needs the state store of RocksDB (use_rocks).
    """
    kind: DataType = points.schema[key].dataType
    rows = points.where(F.col(key).isNotNull() & F.col(step).isNotNull()).select(key, F.col(step).cast("long").alias("step"), F.col(vector).cast("array<double>").alias("vector"))
    start = codebook.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias(key), F.col("cid").cast("long").alias("cid"), F.col("center").cast("array<double>").alias("center")).groupBy(key)
    processor = Follower(key, gamma, usage, ttl_ms, LEAST_COUNT)
    time = "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind.simpleString()}, {OUT}", "Append", time, start)


def use_rocks(spark) -> None:
    """Sets the state store that keyed state needs, for the streams that the session starts from here on."""
    spark.conf.set(PROVIDER, ROCKS)


def latest(states: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last closed step."""
    last = states.groupBy(key).agg(F.max("step").alias("step"))
    return states.join(last, [key, "step"])
