"""Principal components and soft clusters against numpy."""

import numpy as np
import pytest

from quillon.operators import latents as L

SCHEMA = "key string, id long, v array<float>"


def frame(spark, x, keys=None, bad=True):
    rows = [(keys[i] if keys else "a", i, [float(a) for a in r]) for i, r in enumerate(x.astype(np.float32))]
    if bad:
        rows += [("a", -1, None), ("a", -2, [None] * x.shape[1]), ("none", -3, [1.0] * x.shape[1])]
    return spark.createDataFrame(rows, SCHEMA)


def test_principal_components(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 1000).astype(np.float32)
    df = frame(spark, x, bad=False).union(spark.createDataFrame([("a", -1, None), ("a", -2, [None] * 6), ("a", -3, [float("nan")] * 6), ("a", -4, [1.0]), ("a", -5, [])], SCHEMA))
    x = x.astype(np.float64)
    n, mean, products = L.moments(df.repartition(7, "id"), "v")
    assert n == 500 and np.allclose(mean, x.mean(axis=0), rtol=1e-12) and np.allclose(products / 499, np.cov(x.T), rtol=1e-8)
    mean, directions, variances = L.principal_components(df, "v", 3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for k in range(3):
        one = vectors[:, -1 - k]
        assert np.allclose(np.abs(directions[k] @ one), 1, atol=1e-8) and directions[k][np.abs(directions[k]).argmax()] > 0 and abs(variances[k] - values[-1 - k]) < 1e-8 * values[-1]
    found = {r.id: r.projection for r in L.project(df, "v", mean, directions).collect()}
    assert np.allclose([found[i] for i in range(500)], (x - x.mean(axis=0)) @ directions.T, atol=1e-6) and found[-1] is found[-2] is found[-4] is None
    assert L.principal_components(df.where("id < 0 and id > -3"), "v", 2)[1].size == 0
    assert L.covariances(df, "v").count() == 21


def plain(x, start, rounds, hard):
    weight, mean, var = np.full(len(start), 1 / len(start)), start.copy(), np.tile(np.maximum(x.var(axis=0), L.LEAST), (len(start), 1))
    told = []
    for _ in range(rounds):
        logs = np.log(np.maximum(weight, 1e-300)) - 0.5 * (((x[:, None, :] - mean) ** 2 / var) + np.log(2 * np.pi * var)).sum(axis=2)
        total = np.log(np.exp(logs - logs.max(axis=1)[:, None]).sum(axis=1)) + logs.max(axis=1)
        told.append(total.sum())
        r = np.eye(len(start))[logs.argmax(axis=1)] if hard else np.exp(logs - total[:, None])
        n = r.sum(axis=0)
        weight = n / len(x)
        for k in np.nonzero(n)[0]:
            mean[k] = r[:, k] @ x / n[k]
            var[k] = np.maximum(r[:, k] @ (x * x) / n[k] - mean[k] ** 2, L.LEAST)
    return weight, mean, var, told


@pytest.mark.parametrize("hard", [False, True])
def test_soft_clusters(spark, monkeypatch, hard):
    monkeypatch.setattr(L, "POINTS", 50)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, s, (80, 3)) for m, s in ((0, 1), (4, 0.3), (-3, 2))]).astype(np.float32).astype(np.float64)
    keys = [["a", "b"][i % 2] for i in range(len(x))]
    df = frame(spark, x, keys)
    start = {"a": x[[0, 2, 200]], "b": x[[1, 101]]}
    centers = spark.createDataFrame([(k, c, [float(z) for z in v]) for k, vs in start.items() for c, v in enumerate(vs)] + [("unseen", 0, [0.0, 0.0, 0.0])], "key string, cid int, center array<double>")
    runs = [L.soft_clusters(d, centers, "key", "v", "center", "cid", 4, hard) for d in (df, df.repartition(9, "id"))]
    for clusters, likelihood in runs:
        found, told = clusters.collect(), {(r.key, r.round): r.likelihood for r in likelihood.collect()}
        assert {(r.key, r.cid) for r in found} == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)}
        for k, vs in start.items():
            weight, mean, var, logs = plain(x[[a == k for a in keys]], vs, 4, hard)
            own = sorted((r for r in found if r.key == k), key=lambda r: r.cid)
            assert np.allclose([r.weight for r in own], weight) and np.allclose([r["mean"] for r in own], mean) and np.allclose([r["var"] for r in own], var)
            assert np.allclose([told[k, r] for r in range(4)], logs) and (hard or all(b >= a - 1e-9 for a, b in zip(logs, logs[1:])))  # noqa: B905
