import numpy as np

from quillon.operators import geometry as G
from quillon.operators.quantiles import quantiles


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][i % 3], float(x)) for i, x in enumerate(rng.normal(size=200))] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("nothing", None), ("a", None)]
    rows += [("same", 7.5)] * 3000
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    at = {"low": 0.0, "q1": 0.1, "half": 0.5, "q99": 0.99, "high": 1.0}
    found = {r.g: [r[n] for n in at] for r in quantiles(df, ["g"], "v", at).collect()}
    of = {g: [v for k, v in rows if k == g and v is not None] for g in {k for k, _ in rows}}
    assert set(found) == set(of) - {"nothing"}
    for g, got in found.items():
        assert np.allclose(got, np.quantile(of[g], list(at.values())), rtol=1e-14)
    whole = quantiles(df, [], "v", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0].m == 7.5 and quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_a_hundred_thousand_equal_values(spark):
    df = spark.range(100_000).selectExpr("0 as g", "10e0 as _most", "case when id < 5 then 1e0 else 4e0 end as d")
    assert G.exact_quantiles(df, (0.0, 0.5, 1.0)).first().asDict() == {"g": 0, "n": 100_000, "q0": 1.0, "q50": 4.0, "q100": 4.0}
    plan = quantiles(df, [], "d", {"m": 0.5})
    assert plan.first().m == 4.0
