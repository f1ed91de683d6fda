"""Every query that has SQL gives what DuckDB gives, on the smallest tables, whatever the order and partitions of the input."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillon.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        return float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    found, wanted = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The tables with their rows in another order and in many files."""
    folder = tmp_path_factory.mktemp("shuffled")
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.repartition(5, *df.columns[:1]).write.parquet(str(folder / f"{t}.parquet"))
    return str(folder)


ORDERED = ["group_ranking_metrics", "enrichment_factor_ceil", "stratified_block_split", "balanced_undersample", "per_class_sample", "priority_lookup", "argmax_per_run", "dedup_pairs", "ragged_offsets", "epoch_from_markers", "vq_assign", "mlm_mask_shares", "char_vocab", "rolling_mean_20"]


@pytest.mark.parametrize("name", ORDERED)
def test_order_of_rows_does_not_matter(spark, shuffled, name):
    query = registry.queries()[name]
    assert rows(query(spark, DATA).toPandas()) == rows(query(spark, shuffled).toPandas())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_give_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
