"""All registered queries of the engine, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import clean_queries, file_queries, latent_queries, log_queries, loss_queries, measure_queries, metric_queries, molecule_queries, structure_queries, table_queries, training_queries, vector_queries

MODULES = (metric_queries, clean_queries, table_queries, vector_queries, loss_queries, log_queries, structure_queries, file_queries, training_queries, measure_queries, molecule_queries, latent_queries)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
