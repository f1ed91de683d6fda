"""Cutting lineage in a way that survives the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Partitions that shuffles of many small rows start from, and the bytes up to which adaptive execution puts them together and a task reads of files: a hash table of small rows takes some ten times what
#: they take when shuffled or stored.
FINE, FINE_BYTES = 1024, 16 << 20


def finely(spark: SparkSession) -> None:
    """Lets shuffles start from many partitions, which adaptive execution puts together by their sizes, and files be read in small pieces, so that what a task holds doesn't grow with the table. Spark reads
    the settings when a query is planned, after an operator has returned, so they are not put back; more or smaller partitions of the user stay."""
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if int(spark.conf.get(parts, None) or spark.conf.get("spark.sql.shuffle.partitions")) < FINE:
        spark.conf.set(parts, str(FINE))
    for size in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        number, unit = re.match(r"(\d+)\s*([kmgtp]?)", spark.conf.get(size).strip().lower()).groups()
        if int(number) << (10 * " kmgtp".index(unit or " ")) > FINE_BYTES:
            spark.conf.set(size, f"{FINE_BYTES}b")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it names none, a temporary one on a local master, as in tests; elsewhere an error, as executors
    share no local folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    """A new name of a table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written to the shared folder as Parquet and read again."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a table of new_path that nothing needs any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
