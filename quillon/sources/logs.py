"""Text logs of training: lines to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def init_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(key, n, k_req, k_run, k_used) of "[init_embed_] Z=... N=... K_req=... K_run=... K_used=u/k"."""
    pattern = r"\[init_embed_\] Z=(\S+) N=(\d+) K_req=(\d+) K_run=(\d+) K_used=(\d+)/(\d+)"
    part = lambda k: F.regexp_extract(line, pattern, k)
    return lines.where(F.col(line).rlike(pattern)).select(part(1).alias("key"), *[part(k).cast("long").alias(c) for k, c in ((2, "n"), (3, "k_req"), (4, "k_run"), (5, "k_used"))])


def silhouette_lines(lines: DataFrame, line: str = "line", signed: bool = True) -> DataFrame:
    """The columns of lines and key, score, sample and k_e of "Silhouette Score (subsample): ..."; without signed, negative scores are not read."""
    number = r"(-?\d+\.\d+)" if signed else r"(\d+\.\d+)"
    pattern = rf"Silhouette Score \(subsample\): (\S+) {number}, sample size (\d+), K_e (\d+)"
    part = lambda k: F.regexp_extract(line, pattern, k)
    return lines.where(F.col(line).rlike(pattern)).select("*", part(1).alias("key"), part(2).cast("double").alias("score"), part(3).cast("long").alias("sample"), part(4).cast("long").alias("k_e"))


def is_epoch_marker(line: Column) -> Column:
    return line.contains("[CODEBOOK] mode=")


def metric(document: Column, section: list[str], name: str) -> Column:
    """A number of a JSON document, under the first of some section names that has it."""
    return F.coalesce(*[F.get_json_object(document, f"$.{s}.{name}").try_cast("double") for s in section])


#: A line of a key, quoted or not, and a number.
KEY_NUMBER = r'^\s*"?([^":,\s]+)"?\s*[: ,]\s*([0-9]+)\s*,?\s*$'


def raw_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """(key, n): totals by key of two kinds of lines, the sample size of a silhouette line and a key and a number; others are left out."""
    of_score = r"Silhouette Score \(subsample\): (\S+) -?\d+\.\d+, sample size (\d+)"
    plain = KEY_NUMBER
    pick = lambda k: F.when(F.col(line).rlike(of_score), F.regexp_extract(line, of_score, k)).when(F.col(line).rlike(plain), F.regexp_extract(line, plain, k))
    rows = lines.select(pick(1).alias("key"), pick(2).cast("long").alias("n"))
    return rows.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
