"""Writers. Files appear whole or not at all, as Spark commits them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.splits import seeded
from quillon.plans.prefix import numbered


def delimited(df: DataFrame, path: str, fields: list[str]) -> None:
    """A table with a header and the given fields; what df lacks, and nulls, are empty."""
    df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in fields]).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def by_split(df: DataFrame, path: str, split: str, cluster: str, keys: list[str], seed: int) -> None:
    """A folder for each split; clusters stay together, in a seeded order, and so do their rows."""
    ordered = df.withColumn("_c", seeded(seed, split, cluster)).withColumn("_r", seeded(seed, *keys))
    ordered.repartition(F.col(split), F.col(cluster)).sortWithinPartitions(split, "_c", cluster, "_r", *keys).drop("_c", "_r").write.mode("overwrite").partitionBy(split).parquet(path)


def fasta(df: DataFrame, path: str, id_col: str, seq_col: str, width: int = 80) -> None:
    """FASTA records with lines of a given width."""
    wrapped = F.regexp_replace(F.regexp_replace(seq_col, f"(.{{{width}}})", "$1\n"), "\n$", "")
    df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def json_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def batched(df: DataFrame, path: str, batch: str) -> None:
    """A Parquet folder for each batch."""
    df.write.mode("overwrite").partitionBy(batch).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON after those that are there."""
    df.write.mode("append").json(path)


def sized_keys(df: DataFrame, path: str, key: str, size: str, n: str) -> None:
    """A dict literal of keys and sizes, by the number that a key begins with and then by the key, with the counts as remarks; one file, as it is read whole."""
    line = F.format_string("    '%s': %d,   # N=%d", F.col(key), F.col(size), F.col(n))
    rows = F.array_sort(F.collect_list(F.struct(F.split(key, "_")[0].try_cast("long").alias("z"), F.col(key).alias("k"), line.alias("line"))))
    text = F.concat(F.lit("CBDICT = {\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n}"))
    df.agg(text.alias("value")).write.mode("overwrite").text(path)


def split_manifest(files: DataFrame, path: str, name: str, split: str, seed: int, share: float) -> None:
    """One JSON document of a split of files: the seed, the share, counts and names."""
    names = lambda s: F.array_sort(F.collect_list(F.when(F.col(split) == s, F.col(name))))
    doc = files.agg(F.lit(seed).alias("seed"), F.lit(share).alias("valid_ratio"), F.count("*").alias("n_total"), names("train").alias("train"), names("valid").alias("valid"))
    doc.withColumn("n_train", F.size("train")).withColumn("n_valid", F.size("valid")).write.mode("overwrite").json(path)


def vocabulary(vocab: DataFrame, path: str, specials: tuple[str, ...] = ("pad", "mask", "cls", "unk")) -> None:
    """One JSON document of a vocabulary (token, id): ids by token, tokens by id, the special ids and the size."""
    pairs = F.array_sort(F.collect_list(F.struct("id", "token")))
    doc = vocab.agg(pairs.alias("p")).select(
        F.map_from_entries(F.transform("p", lambda x: F.struct(x["token"], x["id"]))).alias("stoi"), F.transform("p", lambda x: x["token"]).alias("tokens"), *[F.lit(k).alias(f"{s}_id") for k, s in enumerate(specials)], F.size("p").alias("vocab_size")
    )
    doc.write.mode("overwrite").json(path)


def epoch_means(df: DataFrame, path: str, epoch: str = "epoch", mean: str = "mean") -> None:
    """epoch,mean with six digits, in the order of epochs."""
    df.orderBy(epoch).coalesce(1).select(epoch, F.format_string("%.6f", F.col(mean)).alias(mean)).write.mode("overwrite").option("header", True).csv(path)


def unique_fasta(df: DataFrame, path: str, seq: str) -> None:
    """FASTA records of the distinct sequences in order, called seq_0, seq_1 and so on."""
    fasta(numbered(df.select(seq).where(F.col(seq) != "").distinct(), [seq], "_i").withColumn("_id", F.concat(F.lit("seq_"), F.col("_i"))), path, "_id", seq)


def guide_rows(df: DataFrame, path: str, guide: str, keep_dropped: bool = False) -> None:
    """A table with a header; rows whose guide is drop_overlap only if wanted."""
    (df if keep_dropped else df.where(F.col(guide) != "drop_overlap")).write.mode("overwrite").option("header", True).csv(path)
