"""From documents to tokens: language identification, line dedup, near-dedup, mixing, encoding. Part of the corpus operators.

Every stage takes documents with nulls in any column, repeated rows, ids shared by different texts and other columns, which it drops; what becomes of them is told for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, langid, linededup, mixing, simhash
from quillon.llm.common import drop_stored, new_path, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; what has no letters or no likely language goes, null texts too. A missing language is filled in. Rows are judged by their texts alone, so repeated rows and ids stay."""
    learned = docs.where(F.coalesce(langid.fold("doc_id", 4) != 2, F.lit(False)))
    found = langid.identify(docs.select(*COLUMNS), langid.learn(learned))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows of lines; a document of which only blanks are left goes. Rows of one id and text keep the same, rows of one id with different texts are documents of their own."""
    found = linededup.dedup_lines(docs.select(*COLUMNS))
    return _documents(found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, null last, and then the smallest hash of the text."""
    return simhash.keep_one(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and pass, so that an id may come twice from here on. A null source is a source."""
    return _documents(mixing.mix(docs.select(*COLUMNS)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each text, and what they decode to in digest; a row for each row."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("mixing", mixture), ("byte_bpe", tokens)]

#: SQL can't express the SVMs, the fingerprints, the permutations nor the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over a table of the shared folder that the one before has written; a table goes once the next is there."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if old is not None:
            drop_stored(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
