"""SimHash fingerprints and their near-duplicates, by anchors of a covering code.

The 64 bits of a fingerprint are cut into stretches of 23, 23, 15 and 3 bits. Each has a perfect code: Golay's binary code
(covering radius 3), the same again, the Hamming code (radius 1) and the threefold repetition (radius 1). Their product
covers all fingerprints with radius 8, and the nearest anchor of a fingerprint comes from four syndrome tables.

Two fingerprints that differ in at most two bits have a midpoint within one bit of both, and the midpoint has its anchor
within the covering radius. So by the triangle inequality it is enough that each fingerprint goes to every anchor within
the covering radius plus half the threshold whose cell it can reach by one flip, about 18 of them; going to all those within
the radius plus the whole threshold finds the same pairs many times over. Anchors that get one fingerprint only are done.
At the others, fingerprints are compared through the midpoints in the anchor's cell: at most 65 fingerprints lie within one bit
of a midpoint and all of these are within two bits of each other, so each is linked to the least of them. This takes a time
in proportion to the fingerprints however many meet at an anchor; no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, join_hot, small_batches, table
from quillon.operators.graph import components

SHINGLE = 3

#: Generator of Golay's code, x^11+x^10+x^6+x^5+x^4+x^2+1, and of the Hamming code, x^4+x+1.
GOLAY, HAMMING = 0b110001110101, 0b10011
#: Fixed values of each stretch: its length, its check bits, its code's generator polynomial, its covering radius.
STRETCHES = ((23, 11, GOLAY, 3), (23, 11, GOLAY, 3), (15, 4, HAMMING, 1), (3, 2, 0b111, 1))


def _remainder(word: int, check: int, generator: int) -> int:
    for i in range(word.bit_length() - 1, check - 1, -1):
        if word >> i & 1:
            word ^= generator << (i - check)
    return word


def _stretch(length: int, check: int, generator: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each single bit, and the errors that each syndrome stands for."""
    of_bit = np.array([_remainder(1 << i, check, generator) for i in range(length)], np.int64)
    errors = np.zeros(1 << check, np.uint64)
    for weight in range(1, radius + 1):
        for bits in combinations(range(length), weight):
            errors[int(np.bitwise_xor.reduce(of_bit[list(bits)]))] = sum(1 << i for i in bits)
    return of_bit, errors


_tables: list = []


def _codes() -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first bit, length, syndromes of bits, errors of syndromes) for each stretch."""
    if not _tables:
        at = 0
        for length, check, generator, radius in STRETCHES:
            _tables.append((at, length, *_stretch(length, check, generator, radius)))
            at += length
    return _tables


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned 64-bit prints: the anchor of each, and those of its 64 neighbours at one bit, as a matrix."""
    own, errors_of = np.zeros(len(prints), np.uint64), []
    for at, length, of_bit, errors in _codes():
        bits = (prints[:, None] >> np.arange(at, at + length, dtype=np.uint64)) & np.uint64(1)
        syndrome = np.bitwise_xor.reduce(np.where(bits > 0, of_bit, 0), axis=1)
        found = errors[syndrome] << np.uint64(at)
        own |= found
        errors_of.append((found, errors[syndrome[:, None] ^ of_bit] << np.uint64(at)))
    near = [own[:, None] ^ found[:, None] ^ moved for found, moved in errors_of]  # the errors of each neighbour
    flips = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return prints ^ own, prints[:, None] ^ flips ^ np.concatenate(near, axis=1)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits over the hashes of all shingles; zero without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    of_byte = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(of_byte.ravel(), minlength=2048).reshape(8, 256) @ _bits()
    return int(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").view(np.uint64)[0])


def _bits() -> np.ndarray:
    """The bits of each byte, lowest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every whole text. Null and empty texts have zero."""
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) if t else 0 for t in texts], np.uint64).view(np.int64))

    return df.select(id_col, simhash(F.col(text_col).cast("binary")).alias("fp"))


def linked(prints: DataFrame) -> DataFrame:
    """Edges (fp, to) among distinct fingerprints, a connected chain of them for all that lie within two bits of each other."""

    @F.pandas_udf("array<long>")
    def reached(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for fp in batches:
            own, near = anchors(fp.to_numpy().view(np.uint64))
            yield pd.Series([np.unique(row).view(np.int64) for row in np.column_stack([own, near])], dtype=object)

    @F.pandas_udf("array<long>")
    def midpoints(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        flips = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for fp, anchor in batches:
            prints, wanted = fp.to_numpy().view(np.uint64), anchor.to_numpy().view(np.uint64)
            own, near = anchors(prints)
            around = np.column_stack([prints, prints[:, None] ^ flips])
            there = np.column_stack([own, near]) == wanted[:, None]
            yield pd.Series([a[t].view(np.int64) for a, t in zip(around, there, strict=True)], dtype=object)

    at = cut(prints.select("fp", F.explode(reached("fp")).alias("anchor")))
    shared = at.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    met = at.join(shared, "anchor", "left_semi").select("fp", F.explode(midpoints("fp", "anchor")).alias("midpoint"))
    star = met.groupBy("midpoint").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # 65 at most
    return star.select(F.explode("fps").alias("fp"), F.array_min("fps").alias("to")).where("fp <> to")


def _grouped(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, _txt, fp) of every row, and for each fingerprint its component and the first of its rows: by id, null last, and then by the text's hash."""
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    prints = cut(fingerprints(texts.select(F.struct("_id", F.xxhash64("_text").alias("_txt")).alias("_row"), "_text"), "_row", "_text").select("_row._id", "_row._txt", "fp"))
    first = F.min(F.struct(F.isnull("_id").alias("nameless"), F.col("_id").alias("id"), F.col("_txt").alias("txt"))).alias("first")
    least = cut(prints.groupBy("fp").agg(first, F.count("*").alias("n")))
    groups = components(linked(least), "fp", "to")
    named = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return prints, cut(named)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): texts are linked if their fingerprints differ in two bits or fewer; component_id is the smallest id reachable.

    Every row gives a row. Texts without words (null, empty, white space) have the fingerprint zero and are linked with each
    other. Rows with a null id get a component like others but give it no name; if all ids of a component are null, so is its name.
    """
    prints, named = _grouped(df, id_col, text_col)
    names = named.groupBy("component").agg(F.min("first.id").alias("component_id"))
    of_print = cut(named.join(names, "component").select("fp", "n", "component_id"))
    return join_hot(prints, of_print, ["fp"], "n").select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each component one row, that with the smallest id; null ids come last, and rows of one id go by their texts' hashes."""
    prints, named = _grouped(df, id_col, text_col)
    chosen = cut(named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_kept"), F.col("first.txt").alias("_of")))
    same = F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_txt") == F.col("_of"))
    often = prints.join(chosen, same, "left_semi").groupBy("_id", "_txt").count().where("count > 1").select(F.col("_id").alias("_many"), F.col("_txt").alias("_of_many"))
    here = lambda i, t: df[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(df[text_col]) == F.col(t))
    kept = df.join(chosen, here("_kept", "_of"), "left_semi")
    often = cut(often)
    if often.isEmpty():
        return kept
    repeated = df.join(often, here("_many", "_of_many"), "left_semi").withColumn("_txt", F.xxhash64(text_col)).dropDuplicates([id_col, "_txt"]).drop("_txt")
    return df.join(chosen, here("_kept", "_of"), "left_semi").join(often, here("_many", "_of_many"), "left_anti").union(repeated)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
