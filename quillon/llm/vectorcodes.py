"""Product codes of vectors: each part of a vector becomes the number of the nearest entry of that part's codebook, learned in integers.

Components are floored to multiples of 1 / SCALE, so that all sums are of integers and no result hangs on an order. Vectors are packed once into columnar blocks: for
each dimension of a part, the numbers of all its vectors side by side. A round is one treeAggregate over the RDD of blocks: distances to all entries are added up
dimension by dimension, np.add.at puts each part into int64 tensors of sums and counts, and the tensors, whose size does not grow with the rows, merge through a tree,
so that the driver adds only a few of them. The blocks are a table in the shared folder: a lost executor reads its blocks again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors of a block: BLOCK x ENTRIES distances are in memory at a time.
BLOCK = 2048
#: Floored components are held to this, so that squared distances of 4096 dimensions stay below 2^63.
LARGEST = 1 << 24

BLOCKS = "n int, data binary"


def _sound(v: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def floored(v: Column, scale: int = SCALE) -> Column:
    """The components as integers floor(scale * x), held to LARGEST."""
    return F.transform(v, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), x.cast("double"))) * scale))).cast("int"))


def bounds(width: int, parts: int) -> list[int]:
    """Where the parts begin and end; the first ones are one longer where the width can't be dealt evenly."""
    return np.cumsum([0, *[width // parts + (k < width % parts) for k in range(parts)]]).tolist()


def _pack(batches):
    """Blocks of rows, a component after the other."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            lists = batch.column(0).slice(at, BLOCK)
            x = lists.flatten().to_numpy().reshape(len(lists), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([len(lists)], pa.int32()), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], names=["n", "data"])


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each column of a (dimension, vector) block, the first of equals, and its squared distance."""
    far = np.zeros((block.shape[1], len(book)), np.int64)
    for d in range(len(block)):
        apart = block[d][:, None] - book[None, :, d]
        far += apart * apart
    best = far.argmin(axis=1)
    return best, far[np.arange(len(best)), best]


def _round(books: list[np.ndarray], width: int) -> tuple[Callable, Callable]:
    """The step over blocks and the merger of two results, lists of (sums, counts) for each part."""
    cuts = bounds(width, len(books))

    def step(total, row):
        block = np.frombuffer(row["data"], np.int32).reshape(width, row["n"]).astype(np.int64)
        total = total or [(np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)) for book in books]
        for (sums, counts), book, a, b in zip(total, books, cuts[:-1], cuts[1:], strict=True):
            best, _ = nearest(block[a:b], book)
            np.add.at(sums, best, block[a:b].T)
            np.add.at(counts, best, 1)
        return total

    def merge(one, other):
        if not one or not other:
            return one or other
        for (sums, counts), (more, n) in zip(one, other, strict=True):
            sums += more
            counts += n
        return one

    return step, merge


def learn(vectors: DataFrame, vec_col: str, first: list[list[int]], parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of the parts after some rounds; vectors holds integers (`floored`) of one length, first the vectors that the entries start as."""
    start = np.array(first, np.int64).reshape(len(first), len(first[0]) if first else 0)
    cuts = bounds(start.shape[1], parts)
    books = [start[:, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if not len(start):
        return books
    blocks = stored(vectors.select(vec_col).mapInArrow(_pack, BLOCKS)).rdd
    for _ in range(rounds):
        step, merge = _round(books, start.shape[1])
        for book, (sums, counts) in zip(books, blocks.treeAggregate(None, step, merge, 3) or [], strict=True):
            used = counts > 0
            book[used] = sums[used] // counts[used, None]
    return books


def sha256_of(books: list[np.ndarray]) -> str:
    """Of all components as decimal integers with commas between, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def encode(df: DataFrame, vec_col: str, books: list[np.ndarray]) -> DataFrame:
    """df without vec_col (integers), and then code (a hexadecimal number of two digits or more for each part) and error (the sum of the parts' squared distances)."""
    old = [c for c in df.columns if c not in (vec_col, "code", "error")]
    width = sum(book.shape[1] for book in books)
    cuts, digits = bounds(width, len(books)), max(2, len(f"{max(0, len(books[0]) - 1):x}"))

    def coded(batches):
        for batch in batches:
            lists, codes, errors = batch.column(len(old)), [], []
            for at in range(0, batch.num_rows, BLOCK):
                some = lists.slice(at, BLOCK)
                block = np.ascontiguousarray(some.flatten().to_numpy().reshape(len(some), width).T).astype(np.int64)
                found = [nearest(block[a:b], book) for a, b, book in zip(cuts[:-1], cuts[1:], books, strict=True)]
                codes += ["".join(f"{k:0{digits}x}" for k in row) for row in zip(*[best.tolist() for best, _ in found], strict=True)]
                errors += sum(far for _, far in found).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(old)], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*old, "code", "error"])

    return df.select(*old, vec_col).mapInArrow(coded, df.select(*old).schema.add("code", "string").add("error", "long"))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows and columns of df without vec_col, then code and error, and the codebooks.

    Rows whose vector is null, empty or holds null or non-finite numbers go, and those whose length isn't that of the vector of the smallest id that is left. The codebooks start as the
    vectors of the `entries` smallest ids (null ids last, equal ids by their vectors; repeated rows count each), all of them where there are fewer; an entry that equals an
    earlier one is never the nearest. A null id is coded like any other; columns called code or error give way. Components are held to LARGEST / scale. Without rows
    there are no codes and empty codebooks.
    """
    v = F.col(vec_col)
    ints = df.where(_sound(v) & (F.size(v) > 0)).withColumn(vec_col, floored(v, scale))
    first = ints.orderBy(F.col(id_col).asc_nulls_last(), vec_col).select(vec_col).limit(entries + 1).collect()  # a top-k, bounded
    width = len(first[0][0]) if first else 0
    ints = ints.where(F.size(vec_col) == width)
    if any(len(r[0]) != width for r in first):
        first = ints.orderBy(F.col(id_col).asc_nulls_last(), vec_col).select(vec_col).limit(entries).collect()
    books = learn(ints, vec_col, [r[0] for r in first[:entries]], parts, rounds)
    return encode(ints, vec_col, books), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error"))  # a row for each label
    found = coded.join(errors, coded["label"].eqNullSafe(errors["label"])).drop(errors["label"])
    return found.select("vec_id", "code", "error", "label_error", F.lit(sha256_of(books)).alias("codebooks_sha256"))


#: A round of the codebooks in SQL: every part to its nearest entry, then the floored means.
_ROUND = """
near{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(j, d * 1000 + j) AS j, min(d) AS d FROM (
  SELECT vec_id, parts.p, j, CAST(list_inner_product(parts.x, parts.x) - 2 * list_inner_product(parts.x, book{k}.x) + list_inner_product(book{k}.x, book{k}.x) AS BIGINT) AS d FROM parts JOIN book{k} ON parts.p = book{k}.p) GROUP BY vec_id, p)"""
_NEXT = """,
mean{k} AS (SELECT p, j, list(m ORDER BY i) AS x FROM (
  SELECT near{k}.p, j, i, floor(sum(x[i]) / count(*)) AS m FROM near{k} JOIN parts USING (vec_id, p), range(1, 17) r(i) GROUP BY ALL) GROUP BY p, j),
book{n} AS MATERIALIZED (SELECT p, j, coalesce(mean{k}.x, book{k}.x) AS x FROM book{k} LEFT JOIN mean{k} USING (p, j)),"""

QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {
    "op12_vector_codes": """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[1 + 16 * p : 16 * p + 16] AS x FROM kept, range(4) r(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x FROM parts QUALIFY j < 256),"""
    + "".join(_ROUND.format(k=k) + _NEXT.format(k=k, n=k + 1) for k in range(ROUNDS))
    + _ROUND.format(k=ROUNDS)
    + """,
coded AS (SELECT vec_id, string_agg(format('{:02x}', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(m AS BIGINT) AS VARCHAR), ',' ORDER BY p, j, i)) FROM (SELECT p, j, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM book4)) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
""",
}
