"""Toxicity by a factorization machine over hashed terms (Rendle, 2010).

A text's terms are its distinct words and their beginnings, hashed. Besides a weight, each term has a short vector, and the product of two terms' vectors counts for
their pair, so that a word that is harmless alone can tell with another. The machine is fitted to a bounded sample of the
labelled texts by AdaGrad on the logistic loss; all texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, sampled, small_batches, table

#: Hashed terms, and the length of their vectors.
BUCKETS, FACTORS = 1 << 20, 4
#: Besides whole words, so many of their first letters are terms.
BEGINNINGS = (5, 7)
#: Labelled texts to learn from, at most so many of each label; the bias makes up for their shares.
SAMPLE = 6000
#: A term counts if so many sampled texts have it and if its tie to the label is this strong (chi-squared), or if with any other it makes a pair that
#: is tied so much more strongly than either.
LEAST_TEXTS, LEAST_TIE, PAIR_TIE = 3, 8.0, 100.0
ROUNDS, STEP, SHRINK, BATCH = 20, 0.2, 1e-3, 64
#: Terms on each side of a table of pairs.
BLOCK = 1024

#: The bias; for each hashed term its place among those that count, from 1, or 0; by place, weights and vectors.
Model = tuple[float, np.ndarray, np.ndarray, np.ndarray]


def terms(text: Column) -> Column:
    """The distinct hashed words (runs of letters) of a whole text and their beginnings; null and empty texts have none."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), ""))
    begun = [_beginnings(words, k) for k in BEGINNINGS]
    hashes = F.concat(F.transform(words, lambda w: F.xxhash64(w)), *begun)
    return F.array_distinct(F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")))


def _beginnings(words: Column, k: int) -> Column:
    """Hashes of the first k letters of the words that have so many."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.xxhash64(F.lit(k), F.substring(w, 1, k)))


def raw_score(model: Model, ids: np.ndarray) -> float:
    """The bias, the weights and the products of all pairs of vectors, these by half of (the square of the sum - the sum of the squares)."""
    bias, place, weights, vectors = model
    at = place[ids]
    v = vectors[at]
    total = v.sum(axis=0)
    return bias + float(weights[at].sum()) + 0.5 * float(total @ total - (v * v).sum())


def _tie(has: np.ndarray, has1: np.ndarray, n: int, n1: float) -> np.ndarray:
    """Chi-squared of a feature, in `has` of n texts and `has1` of the n1 with label 1."""
    has = has.astype(float)
    return n * (n * has1 - has * n1) ** 2 / np.maximum(1.0, has * (n - has) * n1 * (n - n1))


def _may_pair(has: np.ndarray, has1: np.ndarray, n: int, n1: float) -> np.ndarray:
    """Which terms can be in a pair that passes PAIR_TIE: at best it is in all texts of one label that have the term, and in no other."""
    best = np.maximum(_tie(has1, has1, n, n1), _tie(has - has1, np.zeros_like(has1), n, n1))
    return (has >= LEAST_TEXTS) & (best - _tie(has, has1, n, n1) >= PAIR_TIE)


def _alone(has: np.ndarray, has1: np.ndarray, n: int, n1: float) -> np.ndarray:
    return (has >= LEAST_TEXTS) & (_tie(has, has1, n, n1) >= LEAST_TIE)


def candidates(has: np.ndarray, has1: np.ndarray, n: int, n1: float) -> np.ndarray:
    """Which terms may count, alone or in a pair, by the numbers of texts that have them."""
    return _alone(has, has1, n, n1) | _may_pair(has, has1, n, n1)


def _paired(rows: list[np.ndarray], y: np.ndarray, has: np.ndarray, has1: np.ndarray) -> np.ndarray:
    """The terms that tell in pairs what they don't tell alone; every pair that can is counted, a block of terms with a block."""
    n, n1 = len(y), float(y.sum())
    tie = _tie(has, has1, n, n1)
    known = np.nonzero(_may_pair(has, has1, n, n1))[0]
    place = np.full(len(has), -1)
    place[known] = np.arange(len(known))
    at, of = place[np.concatenate(rows)], np.repeat(np.arange(n), [len(r) for r in rows])
    at, of = at[at >= 0], of[at >= 0]
    found = np.zeros(len(known), bool)

    def there(block: int) -> np.ndarray:
        own, x = at // BLOCK == block, np.zeros((n, BLOCK), np.float32)
        x[of[own], at[own] % BLOCK] = 1
        return x

    blocks = -(-len(known) // BLOCK)
    for i in range(blocks):
        a = there(i)
        for j in range(i, blocks):
            b = a if i == j else there(j)
            both = _tie(a.T @ b, a[y == 1].T @ b[y == 1], n, n1)
            of_a, of_b = known[i * BLOCK : (i + 1) * BLOCK], known[j * BLOCK : (j + 1) * BLOCK]
            extra = both[: len(of_a), : len(of_b)] - np.maximum(tie[of_a][:, None], tie[of_b][None, :]) >= PAIR_TIE
            if i == j:
                np.fill_diagonal(extra, False)
            found[i * BLOCK : (i + 1) * BLOCK] |= extra.any(axis=1)
            found[j * BLOCK : (j + 1) * BLOCK] |= extra.any(axis=0)
    return known[found]


def fit(rows: list[np.ndarray], y: np.ndarray, positives: float, seed: int = 0) -> Model:
    """rows: hashed terms of each text, at least all that may count; y: 0 or 1; positives: the share of label 1 among all labelled texts."""
    rng = np.random.default_rng(seed)
    place = np.zeros(BUCKETS, np.int32)
    n1, n = float(y.sum()), len(y)
    if not 0 < n1 < n:
        share = min(1 - 1e-3, max(1e-3, n1 / n if n else 0.0))
        return float(np.log(share / (1 - share))), place, np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32)
    flat = np.concatenate(rows)
    has = np.bincount(flat, minlength=BUCKETS)
    has1 = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), minlength=BUCKETS)
    chosen = _alone(has, has1, n, n1)
    chosen[_paired(rows, y, has, has1)] = True
    place[chosen] = 1 + np.arange(int(chosen.sum()))
    picked = [place[r[chosen[r]]] for r in rows]
    size = 1 + int(chosen.sum())
    weights, vectors = np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)
    vectors[0] = 0
    bias = float(np.log(n1 / (n - n1)))
    sum_w, sum_v, sum_b = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(ROUNDS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            part = order[at : at + BATCH]
            sizes = np.array([len(picked[i]) for i in part])
            ids = np.concatenate([picked[i] for i in part])
            of = np.repeat(np.arange(len(part)), sizes)
            v = vectors[ids]
            totals = np.zeros((len(part), FACTORS), np.float32)
            np.add.at(totals, of, v)
            raw = bias + np.bincount(of, weights[ids], len(part)) + 0.5 * ((totals**2).sum(axis=1) - np.bincount(of, (v * v).sum(axis=1), len(part)))
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]
            known, inverse = np.unique(ids, return_inverse=True)
            g_w = np.bincount(inverse, slope[of], len(known)) + SHRINK * weights[known]
            g_v = np.zeros((len(known), FACTORS), np.float32)
            np.add.at(g_v, inverse, (slope[of, None] * (totals[of] - v)).astype(np.float32))
            g_v += SHRINK * vectors[known]
            g_b = float(slope.sum())
            sum_w[known] += g_w**2
            sum_v[known] += g_v**2
            sum_b += g_b**2
            weights[known] -= STEP * g_w / np.sqrt(sum_w[known])
            vectors[known] -= 0.25 * STEP * g_v / np.sqrt(sum_v[known])
            bias -= STEP * g_b / np.sqrt(sum_b)
    shift = np.log(positives / (1 - positives)) - np.log(n1 / (n - n1))
    return bias + float(shift), place, weights, vectors


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits to at most `sample` texts of each label, chosen by a hash of the id and the text. labels has id_col and label_col (0 or 1; others are left out; of several
    labels of an id the largest counts). Equal texts of one id are one. What comes to the driver is a count for each hashed term, and of the sampled texts the
    terms that may count by that."""
    said = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    hashed = F.xxhash64(text_col)
    units = cut(df.select(F.col(id_col).alias("_id"), hashed.alias("_txt")).join(said, "_id").distinct())
    counts = {r["_y"]: r["n"] for r in units.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = cut(sampled(units, "_y", ["_id", "_txt"], sample))  # twice `sample` rows at most
    rows = df.select(F.col(id_col).alias("_id"), hashed.alias("_txt"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), ["_id", "_txt"])
    rows = cut(rows.select("_id", "_txt", "_y", terms(F.col("_text")).alias("_terms")).dropDuplicates(["_id", "_txt"]))
    per_term = rows.select("_y", F.explode("_terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("_y").alias("n1")).toPandas()  # BUCKETS rows at most
    n, n1 = chosen.count(), float(chosen.agg(F.sum("_y")).first()[0] or 0)
    has, has1 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    has[per_term["t"]], has1[per_term["t"]] = per_term["n"], per_term["n1"]
    may = candidates(has, has1, n, n1) if 0 < n1 < n else np.zeros(BUCKETS, bool)
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(may))  # a bit for each hashed term

    @F.pandas_udf("binary")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mask = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield pd.Series([(ids := np.asarray(t, np.int32))[mask[ids]].tobytes() for t in batch], dtype=object)

    found = rows.select("_id", "_txt", "_y", kept("_terms").alias("_terms")).collect()
    found.sort(key=lambda r: (r["_txt"], str(r["_id"])))
    total = sum(counts.values())
    share = min(1 - 1e-3, max(1e-3, counts.get(1, 0) / total)) if total else 1e-3
    return fit([np.frombuffer(r["_terms"], np.int32) for r in found], np.array([r["_y"] for r in found], np.float64), share)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df and then score: the probability of label 1 for each row. A text without words gets what the bias says; equal texts get equal scores."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and FACTORS

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            raw = np.array([raw_score(shared.value, np.asarray(ids, np.int64)) for ids in batch])
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -500, 500))))

    return df.withColumn("score", scored(terms(F.col(text_col))))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = learn(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    found = score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
