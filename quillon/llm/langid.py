"""Language identification in two levels: first the family, then one-versus-one linear SVMs among the family's languages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, sampled, small_batches, table
from quillon.llm.linear import Grams, Sparse, svm

#: Families of ISO 639-1 codes. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
#: Labelled texts to learn from, over all languages; as many of each language as there are.
SAMPLE = 1600
UNKNOWN = "und"
#: Margins are this much steeper in a score.
STEEP = 4.0
#: The feature that all texts have.
CONSTANT = 0.1
#: Texts with a lower score are rejected where texts are filtered.
LEAST_SCORE = 0.05


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


class Model:
    """Weights of one family-versus-rest machine for each family and of one machine for each pair of languages in a family."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias
        self.families = sorted({family(x) for x in languages})
        self.pairs = pairs_of(languages)
        self.grams = Grams()

    def predict(self, text: bytes) -> tuple[str, float]:
        """The language and a score: sure of the family times sure of the language."""
        margins = self.grams.margins(text, self.weights) + self.bias
        first = margins[: len(self.families)]
        at = int(np.argmax(first))
        others = np.delete(first, at)
        score = 1.0 / (1.0 + np.exp(-STEEP * (first[at] - others.max()))) if len(others) else 1.0
        members = [x for x in self.languages if family(x) == self.families[at]]
        votes = dict.fromkeys(members, 0.0)
        sure = dict.fromkeys(members, 1.0)
        for (a, b), m in zip(self.pairs, margins[len(self.families) :], strict=True):
            if a in votes:
                p = 1.0 / (1.0 + np.exp(-STEEP * m))
                votes[a] += 1 + 1e-3 * p if m >= 0 else 1e-3 * p
                votes[b] += 1e-3 * (1 - p) if m >= 0 else 1 + 1e-3 * (1 - p)
                sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(members, key=lambda x: (votes[x], x))
        return best, float(score * sure[best])


def pairs_of(languages: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a, b in combinations(sorted(languages), 2) if family(a) == family(b)]


def features(df: DataFrame, text_col: str, label_col: str) -> tuple[np.ndarray, list[Sparse]]:
    """Labels and frequencies of n-grams for a bounded sample, found by the workers; the last feature is the same for all."""

    @F.pandas_udf("at binary, value binary")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for texts in batches:
            rows = []
            for text in texts:
                x = grams.vector(text)
                at = np.nonzero(x)[0]
                rows.append((at.astype(np.int32).tobytes(), x[at].tobytes()))
            yield pd.DataFrame(rows, columns=["at", "value"], dtype=object)

    rows = df.select(F.col(label_col).alias("label"), vectors(F.lower(text_col).cast("binary")).alias("x")).collect()
    last = Grams().size
    sparse = [(np.append(np.frombuffer(r["x"]["at"], np.int32), last), np.append(np.frombuffer(r["x"]["value"]), CONSTANT)) for r in rows]
    return np.array([r["label"] for r in rows]), sparse


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learns from at most `sample` of the rows that have a language and a letter, the same number of each language at most, chosen by a hash of the id and the text; equal
    rows are one. None if there are none."""
    lettered = F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    hashed = F.xxhash64(text_col)
    units = cut(df.where(lettered).select(F.col(id_col).alias("_id"), hashed.alias("_txt"), F.col(lang_col).alias("_lang")).distinct())
    languages = [r["_lang"] for r in units.groupBy("_lang").agg(F.count("*").alias("n")).orderBy("_lang").limit(sample).collect()]
    if not languages:
        return None
    chosen = cut(sampled(units, "_lang", ["_id", "_txt"], max(1, sample // len(languages)), sample))  # `sample` rows at most
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (hashed == F.col("_txt")) & (F.col(lang_col) == F.col("_lang"))
    found = df.where(lettered).join(F.broadcast(chosen), same).dropDuplicates(["_id", "_txt", "_lang"])
    rows = found.orderBy("_txt", "_id", "_lang")
    labels, x = features(rows.select(text_col, lang_col), text_col, lang_col)
    groups, size = np.array([family(x) for x in labels]), Grams().size + 1
    machines = [svm(x, np.where(groups == f, 1.0, -1.0), size) if len(set(groups)) > 1 else np.zeros(size) for f in sorted(set(groups))]
    for a, b in pairs_of(languages):
        among = np.nonzero((labels == a) | (labels == b))[0]
        machines.append(svm([x[i] for i in among], np.where(labels[among] == a, 1.0, -1.0), size))
    w = np.array(machines).T
    return Model(languages, np.ascontiguousarray(w[:-1], np.float32), CONSTANT * w[-1])


def identify(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """df and then lang_pred and score. A null text, and one without a letter, is "und" with score 0; with no model, every text is. Columns of df with these names are replaced."""
    df = df.drop("lang_pred", "score")
    if model is None:
        return df.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))  # its size is fixed by the languages and features

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame([(UNKNOWN, 0.0) if t is None else known.predict(t) for t in texts], columns=["lang", "score"])

    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col).cast("binary"))
    return df.withColumn("_found", predict(lettered)).select(*df.columns, F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    found = identify(docs, learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
