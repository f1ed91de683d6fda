"""Quality rules: statistics of texts, and a decision list that is learned from labelled ones. All of it runs in Spark's own expressions.

Sequential covering: a rule is a conjunction of thresholds. It grows on two thirds of the labelled texts by the condition with the most
information gain (Quinlan's FOIL), and loses its last conditions again while that makes it more exact on the other third. What it covers is put aside
and the next rule is learned, until none is exact enough. Each step is one aggregation: the labelled rows are counted by feature and
bin of candidate thresholds, so what comes to the driver is as long as the list of thresholds, whatever the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, cut, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Fewer words than this, or more repeated ones (percent), fail the base.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Candidate thresholds of a feature, conditions of a rule, rules of a list, the part of the pruning texts that a rule may cover wrongly, and the least it must cover rightly.
BINS, CONDITIONS, RULES, WRONG, LEAST_RIGHT = 31, 3, 8, 0.1, 2
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "exclaim_share")


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals and n_exclaims of the whole text; all are 0 for a null or empty one.

    Windows of three words are told apart by 64-bit hashes within a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    rows = df.select(F.col(id_col), text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    trios = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_trios", trios)
    pairs = F.sort_array(F.arrays_zip(F.col("_trios").alias("h"), F.sequence(F.lit(0), F.size("_trios") - 1).alias("i")))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_trios")) < F.size("_trios"), pairs))
    twice = F.transform(F.filter(F.col("_sorted"), lambda x, k: same(x, F.get("_sorted", k - 1)) | same(x, F.get("_sorted", k + 1))), lambda x: x["i"])
    rows = rows.withColumn("_twice", twice)
    covered = F.array_union(F.array_union("_twice", F.transform("_twice", lambda i: i + 1)), F.transform("_twice", lambda i: i + 2))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    return rows.select(
        F.col(id_col),
        n.cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        count(r"\p{Lu}").alias("n_capitals"),
        count("!").alias("n_exclaims"),
    )


def features(stats: DataFrame) -> DataFrame:
    """stats and the features that rules are made of."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return stats.select(
        "*",
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_words").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_exclaims", "n_words").alias("exclaim_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # the feature is at least the threshold; else it is below
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column()
    return found


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good))) if bad else 0.0


def _thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """The middles between neighbours among the quantiles, ends included, of each feature over the bad and over the good texts."""
    steps = F.array(*[F.lit(k / BINS) for k in range(BINS + 1)])
    asked = [F.percentile_approx(F.when(F.col("bad") == bad, F.col(f)), steps, 10_000).alias(f"{bad}:{f}") for f in FEATURES for bad in (True, False)]
    found = labelled.agg(*asked).first()
    values = {f: sorted({x for bad in (True, False) for x in found[f"{bad}:{f}"] or [] if x is not None}) for f in FEATURES}
    return {f: [(a + b) / 2 for a, b in zip(x, x[1:])] for f, x in values.items()}


def _bin(value: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= value))


def _grown(rows: DataFrame, thresholds: dict[str, list[float]]) -> Rule:
    """The rule that rows (those to grow on) give with these thresholds."""
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        inside = rows.where(covers(rule))
        bins = [F.struct(F.lit(f).alias("feature"), _bin(F.col(f), ts).alias("bin")) for f, ts in thresholds.items() if ts]
        if not bins:
            break
        counted = inside.select("bad", F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin").agg(F.count(F.when(F.col("bad"), 1)).alias("bad"), F.count(F.when(~F.col("bad"), 1)).alias("good")).collect()
        best, choice = 0.0, None
        for f, ts in thresholds.items():
            of = {r["bin"]: (r["bad"], r["good"]) for r in counted if r["feature"] == f}
            all_bad, all_good = sum(b for b, _ in of.values()), sum(g for _, g in of.values())
            if not all_bad:
                continue
            below = [0, 0]
            for k, t in enumerate(ts):  # bin k + 1 and those beyond are at least t
                below = [below[0] + of.get(k, (0, 0))[0], below[1] + of.get(k, (0, 0))[1]]
                for above, bad, good in ((True, all_bad - below[0], all_good - below[1]), (False, *below)):
                    if (gain := _gain(bad, good, all_bad, all_good)) > best + 1e-9:
                        best, choice = gain, Condition(f, above, t)
        if choice is None:
            break
        rule += (choice,)
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that is most exact on rows (those to prune on), and what it covers there, bad and good."""
    if not rule:
        return rule, 0, 0
    asked = []
    for k in range(1, len(rule) + 1):
        asked += [F.count(F.when(covers(rule[:k]) & (F.col("bad") == says), 1)).alias(f"{k}:{says}") for says in (True, False)]
    found = rows.agg(*asked).first()
    of = [(found[f"{k}:True"], found[f"{k}:False"], k) for k in range(1, len(rule) + 1)]
    bad, good, k = max(of, key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), x[0], -x[2]))
    return rule[:k], bad, good


def learn(labelled: DataFrame) -> list[Rule]:
    """The decision list: texts that a rule covers are bad. labelled has the features, bad (boolean) and id; rows with null bad are left out.

    A rule is kept if on the texts to prune on it covers LEAST_RIGHT bad ones or more and is wrong on few. If not, the next is tried without the feature that it began
    with, until no feature is left; a kept rule makes all features free again. Few labels, of which a rule may fail by chance, so don't end the list.
    """
    rows = cut(labelled.where("bad IS NOT NULL").select("bad", *FEATURES, (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("prune")))
    thresholds, rules, left = _thresholds(rows), [], rows
    free = set(FEATURES)
    while len(rules) < RULES and free:
        rule = _grown(left.where("NOT prune"), {f: t for f, t in thresholds.items() if f in free})
        if not rule:
            break
        first = rule[0].feature
        rule, bad, good = _pruned(left.where("prune"), rule)
        if bad < LEAST_RIGHT or good > WRONG * (bad + good):
            free.discard(first)
            continue
        rules.append(rule)
        left, free = left.where(~covers(rule)), set(FEATURES)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """An ordered conditional: the number of the first rule that covers a text, from 1; 0 if none does."""
    found = F.lit(0)
    for k in range(len(rules), 0, -1):
        found = F.when(covers(rules[k - 1]), k).otherwise(found)
    return found


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """Per row of df: the id, its statistics and features, base_failed, rule (0 if none) and kept.

    labels has id_col and quality_col: 0 is bad, 1 is good, null is left out; an id may have several labels, each counts. The list is learned from labelled texts that the
    base lets pass, as only these come to it. Without labels no rule is learned.
    """
    stats = cut(features(statistics(df, id_col, text_col)))
    said = labels.select(F.col(id_col).alias("_id"), (F.col(quality_col) == 0).alias("bad"))
    labelled = stats.where(~base_failed()).join(said, F.col(id_col) == F.col("_id")).withColumn("id", F.col("_id"))
    judged_by = stats.withColumn("rule", verdict(learn(labelled))).withColumn("base_failed", base_failed())
    return judged_by.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
