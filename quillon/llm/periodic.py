"""Runs of repeated words within texts, by Crochemore's partition refinement.

Places of a text are in classes of equal factors (stretches of words) of one length. From one length to the next a class is split by where the classes of the places
one further on have been split; of the pieces of a class all but the largest split others in the next step, so that each place takes part a logarithmic number of
times (the smaller-half strategy). Members of a class are linked in order. Two neighbours whose distance is the length at hand are a square of that
period, primitive as no member lies between; the squares of one period at places in a row are merged into a maximal run.

A link is made at one length and holds until one of its ends is moved, so whether it is a square (made no later than its distance, and still there) is seen when it ends. Texts are refined
together, a task's batch at once, each step being a few operations on arrays of the places that move; no place ever meets another text's.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quillon.llm.common import WORD, small_batches, table

#: A run has at least so many words and so many times its period.
LEAST = 24
TIMES = 3

RUN = StructType().add("start", "long").add("length", "long").add("period", "long")


def squares(words: np.ndarray, sizes: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the primitive squares of texts whose words are numbered: the words of all texts after each other, and for each text its size and the longest period wanted.

    Classes are stretches of one permutation of all places, each named by where it begins there, so that what leaves a class goes to its end.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts, longest = np.repeat(np.cumsum(sizes) - sizes, sizes), most[text]
    key = text * (int(words.max()) + 1) + words
    perm = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[perm]) != 0])
    label, loc = np.empty(n, np.int64), np.empty(n, np.int64)
    label[perm], loc[perm] = np.maximum.accumulate(np.where(new, np.arange(n), 0)), np.arange(n)
    size = np.zeros(n, np.int64)
    size[np.nonzero(new)[0]] = np.diff(np.append(np.nonzero(new)[0], n))
    after, ahead, since, moving = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64), np.zeros(n, bool)  # since: the length at which the link to the next was made
    after[perm[:-1][~new[1:]]], ahead[perm[1:][~new[1:]]] = perm[1:][~new[1:]], perm[:-1][~new[1:]]
    places, periods = [], []

    def ended(at: np.ndarray, length: int) -> None:
        """Notes the squares among the links from `at`, which were there up to the length before."""
        at = at[after[at] >= 0]
        gap = after[at] - at
        square = (since[at] <= gap) & (gap < length) & (gap <= longest[at])
        places.append(at[square]), periods.append(gap[square])

    splits, length = np.arange(n), 1  # members of the small classes; at first of all
    move, by = (np.cumsum(sizes) - 1)[sizes > 0], np.full(int((sizes > 0).sum()), -1)  # what stands before a text's end, which is like no word
    while True:
        length += 1
        inner = splits[splits > starts[splits]]
        move, by = np.concatenate([move, inner - 1]), np.concatenate([by, label[inner]])
        wanted = (size[label[move]] > 1) & (longest[move] >= length)
        move, by = move[wanted], by[wanted]
        old = label[move]
        order = np.lexsort((move, by, old))
        move, by, old = move[order], by[order], old[order]
        begin = np.nonzero(np.concatenate([[True], (np.diff(old) != 0) | (np.diff(by) != 0)]))[0] if len(move) else move
        of, count = old[begin], np.diff(np.append(begin, len(move)))
        split = count < size[of]  # else all of a class goes the same way
        move, of, count = move[np.repeat(split, count)], of[split], count[split]
        if not len(move):
            break
        begin, piece = np.cumsum(count) - count, np.repeat(np.arange(len(of)), count)
        heads = np.nonzero(np.concatenate([[True], np.diff(of) != 0]))[0]  # the first piece of each class that is split
        at_class, kept_as = np.cumsum(np.concatenate([[0], (np.diff(of) != 0).astype(np.int64)])), of[heads]
        rest = size[kept_as] - np.add.reduceat(count, heads)
        # links: what moves leaves its list, in chains of neighbours
        chain = move[np.lexsort((move, of[piece]))]
        joined = after[chain[:-1]] == chain[1:]
        p, x = ahead[chain[np.concatenate([[True], ~joined])]], after[chain[np.concatenate([~joined, [True]])]]
        ended(chain, length)
        ended(p[p >= 0], length)
        after[p[p >= 0]], since[p[p >= 0]] = x[p >= 0], length
        ahead[x[x >= 0]] = p[x >= 0]
        after[move], ahead[move], since[move] = -1, -1, length
        joined = piece[1:] == piece[:-1]
        after[move[:-1][joined]], ahead[move[1:][joined]] = move[1:][joined], move[:-1][joined]
        # the permutation: pieces take the end of the class, what stood there and stays takes their places
        tail = kept_as + rest
        fresh = tail[at_class] + begin - begin[heads][at_class]
        target = np.repeat(fresh - begin, count) + np.arange(len(move))
        moving[move] = True
        there = perm[target]
        stay, holes = there[~moving[there]], loc[move][loc[move] < tail[at_class][piece]]
        perm[holes], loc[stay] = stay, holes
        perm[target], loc[move] = move, target
        moving[move] = False
        size[kept_as] = rest
        size[fresh], label[move] = count, np.repeat(fresh, count)
        # small classes: all pieces and the rest, but for the largest of them
        biggest = np.maximum.reduceat(count, heads)
        largest = np.nonzero(count == biggest[at_class])[0]
        largest = largest[np.concatenate([[True], np.diff(at_class[largest]) != 0])]
        small, less = np.ones(len(of), bool), rest < biggest
        small[largest[less]] = False
        n_rest = np.where(less, rest, 0)
        splits = np.concatenate([move[small[piece]], perm[np.repeat(kept_as - (np.cumsum(n_rest) - n_rest), n_rest) + np.arange(int(n_rest.sum()))]])
        move = by = np.empty(0, np.int64)
    ended(np.arange(n), np.iinfo(np.int64).max)
    return np.concatenate(places), np.concatenate(periods)


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length, period) of the maximal runs of least words and times periods or more, by place and then period; places count through all texts."""
    at, period = squares(words, sizes, sizes // times)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(period) != 0)
    last = np.append(new[1:], True) if len(at) else new
    first, length, period = at[new], at[last] - at[new] + 2 * period[new], period[new]
    long = length >= np.maximum(least, times * period)
    first, length, period = first[long], length[long], period[long]
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


def word_runs(df: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows and columns of df, and then n_words, runs (array of struct<start, length, period>, by start and then period, in words from 0) and collapsed (the words that no run
    contains after its first period, with one blank between).

    A run is a stretch of words with a smallest period, as long as least words and times periods at least, that no neighbouring word prolongs. `times` is 2 or more. Null and empty texts have no words and
    no runs, collapsed is empty. Rows are judged by their own text alone, so that repeated rows and ids are like others. Columns of df with the names of new ones give way. The
    work of a text grows as n log n, its memory with n, so a text must fit a task.
    """
    small_batches(df.sparkSession)
    fresh = ["n_words", "runs", "collapsed"]
    old = [c for c in df.columns if c not in fresh]

    def found(batches):
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(len(old)).to_pylist()]  # at the six ASCII blanks
            sizes = np.array([len(t) for t in texts], np.int64)
            ids = defaultdict(count().__next__)
            words = np.fromiter((ids[w] for t in texts for w in t), np.int64, int(sizes.sum()))
            first, length, period = runs_of(words, sizes, least, times)
            starts = np.cumsum(sizes) - sizes
            of = np.searchsorted(starts + sizes, first, side="right")
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, first + period, 1)
            np.add.at(change, first + length, -1)
            keep = np.cumsum(change[:-1]) == 0
            begins, joined = np.searchsorted(of, np.arange(len(texts) + 1)), []
            for t, (words_of, a, b) in enumerate(zip(texts, starts, starts + sizes, strict=True)):
                joined.append(b" ".join(words_of if begins[t] == begins[t + 1] else compress(words_of, keep[a:b].tolist())).decode())
            structs = pa.StructArray.from_arrays([pa.array(x) for x in (first - starts[of], length, period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(old)], pa.array(sizes), lists, pa.array(joined, pa.string())], names=[*old, *fresh])

    rows = df.select(*old, F.col(text_col).cast("binary").alias("_words"))
    return rows.mapInArrow(found, df.select(*old).schema.add("n_words", "long").add("runs", ArrayType(RUN)).add("collapsed", "string"))


def repeated_tail(doc_id: Column, words: Column) -> Column:
    """The words, where the contract of op13 asks for it with those from a place on replaced by a period of them: a text for tests of periodic words in prose."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.expr(rf"regexp_extract_all(text, r'{WORD}', 0)"))
    changed = docs.withColumn("words", words).select("doc_id", F.coalesce(F.array_join(repeated_tail(F.col("doc_id"), F.col("words")), " "), F.col("text")).alias("text"))
    found = word_runs(changed)
    higher = lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int"))
    best = F.get(F.array_sort("runs", lambda x, y: F.coalesce(higher(x, y), F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")), F.signum(x["period"] - y["period"]).cast("int"))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
