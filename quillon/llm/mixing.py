"""Mixing sources to target weights, by blocks.

The words of a source, its documents in a fixed pseudorandom order, are packed into blocks of a fixed length. Output shards draw
one after the other how many of their slots each source gets, from a multinomial distribution whose weights are the slots still due; a source that gets more
than it is due hands the rest back to be drawn again, and the last shard gets what is left, so that all shards together come to the targets. The k-th slot of a source
stands for its block number p(k mod n) of pass k div n, where n is
its number of blocks and p is a keyed pseudorandom permutation of the pass, so a block comes back only once all have been taken.
Within a shard another permutation deals the slots of all sources into one order. Slots and packed documents meet in a join by source and block; `mixed_blocks` is the mix as shards
of blocks, `mix` the same words as documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, cut, table

#: Weights of the sources, by code point, null last; they repeat.
WEIGHTS = (3, 1, 2)
#: Words to mix, as a part of all words; most times that a source is used.
SHARE, MOST = 1.5, 2.0
#: Words of a block; output shards; groups of documents in which a source's order is laid out; slots laid out at once.
BLOCK, SHARDS, GROUPS, RUN = 64, 64, 1024, 8192
#: Slots that one task lays out.
TASK = 1 << 17
SEED = 20
#: So many sources are broadcast; more are joined by shuffle.
FEW_SOURCES = 10_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares by weight of a part of all words; what a source can't take goes to the others by weight, until none is above its bound."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    found: dict[int, float] = {}
    while True:
        rest = share * sum(sizes) - sum(found.values())
        total = sum(w for i, w in enumerate(weight) if i not in found)
        given = {i: rest * w / total for i, w in enumerate(weight) if i not in found}
        above = {i: most * sizes[i] for i, x in given.items() if x > most * sizes[i]}
        if not above:
            return [found[i] if i in found else given[i] for i in range(len(sizes))]
        found |= above


def draw(slots: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Slots by shard and source: multinomial counts of even shards, held to what each source is still due."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    rows = []
    for k in range(shards, 0, -1):
        row, want = (left, 0) if k == 1 else (np.zeros_like(left), int(left.sum()) // k)
        while want:
            due = left - row
            row = np.minimum(left, row + rng.multinomial(want, due / due.sum()))
            want = int(left.sum()) // k - int(row.sum())
        rows.append(row)
        left = left - row
    return np.array(rows)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of range(n) for each key: four rounds of a Feistel network over the next even number of bits, again until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, todo = index.astype(np.uint64), n.astype(np.uint64), np.ones(len(index), bool)
    key = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right, h, m, k = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo], key[todo]
            for turn in range(4):
                mixed = (right + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ k
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & m)
            x[todo] = left << h | right
            todo = x >= n
    return x.astype(np.int64)


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """A mix of the rows of df. Everything in it is fixed by the rows, the parameters and the seed, in whatever order the rows come."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shards: int = SHARDS, seed: int = SEED):
        self.spark, self.block = df.sparkSession, block
        rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
        self.rows = cut(rows)
        found = self.rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).collect()
        sizes = [r["size"] for r in found]
        self.target = targets(sizes) if any(sizes) else [0.0] * len(sizes)
        self.blocks = [-(-s // block) for s in sizes]
        slots = [round(t * b / s) if s else 0 for t, b, s in zip(self.target, self.blocks, sizes, strict=True)]
        counts = draw(slots, shards, seed) if slots else np.zeros((0, 0), np.int64)
        starts = np.cumsum(counts, axis=0) - counts
        self.sources = self.spark.createDataFrame([(i, r["source"], sizes[i], self.target[i], self.blocks[i]) for i, r in enumerate(found)], "src int, source string, source_size long, target double, n_blocks long")
        if len(found) <= FEW_SOURCES:
            self.sources = F.broadcast(self.sources)
        ahead, whole = np.cumsum(counts, axis=1) - counts, counts.sum(axis=1)  # slots of a shard's sources before, and of all of them
        laid = [(int(k), int(src), int(starts[k, src]), int(counts[k, src]), self.blocks[src], int(ahead[k, src]), int(whole[k])) for k, src in zip(*np.nonzero(counts), strict=True)]
        self.draws = self.spark.createDataFrame(laid, "shard int, src int, start long, n long, n_blocks long, ahead long, in_shard long")
        self.seed, self.n_slots = seed, int(counts.sum())

    def packed(self) -> DataFrame:
        """(id, source, size, text_hash, src, start ...): rows with the place of their first word in their source."""
        known = self.rows.withColumnRenamed("source", "_source").join(self.sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
        grouped = known.withColumn("grp", F.pmod(F.xxhash64(F.lit(self.seed), "id"), F.lit(GROUPS)))
        before = Window.partitionBy("src").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
        sums = grouped.groupBy("src", "grp").agg(F.sum("size").alias("words"))
        offsets = sums.select("src", "grp", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
        within = Window.partitionBy("src", "grp").orderBy("id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
        placed = grouped.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        return placed.join(offsets, ["src", "grp"]).withColumn("start", F.col("offset") + F.col("within")).drop("offset", "within", "grp")

    def pieces(self, packed: DataFrame) -> DataFrame:
        """One row for each block that a row has words in: block, first and words, counted within the row."""
        b, start, end = F.lit(self.block), F.col("start"), F.col("start") + F.col("size")
        rows = packed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / b), F.floor((end - 1) / b))))
        first = F.greatest(start, F.col("block") * b)
        return rows.withColumn("first", first - start).withColumn("words", F.least(end, (F.col("block") + 1) * b) - first)

    def slots(self) -> DataFrame:
        """(shard, place, src, pass, block) for every slot of the mix; places of a shard go from 0 on."""
        seed = self.seed

        @F.pandas_udf("long")
        def block_of(place: pd.Series, n: pd.Series, src: pd.Series, turn: pd.Series) -> pd.Series:
            key = (src.to_numpy(np.int64).astype(np.uint64) << np.uint64(32)) ^ (turn.to_numpy(np.int64).astype(np.uint64) << np.uint64(8)) ^ np.uint64(seed)
            with np.errstate(over="ignore"):
                return pd.Series(permuted(place.to_numpy(np.int64), n.to_numpy(np.int64), key * np.uint64(0xD6E8FEB86659FD93)))

        @F.pandas_udf("long")
        def place_of(index: pd.Series, n: pd.Series, shard: pd.Series) -> pd.Series:
            with np.errstate(over="ignore"):
                key = (shard.to_numpy(np.int64).astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
            return pd.Series(permuted(index.to_numpy(np.int64), n.to_numpy(np.int64), key))

        stop = F.col("start") + F.col("n")
        tasks = max(1, -(-self.n_slots // TASK))
        runs = self.draws.withColumn("from", F.explode(F.sequence("start", stop - 1, F.lit(RUN)))).withColumn("to", F.least(stop, F.col("from") + RUN) - 1)
        spread = runs.select("shard", "src", "n_blocks", (F.col("ahead") - F.col("start")).alias("shift"), "in_shard", "from", "to").repartition(tasks, F.col("src"), F.col("from"))  # by number, so that few rows of many slots aren't merged into one task
        every = spread.select("shard", "src", "n_blocks", "shift", "in_shard", F.explode(F.sequence("from", "to")).alias("k"))
        turns = every.select("shard", "src", "n_blocks", "in_shard", (F.col("k") + F.col("shift")).alias("index"), F.expr("k div n_blocks").alias("pass"), (F.col("k") % F.col("n_blocks")).alias("nth"))
        return turns.select("shard", place_of("index", "in_shard", "shard").alias("place"), "src", "pass", block_of("nth", "n_blocks", "src", "pass").alias("block"))

    def taken(self) -> DataFrame:
        """Per row of the input: id, size, source_size, target and taken, the words that the mix takes from it, repeats counted, and first_shard and last_shard, between which all of them go (null for none)."""
        packed = cut(self.packed())
        times = self.slots().groupBy("src", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
        met = self.pieces(packed).hint("merge").join(times, ["src", "block"], "left")
        sums = met.groupBy("src", "start", "id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
        no_shard = F.lit(None).cast("int")
        empty = packed.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), no_shard.alias("first_shard"), no_shard.alias("last_shard"))
        return sums.select("id", "size", "source_size", "target", "taken", "first_shard", "last_shard").union(empty)

    def ranges(self) -> DataFrame:
        """(id, text_hash, start, pass, taken): for each row and pass the (first, words) of what the mix takes, in the row's order."""
        # Without the hint the slots, whose number can't be seen before they are laid out, would be broadcast.
        met = self.pieces(cut(self.packed())).hint("merge").join(self.slots(), ["src", "block"])
        return met.groupBy("src", "start", "id", "text_hash", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("taken"))


def mixed_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """Per row of df: id_col, size, source_size, target, taken, first_shard and last_shard.

    Sizes are words of whole texts; null and empty texts have none and nothing is taken from them. A null source is a source of its own.
    Of repeated rows each counts; which of them a word is taken from is left open, as they are equal.
    """
    return Mix(df, id_col, text_col, source_col, **parameters).taken().withColumnRenamed("id", id_col)


def mixed_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The mix as it is written: a row for each block of each output shard, with shard, place (from 0 on in each shard), source, pass, block and text, the words of the block with one blank between.

    A shard has as many blocks of a source as it has drawn. Null and empty texts have no words; rows with the same id and text are packed one after the other, each of them with its own words.
    """
    plan = Mix(df, id_col, text_col, source_col, **parameters)
    at = F.struct("start", "block", "first", "words")
    ranges = plan.pieces(cut(plan.packed())).groupBy("src", "id", "text_hash").agg(F.collect_list(at).alias("_at"))  # as many as the text has blocks
    texts = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text")).dropDuplicates(["_id", "_hash"])
    joined = ranges.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    words = F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1))
    part = lambda found: F.transform("_at", lambda a: F.struct(a["block"].alias("block"), a["start"].alias("start"), F.array_join(F.slice(found, (a["first"] + 1).cast("int"), a["words"].cast("int")), " ").alias("t")))
    pieces = joined.select("src", F.explode(F.flatten(F.transform(F.array(words), part))).alias("p")).select("src", "p.*")
    blocks = pieces.groupBy("src", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "t"))), lambda x: x["t"]), " ").alias("text"))
    named = plan.slots().hint("merge").join(blocks, ["src", "block"]).join(plan.sources, "src")
    return named.select("shard", "place", "source", "pass", "block", "text")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The mix itself, in the columns of df: a row for each row and pass that words are taken from; the text holds these words, with the white space before each.

    Rows with the same id and text get the other columns of one of them.
    """
    plan = Mix(df, id_col, text_col, source_col, **parameters)
    ranges = plan.ranges().select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("taken").alias("_taken"))
    repeated = not plan.rows.groupBy("id", "text_hash").count().where("count > 1").isEmpty()
    once = df.withColumn("_hash_of", F.xxhash64(text_col)).dropDuplicates([id_col, "_hash_of"]).drop("_hash_of") if repeated else df
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    taken = lambda found: F.flatten(F.transform("_taken", lambda t: F.slice(found, (t["first"] + 1).cast("int"), t["words"].cast("int"))))
    text = F.array_join(F.flatten(F.transform(F.array(words), taken)), "")  # the words are found once for each row, not for each range
    joined = once.join(ranges, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash")))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed_words(table(spark, sf_dir, "documents"))


QUERIES = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
