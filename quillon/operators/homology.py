"""Similar sequences: an inverted index of short words finds candidate pairs, and a banded local alignment scores them, many pairs at once. Both sides meet in blocks, and all of that happens within the task
of two blocks: places of words that meet are never rows of a table, so that disk holds no more than the sequences, once for each block of the other side.

Seeds are words of k letters. A word that stands at more than a FREQUENT-th of all places of the targets says little, so there longer words take its part: it is split by the letters that follow. Pairs
with two seeds or more on neighbouring diagonals are candidates; they are aligned within a band around the diagonals that have seeds. `exact` aligns every query with every target, without bands.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.packed import offsets
from quillon.plans.cut import cut

#: Letters of a seed, further ones where it is frequent, seeds that make a candidate, diagonals of a band.
WORD, LONGER, SEEDS, BAND = 4, 2, 2, 16
#: A word with more than this part of all places is frequent, so there are fewer frequent words than this.
FREQUENT = 2000
#: Scores of equal and different letters and of each letter of a gap; letters of the alphabet; the constant of the statistics of scores.
MATCH, OTHER, GAP, LETTERS, K = 5, -4, 6, 20, 0.1
#: Pairs that are aligned at once, and of long sequences as many as have so many places and diagonals.
PAIRS, CELLS = 512, 1 << 20
#: Letters of a block of targets; blocks of queries have four times as many. Places that meet and are held at once.
BLOCK, MET = 1 << 20, 1 << 20

HITS = "query string, target string, pident double, alnlen int, qcov double, tcov double, score int, m int"


def decay(match: int = MATCH, other: int = OTHER, letters: int = LETTERS) -> float:
    """The decay of chance scores: the positive root of the mean of exp(x * score) = 1 over pairs of letters that are equally frequent."""
    low, high = 1e-6, 2.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(x * match) / letters + math.exp(x * other) * (1 - 1 / letters) < 1 else (low, x)
    return x


def aligned(queries: list[str], targets: list[str], low: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
    """Best local alignments of pairs, over diagonals (place in the target less that in the query) from low to high: score, matches, columns, and first and last places in both, by arrays.

    One pass over the places of the queries; of equal scores the alignment with more matches counts, then the one that ends first. Without any positive score all are 0.
    """
    n, rows, width = len(queries), max(map(len, queries), default=0), int((high - low).max(initial=0)) + 1
    letters = lambda texts, size: np.array([np.frombuffer(t.encode("utf-32-le").ljust(4 * size, b"\0"), np.uint32) for t in texts]).reshape(len(texts), size)
    q, t = letters(queries, rows), letters(targets, max(map(len, targets), default=0))
    q_size, t_size = np.array([len(x) for x in queries]), np.array([len(x) for x in targets])
    # cells hold score, matches, columns, first query place, first target place
    last, best, pair = np.zeros((5, n, width + 2), np.int64), np.zeros((7, n), np.int64), np.arange(n)
    better = lambda a, b: (a[0] > b[0]) | ((a[0] == b[0]) & (a[1] > b[1]))
    for i in range(rows):
        now = np.zeros_like(last)
        j = i + low[:, None] + np.arange(width)[None, :]
        inside = (j >= 0) & (j < t_size[:, None]) & (i < q_size[:, None]) & (np.arange(width)[None, :] <= (high - low)[:, None])
        same = inside & (q[:, i, None] == t[pair[:, None], np.clip(j, 0, max(0, t.shape[1] - 1))])
        diagonal = last[:, :, 1:-1].copy()
        fresh = diagonal[0] == 0
        diagonal[1:3, fresh] = 0
        diagonal[3], diagonal[4] = np.where(fresh, i, diagonal[3]), np.where(fresh, j, diagonal[4])
        diagonal[0] += np.where(same, MATCH, OTHER)
        diagonal[1] += same
        diagonal[2] += 1
        up = last[:, :, 2:].copy()  # a letter of the query alone: one diagonal further on in the row before
        up[0] -= GAP
        up[2] += 1
        cell = np.where(better(up, diagonal)[None], up, diagonal)
        cell = np.where((inside & (cell[0] > 0))[None], cell, 0)
        for w in range(1, width):  # letters of the target alone
            left = cell[:, :, w - 1].copy()
            left[0] -= GAP
            left[2] += 1
            take = (left[0] > 0) & inside[:, w] & better(left, cell[:, :, w])
            cell[:, take, w] = left[:, take]
        now[:, :, 1:-1] = cell
        top = np.argmax(cell[0] * (1 << 20) + cell[1], axis=1)
        found = np.concatenate([cell[:, pair, top], [np.full(n, i), j[pair, top]]])
        best = np.where(better(found, best)[None], found, best)
        last = now
    return dict(zip(("score", "matches", "columns", "q_first", "t_first", "q_last", "t_last"), best, strict=True))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters in a row, and where each text begins."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), offsets([len(x) for x in texts])


def scores(q: np.ndarray, q_at: np.ndarray, q_size: np.ndarray, t: np.ndarray, t_at: np.ndarray, t_size: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
    """Score, matches and last places of what aligned finds, without the rest: a cell is one number, the score and below it the matches. Letters are over 0; each pair has its beginnings and sizes in them."""
    n, rows, width = len(low), int(q_size.max(initial=0)), int((high - low).max(initial=0)) + 1
    bits = rows.bit_length()
    kind = np.int32 if (MATCH * rows + GAP * width) << bits < 1 << 30 else np.int64
    one, gap = kind(1 << bits), kind(GAP << bits)
    j = np.arange(rows + width - 1)[:, None] + low
    ahead = np.where((j >= 0) & (j < t_size), t[np.clip(t_at + j, 0, max(0, len(t) - 1))], 0) if len(t) else np.zeros(j.shape, t.dtype)
    there, uneven, short = (ahead > 0).astype(kind), (np.arange(width)[:, None] <= high - low).astype(kind), int(q_size.min(initial=0))
    uneven = None if uneven.all() else uneven
    last, cell, best, q_last, t_last = np.zeros((width + 1, n), kind), np.empty((width, n), kind), np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(rows):
        own = q[np.minimum(q_at + i, len(q) - 1)]
        np.multiply(ahead[i : i + width] == own, kind(((MATCH - OTHER) << bits) + 1), out=cell)
        cell += last[:-1]
        cell -= kind(-OTHER << bits)
        np.maximum(cell, last[1:] - gap, out=cell)
        step, reach = 1, (int(cell.max(initial=0)) >> bits) // GAP  # letters of the target alone: by 1, 2, 4 ... as far as a score lasts
        while step <= reach and step < width:
            np.maximum(cell[step:], cell[:-step] - gap * kind(step), out=cell[step:])
            reach, step = reach - step, 2 * step
        cell *= there[i : i + width]
        if uneven is not None:
            cell *= uneven
        if i >= short:
            cell *= i < q_size
        cell *= cell >= one
        top = cell.max(axis=0)
        more = np.flatnonzero(top > best)
        if len(more):
            best[more], q_last[more], t_last[more] = top[more], i, i + low[more] + cell[:, more].argmax(axis=0)
        last[:-1] = cell
    return {"score": (best >> bits).astype(np.int64), "matches": (best & (one - kind(1))).astype(np.int64), "q_last": q_last, "t_last": t_last}


def _hits(queries: list[str], targets: list[str], which_q: np.ndarray, which_t: np.ndarray, low: np.ndarray, high: np.ndarray, least_identity: float, least_cover: float):
    """(pairs, their alignments) of the pairs which_q, which_t that can have identity and covers enough; the others are left after their scores: a hit has least_cover of the longer sequence as columns, and
    least_identity of these as matches, and doesn't end before least_cover of either sequence."""
    (q, q_at), (t, t_at) = _letters(queries), _letters(targets)
    alphabet = np.unique(np.concatenate([q, t]))
    kind = np.uint8 if len(alphabet) < 255 else np.uint32
    q, t = ((np.searchsorted(alphabet, x) + 1).astype(kind) for x in (q, t))
    m, n = np.diff(q_at), np.diff(t_at)
    cover, share = max(0.0, least_cover) * (1 - 1e-9), max(0.0, least_identity) / 100 * (1 - 1e-9)
    order, first = np.lexsort((m[which_q], high - low)), 0
    while first < len(order):
        cells = int(m[which_q[order[first : first + PAIRS]]].max() + (high - low)[order[first : first + PAIRS]].max()) + 1
        at = order[first : first + max(1, min(PAIRS, CELLS // cells))]
        first += len(at)
        a, b = which_q[at], which_t[at]
        s = scores(q, q_at[a], m[a], t, t_at[b], n[b], low[at], high[at])
        may = (s["matches"] >= share * cover * np.maximum(m[a], n[b])) & (s["q_last"] + 1 >= cover * m[a]) & (s["t_last"] + 1 >= cover * n[b])
        at, a, b = at[may], a[may], b[may]
        if len(at):
            yield at, aligned([queries[k] for k in a], [targets[k] for k in b], low[at], high[at])


def _rows(queries: list, targets: list, q_sizes: np.ndarray, t_sizes: np.ndarray, a: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns, hit = np.maximum(a["columns"], 1), a["score"] > 0
    texts, doubles, ints = (lambda x, kind=kind: pa.array(x, kind) for kind in (pa.string(), pa.float64(), pa.int32()))
    cover = lambda k, size: np.where(hit, (a[f"{k}_last"] - a[f"{k}_first"] + 1) / np.maximum(size, 1), 0.0)
    values = texts(queries), texts(targets), doubles(100.0 * a["matches"] / columns), ints(a["columns"]), doubles(cover("q", q_sizes)), doubles(cover("t", t_sizes)), ints(a["score"]), ints(np.maximum(q_sizes, 1))
    return pa.RecordBatch.from_arrays([*values], [c.split()[0] for c in HITS.split(", ")])


def _align(least_identity: float, least_cover: float):
    """Hits among pairs, over all diagonals."""

    def align(batches):
        for batch in batches:
            query, target, q, t = (batch.column(c).to_pylist() for c in ("query", "target", "q", "t"))
            sizes = [np.array([len(x) for x in s], np.int64) for s in (q, t)]
            every = np.arange(len(q))
            for at, a in _hits(q, t, every, every, 1 - sizes[0], sizes[1] - 1, least_identity, least_cover):
                yield _rows([query[k] for k in at], [target[k] for k in at], sizes[0][at], sizes[1][at], a)

    return align


def _seeds(texts: list[str], word: int, often: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place from 0, seed) of every place of the texts where a word begins; seeds are numbers, equal for equal ones."""
    letters, at = _letters([*texts, *often])
    sizes, gap = np.diff(at), word + LONGER
    starts = at[:-1] + np.arange(len(sizes)) * gap
    x, names = np.zeros(len(letters) + len(sizes) * gap + gap, np.int64), np.unique(letters, return_inverse=True)
    x[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)) * gap, sizes)] = names[1] + 1  # 0 after the end of a text
    base, end = len(names[0]) + 1, len(x) - gap
    codes, top, code = [], 1, np.zeros(end, np.int64)
    for k in range(gap):
        if top * base >= 1 << 61:
            code = np.unique(code, return_inverse=True)[1]
            top = end
        code, top = code * base + x[k : k + end], top * base
        if k == word - 1:
            codes.append(code)
    many = np.isin(codes[0], codes[0][starts[len(texts) :]])
    seed = np.where(many, 2 * code + 1, 2 * codes[0])
    n = np.maximum(0, sizes[: len(texts)] - word + 1)
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, place, seed[starts[text] + place]


def _runs(pair: np.ndarray, cell: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """One row for each pair and cell, of rows in the order of these: sums of n, least a, largest b."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), (pair[1:] != pair[:-1]) | (cell[1:] != cell[:-1])]))
    return [pair[first], cell[first], np.add.reduceat(n, first), np.minimum.reduceat(a, first), np.maximum.reduceat(b, first)] if len(first) else [pair, cell, n, a, b]


def _near(queries: list[str], targets: list[str], q_name: np.ndarray, t_name: np.ndarray, often: list[str], word: int, seeds: int, band: int):
    """(query, target, low, high) of candidates, as of candidates, by the numbers of their names, which ascend; some queries after the others, each of them whole."""
    text, place, seed = _seeds([*queries, *targets], word, often)
    mine = text < len(queries)
    q, q_at, q_seed = q_name[text[mine]], place[mine], seed[mine]
    t, t_at, t_seed = t_name[text[~mine] - len(queries)], place[~mine], seed[~mine]
    order = np.argsort(t_seed, kind="stable")
    t, t_at, t_seed = t[order], t_at[order], t_seed[order]
    begin = np.searchsorted(t_seed, q_seed)
    n = np.searchsorted(t_seed, q_seed, side="right") - begin
    before, names = offsets(n), np.concatenate([np.flatnonzero(np.diff(q, prepend=-1)), [len(q)]])
    shift = -(-(int(q_at.max(initial=0)) + 1) // band) * band
    room, many = (shift + int(t_at.max(initial=0)) + 1).bit_length(), int(t_name.max(initial=0)) + 1
    first, held = 0, None
    while first < len(q):
        stop = int(np.searchsorted(before, before[first] + MET, side="right")) - 1
        whole = int(names[np.searchsorted(names, stop, side="right") - 1])
        stop = whole if whole > first else min(len(q), max(first + 1, stop))
        some = n[first:stop]
        k = np.repeat(np.arange(first, stop), some)
        met = np.arange(len(k)) - np.repeat(before[first:stop] - before[first], some) + begin[k]
        key = ((q[k] * many + t[met]) << room) + (t_at[met] - q_at[k] + shift)
        key.sort()
        d = (key & ((1 << room) - 1)) - shift
        now = _runs(key >> room, d // band, np.ones(len(d), np.int64), d, d)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            order = np.lexsort((now[1], now[0]))
            now = _runs(*[x[order] for x in now])
        first = stop
        if first < len(q) and q[first] == q[first - 1]:
            held = now  # of one query, whose other places come next, and of those before it none
            continue
        held = None
        pair, cell, count, a, b = now
        beside = (pair[1:] == pair[:-1]) & (cell[1:] == cell[:-1] + 1) & (count[1:] + count[:-1] >= seeds)
        enough = count >= seeds
        enough[1:] |= beside
        enough[:-1] |= beside
        pair, a, b = pair[enough], a[enough], b[enough]
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        if len(starts):
            yield pair[starts] // many, pair[starts] % many, np.minimum.reduceat(a, starts) - band, np.maximum.reduceat(b, starts) + band


def _meet(often: list[str], word: int, seeds: int, band: int, least_identity: float, least_cover: float):
    """Hits among a block of queries and one of targets."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for part in (left, right):
            names, every = part.column("id").to_pylist(), part.column("seq").to_pylist()
            ids = sorted(set(names))
            number = {x: k for k, x in enumerate(ids)}
            name = np.array([number[x] for x in names], np.int64)
            order = np.argsort(name, kind="stable")
            texts = [every[k] for k in order]
            sides.append((ids, name[order], texts, np.array([len(x) for x in texts], np.int64), offsets(np.bincount(name, minlength=len(ids)))))
        (q_ids, q_name, q, q_size, q_at), (t_ids, t_name, t, t_size, t_at) = sides
        found = [_rows([], [], np.zeros(0, np.int64), np.zeros(0, np.int64), dict.fromkeys(("score", "matches", "columns", "q_first", "t_first", "q_last", "t_last"), np.zeros(0, np.int64)))]
        for a, b, low, high in _near(q, t, q_name, t_name, often, word, seeds, band):
            left_n, right_n = np.diff(q_at)[a], np.diff(t_at)[b]
            k = np.repeat(np.arange(len(a)), left_n * right_n)  # a name can have several sequences
            within = np.arange(len(k)) - np.repeat(np.cumsum(left_n * right_n) - left_n * right_n, left_n * right_n)
            x, y = q_at[a[k]] + within // right_n[k], t_at[b[k]] + within % right_n[k]
            for at, hit in _hits(q, t, x, y, np.maximum(low[k], 1 - q_size[x]), np.minimum(high[k], t_size[y] - 1), least_identity, least_cover):
                found.append(_rows([q_ids[i] for i in a[k[at]]], [t_ids[i] for i in b[k[at]]], q_size[x[at]], t_size[y[at]], hit))
        return pa.Table.from_batches(found)

    return meet


def _census(word: int):
    """(word, n): of the sequences of a batch how often each word stands there, and as null their letters."""

    def census(batches):
        for batch in batches:
            texts = batch.column("seq").to_pylist()
            text, place, seed = _seeds(texts, word, [])
            one, n = np.unique(seed, return_index=True, return_counts=True)[1:]
            words = [texts[a][b : b + word] for a, b in zip(text[one].tolist(), place[one].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([None, *words], pa.string()), pa.array([sum(map(len, texts)), *n.tolist()], pa.int64())], ["word", "n"])

    return census


def _words(df: DataFrame, size: int) -> DataFrame:
    """(id, seq, at, word): every place of a sequence where a word of that size begins."""
    places = F.when(F.length("seq") >= size, F.sequence(F.lit(1), F.length("seq") - size + 1))
    return df.select("id", "seq", F.explode(places).alias("at")).select("id", "at", F.expr(f"substring(seq, at, {size})").alias("word"), F.expr(f"substring(seq, at, {size + LONGER})").alias("longer"))


def candidates(queries: DataFrame, targets: DataFrame, word: int = WORD, seeds: int = SEEDS, band: int = BAND) -> DataFrame:
    """(query, target, low, high): pairs of ids with seeds enough on neighbouring diagonals, and the diagonals to look at; queries and targets have id and seq. Places of words are many more than the
    planner takes them for, which doesn't count what explode adds, so they are never broadcast. Here places that meet are rows, as many as queries times targets; search finds the same within blocks."""
    index = _words(targets, word)
    total = index.count()
    often = F.broadcast(index.groupBy("word").count().where(F.col("count") * FREQUENT > total).select("word", F.lit(True).alias("often")))  # fewer than FREQUENT rows
    seed = lambda df: df.join(often, "word", "left").select("id", "at", F.when(F.col("often"), F.col("longer")).otherwise(F.col("word")).alias("seed"))
    met = seed(_words(queries, word)).select(F.col("id").alias("query"), F.col("at").alias("q_at"), "seed").hint("merge").join(seed(index).select(F.col("id").alias("target"), F.col("at").alias("t_at"), "seed"), "seed")
    diagonal = met.select("query", "target", (F.col("t_at") - F.col("q_at")).alias("d"))
    cells = diagonal.select("query", "target", "d", F.explode(F.array(F.floor(F.col("d") / band), F.floor(F.col("d") / band) + 1)).alias("cell"))  # neighbours share one of two
    return cells.groupBy("query", "target", "cell").agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).where(F.col("n") >= seeds).groupBy("query", "target").agg((F.min("a") - band).alias("low"), (F.max("b") + band).alias("high"))


def _searched(q: DataFrame, t: DataFrame, least_identity: float, least_cover: float, word: int = WORD, seeds: int = SEEDS, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(hits, letters of the targets as one row). Each block of queries meets each block of targets in a task of its own. Sequences of one name stay together."""
    spark = q.sparkSession
    few = t.coalesce(2 * spark.sparkContext.defaultParallelism)  # each task writes most of all words, however few its sequences
    counts = cut(few.mapInArrow(_census(word), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    letters, total = counts.agg(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.sum(F.when(F.col("word").isNotNull(), F.col("n")))).first()
    often = [r.word for r in counts.where(F.col("word").isNotNull() & (F.col("n") * FREQUENT > (total or 0))).select("word").collect()]  # fewer than FREQUENT rows
    rows = -(-(q.agg(F.sum(F.length("seq"))).first()[0] or 1) // (4 * BLOCK))
    columns = max(-(-(letters or 1) // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda df, row, column: df.select("id", "seq", row.alias("a"), column.alias("b")).repartition(min(rows * columns, 1 << 14), "a", "b")
    left, right = dealt(q, of(rows), every(columns)), dealt(t, every(rows), of(columns))
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_meet(often, word, seeds, band, least_identity, least_cover), HITS)
    return found, spark.range(1).select(F.lit(float(letters or 0)).alias("_space"))


def search(queries: DataFrame, targets: DataFrame, id_col: str, seq_col: str, least_identity: float = 40.0, least_cover: float = 0.8, exact: bool = False, blocks: int = 8, **seeding) -> DataFrame:
    """(query, target, pident, alnlen, qcov, tcov, evalue, bits) of the pairs whose best local alignment has identity (percent of its columns) and covers (parts of both sequences) enough.

    Sequences are compared letter by letter, as they are written; null and empty ones and null ids have no hits. A sequence that is on both sides is a hit of itself. Repeated ids are sequences of one
    name. With exact, the stated queries meet all targets, in `blocks` groups of queries, and no hit is lost; else a hit is found if it shares seeds enough, as candidates says.
    """
    side = lambda df: df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(seq_col, F.lit("")).alias("seq")).where(F.col("id").isNotNull())
    q, t = side(queries), side(targets)
    if exact:  # without it an empty sequence has no words: a filter would make sequences twice, and before they are dealt out where a query makes them
        q, t = q.where("seq <> ''"), t.where("seq <> ''")
        block = F.pmod(F.xxhash64("id"), F.lit(blocks))
        left = q.select(F.col("id").alias("query"), F.col("seq").alias("q"), block.alias("b"))
        right = t.select(F.col("id").alias("target"), F.col("seq").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
        found = left.join(right, "b").select("query", "target", "q", "t").mapInArrow(_align(least_identity, least_cover), HITS)
        space = t.agg(F.sum(F.length("seq")).cast("double").alias("_space"))  # one row
    else:
        found, space = _searched(q, t, least_identity, least_cover, **seeding)
    hits = found.where((F.col("pident") >= least_identity) & (F.col("qcov") >= least_cover) & (F.col("tcov") >= least_cover))
    bits: Column = (F.lit(decay()) * F.col("score") - math.log(K)) / math.log(2)
    scored = hits.join(F.broadcast(space)).withColumn("bits", bits).withColumn("evalue", F.col("m") * F.col("_space") * F.pow(F.lit(2.0), -F.col("bits")))
    return scored.select("query", "target", "pident", "alnlen", "qcov", "tcov", "evalue", "bits")
