"""Removal of every byte that a repeated string of SPAN bytes covers, by bucket-pointer refinement.

Positions of texts are in buckets of equal strings. The identifier of a position's bucket for strings of 2h bytes is made from two identifiers for h bytes, its own
and that of the position h bytes later, so that each length reuses the one before: 1, 2, 4, ... bytes up to SPAN (`refined`). Equal strings have equal identifiers
wherever they stand, so buckets of different texts need no common numbering.

Only positions that can share a bucket are sorted. Each string of SPAN bytes is handed to one of the short strings (GRAM bytes) in it, the one with the least
identifier, the first of equals: its anchor. Equal strings have their anchors at equal places, so they meet where anchors do. Neighbouring strings of one anchor
are a run of starts. The initial buckets are those of the anchors' short strings; they are refined by the identifiers at later offsets:

1. by the identifiers at the first and the last start of the run, which fix all that the run's strings cover. One total order over all runs puts equal
   runs side by side; ranges of it are the tasks, whatever key is frequent. All strings of a run that is there twice are repeated.
2. by the identifiers at every start, only for runs without an equal one whose initial bucket holds others, where a repeat begins or ends within the run.
   A bucket of more than BUCKET different runs is refined by a grouping of its strings over the cluster, the others task by task.

Only refined buckets with one member have no repeated string. Where two strings are called equal, two identifiers of 64 bits agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quillon.llm.common import join_hot, small_batches, stored, table

SPAN = 200
#: Different runs of an initial bucket that one task refines.
BUCKET = 20_000
#: Bytes that are refined at once; a longer text is cut into pieces that overlap by SPAN.
PIECE = 1 << 20

_STEP, _MIX, _BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = (np.arange(1, 257, dtype=np.uint64) * _STEP) ^ ((np.arange(1, 257, dtype=np.uint64) * _MIX) >> np.uint64(23))
_INDEX = np.uint64((1 << 24) - 1)  # low bits of a winnowed key say where it stands

RUNS = "t long, n long, salt int, q long, u long, lo long, len int, twice boolean"
SPAN_LIST = ArrayType(StructType().add("s", "long").add("e", "long"))
SPANS = "t long, n long, s long, e long"


def refined(x: np.ndarray, later: int) -> np.ndarray:
    """Identifiers of the strings that begin with one of x and end with the one `later` positions on."""
    y = x[: len(x) - later] * _STEP
    y += x[later:]
    y ^= y >> np.uint64(32)
    y *= _MIX
    y ^= y >> np.uint64(29)
    return y


def _gram(span: int) -> int:
    return 1 << max(0, (span // 3).bit_length() - 1)


def _buckets(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the strings of _gram(span) and of span bytes at each position."""
    x, length, short = _BYTES[data], 1, _gram(span)
    at_short = x if short == 1 else None
    while 2 * length <= span:
        x, length = refined(x, length), 2 * length
        if length == short:
            at_short = x
    return at_short, refined(x, span - length) if span > length else x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base)]))[:n]


def _second(data: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Another identifier of the strings of span bytes at the starts, from sums over prefixes."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * _powers(_BASE, len(data)))])
    return (sums[starts + span] - sums[starts]) * _powers(_BACK, len(data))[starts]  # as if each began at 0


def _anchored(data: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Runs of starts in one buffer of texts that end at `ends`: first start, number of further ones, short identifier, identifier of the run."""
    none = np.empty(0, np.int64)
    if len(data) < span:
        return none, none, none, none
    short, full = _buckets(data, span)
    key, width, k = (short & ~_INDEX) | np.arange(len(short), dtype=np.uint64), span - _gram(span) + 1, 1
    while 2 * k <= width:
        key, k = np.minimum(key[:-k], key[k:]), 2 * k
    if width > k:
        key = np.minimum(key[: len(key) - (width - k)], key[width - k :])
    at = np.arange(len(data) - span + 1)
    inside = at + span <= ends[np.searchsorted(ends, at, side="right")]
    at, anchor = at[inside], (key[: len(inside)][inside] & _INDEX).astype(np.int64)
    if not len(at):
        return none, none, none, none
    first = np.nonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(at) != 1)]))[0]
    last = np.concatenate([first[1:], [len(at)]]) - 1
    lo, hi, p = at[first], at[last], anchor[first]
    both = full[lo] * _STEP + full[hi] + ((p - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64)
    both ^= both >> np.uint64(31)
    return lo, hi - lo, short[p].view(np.int64), (both * _MIX).view(np.int64)


def _pieces(texts: list, span: int) -> Iterator[tuple[list, bytes, np.ndarray, np.ndarray]]:
    """Texts together, up to PIECE bytes: their places, the bytes, where each ends there, and what of it stands before."""
    at, parts, before, size = [], [], [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - span + 1), PIECE):
            part = text if len(text) <= PIECE else text[begin : begin + PIECE + span - 1]
            if size and size + len(part) > PIECE:
                yield at, b"".join(parts), np.cumsum([len(p) for p in parts]), np.array(before)
                at, parts, before, size = [], [], [], 0
            at.append(i), parts.append(part), before.append(begin)
            size += len(part)
            if len(text) <= PIECE:
                break
    if at:
        yield at, b"".join(parts), np.cumsum([len(p) for p in parts]), np.array(before)


def _merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    if not len(s):
        return s, e
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]


def _runs_of(span: int) -> Callable:
    def runs(batches):
        for batch in batches:
            ts, ns, salts, texts = (batch.column(i).to_pylist() for i in range(4))
            for at, data, ends, before in _pieces(texts, span):
                lo, length, q, u = _anchored(np.frombuffer(data, np.uint8), ends, span)
                if not len(lo):
                    continue
                part = np.searchsorted(ends, lo, side="right")
                of, place = np.array(at)[part], lo - np.concatenate([[0], ends[:-1]])[part] + before[part]
                order = np.lexsort((place, u, q, of))
                of, place, length, q, u = (x[order] for x in (of, place, length, q, u))
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (q[1:] != q[:-1]) | (u[1:] != u[:-1])])
                many = np.diff(np.concatenate([np.nonzero(new)[0], [len(of)]])) > 1
                own = many[np.cumsum(new) - 1]
                known = [np.array(x, dtype=kind) for x, kind in ((ts, np.int64), (ns, np.int64), (salts, np.int32))]
                yield pa.RecordBatch.from_arrays([*[pa.array(x[of[new]]) for x in known], pa.array(q[new]), pa.array(u[new]), pa.array(place[new]), pa.array(length[new].astype(np.int32)), pa.array(many)], names=NAMES)
                for i in np.unique(of[own]):  # repeated within the piece: the covered bytes as they are
                    s, e = _merged(place[own & (of == i)], (place + length + span)[own & (of == i)])
                    nothing, k = pa.nulls(len(s), pa.int64()), len(s)
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.full(k, x[i])) for x in known], nothing, nothing, pa.array(s), pa.array((e - s).astype(np.int32)), pa.array(np.ones(k, bool))], names=NAMES)

    return runs


NAMES = [x.split()[0] for x in RUNS.split(", ")]


def _neighbours(batches):
    """Rows in the total order: what the rows beside them say. The first and the last of a task are edges (1, 2, or 3 for both), seen again with those of other tasks."""
    held, before, first = None, None, True
    task = TaskContext.get().partitionId()

    def told(rows: pa.Table, last: bool):
        q, u = rows.column("q").to_numpy(), rows.column("u").to_numpy()
        same_q = np.concatenate([[before is not None and before[0] == q[0]], q[1:] == q[:-1]])
        same = same_q & np.concatenate([[before is not None and before[1] == u[0]], u[1:] == u[:-1]])
        edge = np.zeros(len(q), np.int32)
        edge[0] += 1 if first else 0
        edge[-1] += 2 if last else 0
        next_q, next_same = np.append(same_q[1:], False), np.append(same[1:], False)
        twice = rows.column("twice").to_numpy(zero_copy_only=False)
        many, rep = same | next_same | twice, (same_q & ~same) | (next_q & ~next_same)
        keep = many | rep | (edge > 0)
        if not last:
            keep[-1] = False
        added = rows.append_column("task", pa.array(np.full(len(q), task, np.int32))).append_column("edge", pa.array(edge)).append_column("many", pa.array(many)).append_column("rep", pa.array(rep))
        return added.filter(pa.array(keep)).to_batches(), (q[-2], u[-2]) if len(q) > 1 else None

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if rows.num_rows > 1:
            out, seen = told(rows, False)
            yield from out
            before, first = seen, False
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield from told(held, True)[0]


def _sorted(runs: DataFrame) -> DataFrame:
    """Runs that share their initial bucket with others, whether an equal one is there (many), and whether they stand for their kind in a bucket with different runs (rep)."""
    order = ["q", "u", "t", "n", "lo", "salt"]
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = runs.where(F.col("q").isNotNull()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    seen = stored(ordered.mapInArrow(_neighbours, RUNS + ", task int, edge int, many boolean, rep boolean"))
    row = Window.orderBy("task", "edge")  # over two rows of each task
    beside = lambda f, c: f(c).over(row)
    edges = seen.where("edge > 0").select("*", *[beside(f, c).alias(f"{name}_{c}") for f, name in ((F.lag, "p"), (F.lead, "x")) for c in ("q", "u")])
    known = lambda name: F.coalesce(F.col(f"{name}_q") == F.col("q"), F.lit(False)) & F.col("edge").bitwiseAND(1 if name == "p" else 2).cast("boolean")
    equal = lambda name: F.col(f"{name}_u") == F.col("u")
    again = edges.select(
        *NAMES, (F.col("many") | (known("p") & equal("p")) | (known("x") & equal("x"))).alias("many"), (F.col("rep") | (known("p") & ~equal("p")) | (known("x") & ~equal("x"))).alias("rep")
    )
    return seen.where("edge = 0").select(*NAMES, "many", "rep").union(again)


def _starts(batch: pa.RecordBatch, span: int) -> tuple[np.ndarray, ...]:
    """Of every start of the batch's runs: the run's row, the start within it and two identifiers."""
    texts, lengths = batch.column("bytes").to_pylist(), batch.column("len").to_numpy().astype(np.int64) + 1
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    within = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = (np.cumsum(sizes) - sizes)[row] + within
    return row, within, _buckets(data, span)[1][at], _second(data, at, span)


CONTENTS = "q long, u long, many boolean, t long, n long, lo long, len int, bytes binary"


def _spans(batch: pa.RecordBatch, row: np.ndarray, within: np.ndarray, span: int) -> pa.RecordBatch:
    """The bytes that the starts of the batch's runs cover; starts in order."""
    new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(within) != 1)]) if len(row) else np.empty(0, bool)
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(row)]]).astype(np.int64) - 1 if len(first) else first
    of = row[first]
    lo = batch.column("lo").to_numpy()[of]
    return pa.RecordBatch.from_arrays([pa.array(batch.column("t").to_numpy()[of]), pa.array(batch.column("n").to_numpy()[of]), pa.array(lo + within[first]), pa.array(lo + within[last] + span)], names=["t", "n", "s", "e"])


def _refine_buckets(span: int) -> Callable:
    def refine(batches):
        """Rows in the order of their buckets; buckets are refined whole, many at once."""
        held = None
        for batch in _with_end(batches):
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            q = rows.column("q").to_numpy()
            cut = len(q) if batch is None else int(np.searchsorted(q, q[-1]))
            held = rows.slice(cut)
            if cut:
                whole = rows.slice(0, cut).combine_chunks().to_batches()[0]
                row, within, a, b = _starts(whole, span)
                order = np.lexsort((row, b, a))
                a, b, u = a[order], b[order], whole.column("u").to_numpy()[row[order]]
                same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                group = np.concatenate([[0], np.cumsum(~same)])
                other = np.zeros(group[-1] + 1, bool)
                np.logical_or.at(other, group[1:], same & (u[1:] != u[:-1]))
                found = np.zeros(len(row), bool)
                found[order] = other[group]
                found &= ~whole.column("many").to_numpy(zero_copy_only=False)[row]
                yield _spans(whole, row[found], within[found], span)

    return refine


def _with_end(batches):
    yield from batches
    yield None


def _starts_of(span: int) -> Callable:
    def starts(batches):
        for batch in batches:
            if batch.num_rows:
                row, within, a, b = _starts(batch, span)
                column = lambda name: pa.array(batch.column(name).to_numpy(zero_copy_only=False)[row])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([column("u"), column("many"), column("t"), column("n"), pa.array(batch.column("lo").to_numpy()[row] + within), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "many", "t", "n", "s", "a", "b"])

    return starts


def _contested(kinds: DataFrame, texts: DataFrame, span: int, bucket: int) -> DataFrame:
    """Spans of runs without an equal one, from the strings that they share with other runs of their initial buckets."""
    one = F.min(F.struct("t", "n", "salt", "lo", "len"))
    reps = kinds.where("rep").groupBy("q", "u").agg(one.alias("one"), F.max("many").alias("many"))
    sizes = reps.groupBy("q").agg(F.count("*").alias("size"), F.min("many").alias("all_many")).where("size > 1 and not all_many")
    wanted = reps.join(sizes, "q").select("q", "u", "many", "one.*", (F.col("size") > bucket).alias("large"))
    lists = wanted.groupBy("t", "n", "salt").agg(F.collect_list(F.struct("q", "u", "many", "lo", "len", "large")).alias("of"))
    rows = texts.join(lists, ["t", "n", "salt"]).select("t", "n", "data", F.explode("of").alias("r")).select("t", "n", "r.*", F.expr(f"substring(data, cast(r.lo + 1 as int), r.len + {span})").alias("bytes"))
    contents = stored(rows.select("q", "u", "many", "t", "n", "lo", "len", "bytes", "large"))
    names = [x.split()[0] for x in CONTENTS.split(", ")]
    small = contents.where("not large").select(*names).repartition("q").sortWithinPartitions("q").mapInArrow(_refine_buckets(span), SPANS)
    starts = contents.where("large").select(*names).mapInArrow(_starts_of(span), "u long, many boolean, t long, n long, s long, a long, b long")
    shared = starts.groupBy("a", "b").agg(F.min("u").alias("_least"), F.max("u").alias("_most"), F.count("*").alias("_n")).where("_least <> _most").drop("_least", "_most")
    large = join_hot(starts.where("not many"), shared, ["a", "b"], "_n")
    return small.union(large.select("t", "n", "s", (F.col("s") + span).alias("e")))


def repeated_spans(df: DataFrame, text_col: str = "text", span: int = SPAN, bucket: int = BUCKET) -> DataFrame:
    """(t, n, spans): for the hash and the size of each text with any, the spans (s, e) of bytes that strings of span bytes cover which start anywhere else too; spans may overlap."""
    small_batches(df.sparkSession)
    texts = _keyed(df, text_col)
    runs = stored(texts.where(F.col("n") >= span).select("t", "n", "salt", "data").mapInArrow(_runs_of(span), RUNS))
    kinds = _sorted(runs)
    end = F.col("lo") + F.col("len") + span
    whole = kinds.where("many and not twice").select("t", "n", F.col("lo").alias("s"), end.alias("e"))
    own = runs.where("q is null").select("t", "n", F.col("lo").alias("s"), (F.col("lo") + F.col("len")).alias("e"))
    spans = whole.union(own).union(_contested(kinds, texts, span, bucket))
    return spans.groupBy("t", "n").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    """The bytes of each row, the hash and the size that stand for them, and a hash of the row's first other columns, which tells equal texts apart where it can."""
    data, others = F.coalesce(F.col(text_col), F.lit("")).cast("binary"), [F.col(f.name) for f in df.schema if f.name != text_col and f.dataType.typeName() in ("long", "integer", "string")]
    return df.select(data.alias("data"), F.hash(*others[:2]).alias("salt") if others else F.lit(0).alias("salt")).select("data", F.xxhash64("data").alias("t"), F.octet_length("data").cast("long").alias("n"), "salt")


def remove_repeats(df: DataFrame, text_col: str = "text", span: int = SPAN, bucket: int = BUCKET) -> DataFrame:
    """The rows and columns of df, and then n_bytes and n_removed, spans (of the removed bytes, merged, as struct<s, e>) and kept (the bytes that are left, as binary; they
    need not be UTF-8, as strings of bytes may begin within a character).

    A null text counts as empty; a text of fewer than span bytes keeps all. What goes depends on the text alone, so repeated rows, which repeat each other's bytes, lose the same.
    Ids play no part. Columns of df with the names of new ones give way. Texts have fewer than 2^31 bytes, as Spark's strings.
    """
    fresh = ["n_bytes", "n_removed", "spans", "kept"]
    old = [c for c in df.columns if c not in fresh]
    found = repeated_spans(df, text_col, span, bucket).withColumnsRenamed({"t": "_t", "n": "_n", "spans": "_spans"})
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = df.select(*old, data.alias("_data"), F.xxhash64(data).alias("_t"), F.octet_length(data).cast("long").alias("_n"))
    rows = keyed.join(found, ["_t", "_n"], "left").select(*old, "_data", F.col("_spans.s").alias("_s"), F.col("_spans.e").alias("_e"))
    kinds = df.select(*old).schema.add("n_bytes", "long").add("n_removed", "long").add("spans", SPAN_LIST).add("kept", "binary")
    return rows.mapInArrow(_cut_out(len(old)), kinds)


def _cut_out(first: int) -> Callable:
    def cut_out(batches):
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for data, s, e in zip(*(batch.column(first + i).to_pylist() for i in range(3)), strict=True):
                s, e = _merged(np.array(s or [], np.int64), np.array(e or [], np.int64))
                sizes.append(len(data))
                removed.append(int((e - s).sum()))
                spans.append([{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True)))
            made = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], *made], names=[*batch.schema.names[:first], "n_bytes", "n_removed", "spans", "kept"])

    return cut_out


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_suffix_dedup": op11_suffix_dedup}
ORACLES: dict[str, str] = {}
