"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds what they miss.

A text's tokens are runs of secret-like characters (letters, digits, + / _ . = -) and single other marks. Each is tagged begin, inside or outside of
a secret from its own shape, the words on either side and features of the whole file. The field is fitted, by its exact gradient, to windows of
tokens of a bounded sample of texts: stretches with what the patterns find, the pattern's keyword itself being outside; the same places with other keywords and secrets of
other shapes, which no pattern knows; and stretches of clean text, some with planted addresses, paths, numbers and names that only look like secrets. Decoding is by
Viterbi. A token whose score for outside leads by more than any transitions can make up is outside in the best tagging, so that only the stretches
between such tokens are decoded. Long texts are read in pieces that overlap by the neighbours that features see; the result is that of the whole text.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, sampled, small_batches, table

#: The patterns by kind, the group that is the secret, and the least characters of it.
PATTERNS = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = ("assign", "access", "hex", "crf")
#: Texts without any of these have no assignment.
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Runs that are long enough for the last pattern; a run of [0-9a-f] of 24 or more is what the pattern finds there.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

OUT, BEGIN, INSIDE = 0, 1, 2
#: Slots of features, and hashed values of each.
SLOTS, VALUES = 8, 4096
#: Texts to learn from at most, those with labels and those without; windows of each kind that are learned from at most; tokens of a window.
SAMPLE, WINDOWS, WINDOW = 1500, 3000, 24
ROUNDS, STEP, SHRINK, BATCH = 6, 0.2, 1e-3, 256
#: Bytes of a text whose tokens are in memory at once; longer texts are cut at white space, and a longer run without any is a piece of its own.
CHUNK = 1 << 20
#: Kinds of windows: clean text, what the patterns find, planted secrets, planted others.
CLEAN, FOUND, SECRET, OTHER = range(4)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the secret) of what the patterns find, leftmost first."""
    found, small = [], text.lower()
    for kind, (name, pattern, group, least) in enumerate(PATTERNS):
        if name == "assign" and not any(k in small for k in KEYWORDS) or name == "access" and "AKIA" not in text:
            continue
        for m in (LONG_HEX if name == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind, m.start(group)))
    return sorted(found)


# Classes of bytes. 0 white space, 1 small letters, 2 capitals, 3 digits, 4 + / _ . = -, 5 bytes of other characters, 6 other marks.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[ord(c) for c in "+/_.=-"]] = 4
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


class Tokens:
    """The tokens of a piece of a text, as UTF-8 bytes, and their features; whole arrays at a time."""

    def __init__(self, data: bytes, file: int):
        b = np.frombuffer(data, np.uint8)
        c = _CLASS[b]
        solid = (c >= 1) & (c <= 5)
        starts = (c > 0) & ~(solid & np.concatenate([[False], solid[:-1]]))
        self.start = np.nonzero(starts)[0]
        n = len(self.start)
        if not n:
            self.end, self.features = self.start, np.zeros((0, SLOTS), np.int64)
            return
        filled = np.add.reduceat((c > 0).astype(np.int64), self.start)
        self.end = self.start + filled  # a token has no white space in it
        count = lambda mask: np.add.reduceat(mask.astype(np.int64), self.start)
        small, large, digits, marks, other = (count(c == k) for k in (1, 2, 3, 4, 5))
        hexes = count(_HEX[b])
        turns = count(np.concatenate([[False], c[1:] != c[:-1]]) & (c > 0))
        length = filled
        place = np.arange(len(b)) - self.start[np.maximum(0, np.cumsum(starts) - 1)]
        weight = (place * 2654435761 + 97) & 0xFFFF
        word = np.add.reduceat(np.where(c > 0, (_LOWER[b] + 1) * (weight | 1), 0), self.start)
        word = (word ^ (word >> 11)) & (VALUES - 1)
        band = np.minimum(15, np.where(length < 12, length // 2, 6 + (length - 12) // 6))
        shape = (((band * 2 + (small > 0)) * 2 + (large > 0)) * 2 + (digits > 0)) * 2 + (marks > 0)
        shape = shape * 2 + (other > 0)
        tenth = lambda x: np.minimum(7, 8 * x // np.maximum(1, length))
        mix = (tenth(digits) * 8 + tenth(large)) * 8 + np.minimum(7, turns)
        near = lambda k: _shifted(word, k)
        mark = np.where(length == 1, word, 0)
        hexy = (hexes == length) * 16 + band
        self.features = np.stack(
            [
                shape & (VALUES - 1),
                mix & (VALUES - 1),
                (hexy * 8 + np.minimum(7, turns)) & (VALUES - 1),
                near(1),
                near(2),
                _shifted(word, -1),
                (near(1) * 31 + _shifted(mark, 2) * 7 + band) & (VALUES - 1),
                np.full(n, 0) + ((file * 16 + band) & (VALUES - 1)),
            ],
            axis=1,
        )


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    """x as seen k tokens later; 1 where there is none."""
    out = np.ones_like(x)
    if k > 0:
        out[k:] = x[:-k]
    else:
        out[:k] = x[-k:]
    return out


def file_features(data: bytes) -> int:
    """The length of the text and how many of its bytes are digits, in bands."""
    size = min(7, max(0, len(data).bit_length() - 6) // 2)
    b = np.frombuffer(data, np.uint8)
    digits = int(((b >= 48) & (b <= 57)).sum())
    return size * 8 + min(7, 64 * digits // max(1, len(data)))


BLANK, FILLED = re.compile(rb"[\t-\r ]"), re.compile(rb"[^\t-\r ]")


def featured(data: bytes, file: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, first bytes, bytes after the last) of all tokens of a text, piece by piece. A piece is read with the two tokens before it and one after."""
    start = seen = 0
    while start < len(data):
        stop = min(len(data), start + CHUNK)
        if stop < len(data):
            blank = max(data.rfind(c, start + 1, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            stop = blank if blank > 0 else m.start() if (m := BLANK.search(data, stop)) else len(data)
        after = m.start() if (m := FILLED.search(data, stop)) else len(data)
        until = m.start() if (m := BLANK.search(data, after)) else len(data)
        tokens = Tokens(data[seen:until], file)
        at = tokens.start + seen
        own = (at >= start) & (at < stop)
        yield tokens.features[own], at[own], tokens.end[own] + seen
        before = at[at < stop]
        seen, start = int(before[-2:][0]) if len(before) else stop, stop


Field = tuple[np.ndarray, np.ndarray]


def scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of the three tags for each token; weights are slots by values by tags."""
    total = np.zeros((len(features), 3), np.float32)
    for slot in range(SLOTS):
        total += weights[slot, features[:, slot]]
    return total


def viterbi(emit: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of a stretch between outside tokens."""
    best, back = moves[OUT] + emit[0], []
    for row in emit[1:]:
        options = best[:, None] + moves
        back.append(options.argmax(axis=0))
        best = options.max(axis=0) + row
    tags = [int((best + moves[:, OUT]).argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


def stretches(emit: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """(first, after the last) of the stretches outside of which every token is outside in the best tagging.

    What a token adds to a secret is at most h, its lead over outside with the best move into it. A secret that adds anything at all holds a token with h >= 0, but for
    what its end may add. Within it, tokens whose h come to less than -split are better outside, whatever the moves at both sides of the gap.
    """
    stay, inner = moves[OUT, OUT], (BEGIN, INSIDE)
    step = moves[:, inner].max() - stay
    ending = max(0.0, max(moves[x, OUT] for x in inner) - stay)
    split = max(0.0, max(moves[z, y] - moves[OUT, y] for z in inner for y in inner)) + max(0.0, max(stay - moves[x, OUT] for x in inner)) + 1e-3
    h = emit[:, 1:].max(axis=1) - emit[:, OUT] + step
    found: list[tuple[int, int]] = []
    for seed in np.nonzero(h + ending >= -1e-3)[0].tolist():
        done = found[-1][1] if found else 0
        low, left = seed, 0.0
        while low > done and (left := left + float(h[low - 1])) >= -split:
            low -= 1
        high, left = seed + 1, 0.0
        while high < len(h) and (left := left + float(h[high])) >= -split and (high <= done or h[high] + ending < -1e-3):
            high += 1
        high = max(high, done)
        if found and low <= done:
            found[-1] = (found[-1][0], high)
        else:
            found.append((low, high))
    return found


def tagged(data: bytes, field: Field) -> list[tuple[int, int]]:
    """Byte spans of the secrets that the field finds in a whole text."""
    weights, moves = field
    parts = [(start, end, scores(features, weights)) for features, start, end in featured(data, file_features(data))]
    if not parts:
        return []
    start, end, emit = (np.concatenate(x) for x in zip(*parts, strict=True))
    found = []
    for low, high in stretches(emit, moves):
        tags = viterbi(emit[low:high], moves)
        k = 0
        while k < len(tags):
            stop = k + 1
            if tags[k] != OUT:
                while stop < len(tags) and tags[stop] == INSIDE:
                    stop += 1
                found.append((int(start[low + k]), int(end[low + stop - 1])))
            k = stop
    return found


def bytes_of(text: str, data: bytes, places: list[int]) -> list[int]:
    """The byte that each code point, in rising order, begins at."""
    if len(text) == len(data):
        return places
    out, at, byte = [], 0, 0
    for p in places:
        byte += len(text[at:p].encode("utf-8", "surrogatepass"))
        at = p
        out.append(byte)
    return out


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Words before a planted secret, with and without a mark between.
INTROS = ("", "", "", "pwd", "auth", "credential", "bearer", "access key", "private_key", "passphrase", "login", "cert", "key", "sig", "hash of the account", "Authorization")
MARKS = (" ", ": ", " = ", "=", " is ", ":", " -> ", '="', ": '", " `")


def secret_of(rng: random.Random) -> str:
    """A made-up secret: digests, encoded bytes, prefixed keys, signed tokens, passwords with marks."""
    pick = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    mixed = LETTERS + LETTERS.upper() + DIGITS
    kind = rng.randrange(7)
    if kind == 0:
        return pick(mixed + "+/", 20, 64) + "=" * rng.randrange(3)
    if kind == 1:
        return pick(mixed + "_-", 20, 64)
    if kind == 2:
        return pick(LETTERS, 2, 5) + rng.choice("_-") + pick(mixed, 16, 40)
    if kind == 3:
        return pick("0123456789ABCDEF", 24, 64)
    if kind == 4:
        return ".".join(pick(mixed + "_-", 12, 40) for _ in range(3))
    if kind == 5:
        return pick(LETTERS + DIGITS, 20, 48)
    return pick(mixed, 4, 8) + rng.choice("!@#$%&*") + pick(mixed, 3, 8)


def other_of(rng: random.Random) -> str:
    """What only looks like one: addresses, paths, numbers, dates, versions, names."""
    word = lambda low=3, high=9: "".join(rng.choice(LETTERS) for _ in range(rng.randint(low, high)))
    number = lambda n: "".join(rng.choice(DIGITS) for _ in range(n))
    return rng.choice(
        [
            lambda: f"{word()}.{number(2)}@{word()}{number(1)}.{word()}.com",
            lambda: f"https://www.{word()}.org/{word()}/{word()}-{word()}-{number(4)}.html",
            lambda: f"/usr/{word()}/{word()}_{word()}/{word()}{number(2)}.{word(1, 3)}",
            lambda: number(rng.randint(6, 20)),
            lambda: f"+{number(2)}-{number(3)}-{number(7)}",
            lambda: f"20{number(2)}-0{number(1)}-1{number(1)}",
            lambda: f"v{number(1)}.{number(2)}.{number(1)}-{word()}",
            lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 5))),
            lambda: "_".join(word() for _ in range(rng.randint(2, 5))),
            lambda: "-".join(word() for _ in range(rng.randint(2, 4))),
            lambda: word(14, 30),
            lambda: word(6, 20).upper(),
        ]
    )()


Window = tuple[int, np.ndarray, np.ndarray]


def _cut(kind: int, features: np.ndarray, tags: np.ndarray, at: int) -> Window:
    """The window around a token; a text of fewer tokens is filled up with empty ones, which are outside."""
    low = max(0, min(len(tags) - WINDOW, at - WINDOW // 2))
    x, y = features[low : low + WINDOW], tags[low : low + WINDOW]
    lacking = WINDOW - len(y)
    return kind, np.pad(x, ((0, lacking), (0, 0))).astype(np.int16), np.pad(y, (0, lacking)).astype(np.int8)


def windows(text: str) -> list[Window]:
    """(kind, features, tags) of all stretches of a text: around everything the patterns find, the clean ones between, and those with planted secrets and others."""
    data = text.encode("utf-8", "surrogatepass")
    file, out, rng = file_features(data), [], random.Random(text)
    spans = [(s, e, f) for f, e, _, s in base_spans(text)]
    parts = list(featured(data, file))
    if not parts:
        return []
    features, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    tags = np.zeros(len(start), np.int64)
    first = bytes_of(text, data, [s for s, _, _ in sorted(spans)])
    for a, (s, e, _) in zip(first, sorted(spans), strict=True):
        b = a + len(text[s:e].encode("utf-8", "surrogatepass"))
        low, high = np.searchsorted(end, a, "right"), np.searchsorted(start, b)
        tags[low:high] = INSIDE
        tags[low : low + 1] = BEGIN
    out += [_cut(FOUND, features, tags, at) for at in np.nonzero(tags == BEGIN)[0]]
    for at in range(0, len(tags), WINDOW):
        if not tags[at : at + WINDOW].any():
            out.append(_cut(CLEAN, features, tags, min(len(tags), at + WINDOW // 2)))
    places = [(f, e) for _, e, f in spans] or [(m.start(), m.start()) for m in [re.compile(r"\s").search(text, rng.randrange(len(text)))] if m]
    for f, e in places:
        left, right = text[max(0, f - 150) : f], text[e : e + 150]
        for kind, made in ((SECRET, secret_of(rng)), (OTHER, other_of(rng))):
            intro, mark = rng.choice(INTROS), rng.choice(MARKS)
            before = left + rng.choice((" ", "\n")) + (intro + mark if intro else rng.choice(("", '"', "(")))
            whole = (before + made + rng.choice((" ", '" ', "\n", "' ", "; ")) + right).encode("utf-8", "surrogatepass")
            low = len(before.encode("utf-8", "surrogatepass"))
            tokens = Tokens(whole, file)
            here = (tokens.end > low) & (tokens.start < low + len(made))
            tags = np.where(here, INSIDE if kind == SECRET else OUT, OUT)
            tags[np.nonzero(here)[0][:1]] = BEGIN if kind == SECRET else OUT
            out.append(_cut(kind, tokens.features, tags, int(np.nonzero(here)[0][0])))
    return out


def marginals(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows by tokens by tags: the logarithm of the sum over all taggings, the probability of each tag of each token, and the expected number of each move."""
    ahead, behind, length = np.zeros_like(emit), np.zeros_like(emit), emit.shape[1]
    ahead[:, 0] = moves[OUT] + emit[:, 0]
    for t in range(1, length):
        ahead[:, t] = emit[:, t] + _log_sum(ahead[:, t - 1, :, None] + moves, 1)
    behind[:, -1] = moves[:, OUT]
    for t in range(length - 2, -1, -1):
        behind[:, t] = _log_sum(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
    whole = _log_sum(ahead[:, -1] + moves[:, OUT], 1)
    expected = np.zeros((3, 3))
    for t in range(1, length):
        expected += np.exp(ahead[:, t - 1, :, None] + moves + (emit[:, t] + behind[:, t])[:, None, :] - whole[:, None, None]).sum(axis=0)
    return whole, np.exp(ahead + behind - whole[:, None, None]), expected


def fit(features: np.ndarray, tags: np.ndarray, seed: int = 0) -> Field:
    """The field with the largest likelihood of the windows (windows by tokens by slots, and their tags), by AdaGrad."""
    rng = np.random.default_rng(seed)
    weights, moves = np.zeros((SLOTS, VALUES, 3), np.float32), np.zeros((3, 3), np.float64)
    weights[:, :, OUT] = 1.0 / SLOTS  # what was never seen is outside
    moves[OUT, INSIDE] = -4.0
    sum_w, sum_m = np.full_like(weights, 1e-4), np.full_like(moves, 1e-4)
    n = len(tags)
    slots = np.arange(SLOTS)
    for _ in range(ROUNDS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            part = order[at : at + BATCH]
            x, y = features[part], tags[part]
            emit = weights[slots, x].sum(axis=2, dtype=np.float64)
            _, slope, g_m = marginals(emit, moves)
            np.subtract.at(g_m, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            np.subtract.at(slope.reshape(-1, 3), (np.arange(y.size), y.ravel()), 1.0)
            slope = slope.reshape(-1, 3).astype(np.float32)
            for slot in range(SLOTS):
                known, inverse = np.unique(x[:, :, slot].ravel(), return_inverse=True)
                g = SHRINK * weights[slot, known]
                for tag in range(3):
                    g[:, tag] += np.bincount(inverse, slope[:, tag], len(known))
                sum_w[slot, known] += g**2
                weights[slot, known] -= STEP * g / np.sqrt(sum_w[slot, known])
            sum_m += g_m**2
            moves -= STEP * g_m / np.sqrt(sum_m)
    return weights, moves


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Fits to at most `sample` texts with something that the patterns find and as many without, and of these to at most WINDOWS windows of each kind, both chosen by hashes.

    Whether a text has something is told by simpler patterns in Spark, in one pass; the labels come from the patterns themselves. Equal texts are one.
    """
    small_batches(df.sparkSession)
    may = F.col(text_col).rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|(?-i:[0-9a-f]{24})")
    units = cut(df.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("_txt"), may.alias("_may")).distinct())
    chosen = cut(sampled(units, "_may", ["_txt"], sample).select("_txt"))  # twice `sample` rows at most

    @F.pandas_udf("array<struct<kind:int,x:binary,y:binary>>")
    def cut_out(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "x": x.tobytes(), "y": y.tobytes()} for k, x, y in windows(t)] for t in texts], dtype=object)

    texts = df.select(F.xxhash64(text_col).alias("_txt"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_txt", "left_semi")
    every = cut(texts.select(F.explode(cut_out("_text")).alias("w")).select("w.*").distinct())
    found = sorted(sampled(every, "kind", ["x", "y"], WINDOWS).collect(), key=lambda r: (r["kind"], bytes(r["x"]), bytes(r["y"])))
    x = np.concatenate([np.frombuffer(r["x"], np.int16).reshape(-1, WINDOW, SLOTS) for r in found] or [np.zeros((0, WINDOW, SLOTS), np.int16)])
    y = np.concatenate([np.frombuffer(r["y"], np.int8).reshape(-1, WINDOW) for r in found] or [np.zeros((0, WINDOW), np.int8)])
    return fit(x.astype(np.int64), y.astype(np.int64))


def scan(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """df and then found: an array of (kind, start, stop) in code points, stop exclusive, by start and then kind.

    What the patterns find is there as it is; of what the field finds, that which touches none of it, as kind "crf". Null and empty texts have none.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(field)  # its size is fixed: SLOTS times VALUES times 3 numbers

    @F.pandas_udf("array<struct<kind:string,start:int,stop:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([all_spans(t, shared.value) if t else [] for t in texts], dtype=object)

    return df.withColumn("found", spans(F.col(text_col)))


def all_spans(text: str, field: Field) -> list[dict]:
    base = [(start, stop, kind) for start, stop, kind, _ in base_spans(text)]
    starts, reach = [a for a, _, _ in base], []
    for _, stop, _ in base:
        reach.append(max(stop, reach[-1] if reach else 0))  # the furthest end of all that begin here or before
    data = text.encode("utf-8", "surrogatepass")
    found, at, byte = list(base), 0, 0
    for first, last in tagged(data, field):
        start = at + len(data[byte:first].decode("utf-8", "surrogatepass"))
        stop = start + len(data[first:last].decode("utf-8", "surrogatepass"))
        at, byte = stop, last
        k = bisect_left(starts, stop)
        if not k or reach[k - 1] <= start:
            found.append((start, stop, 3))
    return [{"kind": KINDS[k], "start": a, "stop": b} for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs)).select("doc_id", "found")
    joined = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("found", lambda s: s["kind"] != "crf"))
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


QUERIES = {"op8_secrets": op8_secrets}
ORACLES: dict[str, str] = {}
