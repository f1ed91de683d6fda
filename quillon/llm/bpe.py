"""Byte-level BPE by tree reduction over the bytes of each pretoken.

Encodings of byte strings form a monoid: the tokens of a joined string follow from the tokens of its halves. A half is
encoded recursively; two neighbours are joined by encoding a window around their border anew, and the window grows until
the token at each of its ends is compatible with the token outside. Two tokens are compatible if encoding their joined
bytes gives the two of them again. That ends provably: take a token sequence whose neighbours are all compatible, and
suppose that the merges of the joined string cross a border. Up to the first such merge every token's bytes have merged
as they do alone, lowest rank first and leftmost first, so the same merge would be the next one for these two tokens
alone, which contradicts their being compatible. So the tokens outside a window with compatible ends stay as they are.

Decoding is the same reduction with concatenation.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small_batches, table

#: Entries of a worker's caches of pretokens, windows and token pairs; a full cache is emptied.
CACHE = 300_000
#: Strings up to this many bytes are kept in the cache.
KEPT = 8
#: Windows up to this many bytes are merged by plain scanning, longer ones with a heap.
SHORT = 48


def read_ranks(text: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of the token's bytes, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


class TreeBpe:
    """Encodes byte strings by ranks. The caches are bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[bytes, list[int]] = {}
        self.pairs: dict[int, list[int]] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Tokens of a window: merges the lowest-ranked neighbours, leftmost first, until none is left."""
        ranks, n = self.ranks, len(data)
        if n <= SHORT:
            parts = [data[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    rank = ranks.get(parts[i] + parts[i + 1])
                    if rank is not None and (best is None or rank < best):
                        best, at = rank, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0 or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two has merged since
            gone = end[i]
            end[i], end[gone] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def pair(self, a: int, b: int) -> list[int]:
        """Tokens of two tokens' joined bytes."""
        key = a << 32 | b
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._merge(self.tokens[a] + self.tokens[b])
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens, side by side, stay as they are."""
        return self.pair(a, b) == [a, b]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Tokens of the joined string, from those of its two parts, neither empty."""
        window = self.pair(a[-1], b[0])
        if window == [a[-1], b[0]]:
            return a + b
        i, j = len(a) - 1, 1  # a[:i] and b[j:] are left as they are
        step_a = step_b = 1
        while True:
            stable_a = i == 0 or self.compatible(a[i - 1], window[0])
            stable_b = j == len(b) or self.compatible(window[-1], b[j])
            if stable_a and stable_b:
                return a[:i] + window + b[j:]
            if not stable_a:
                i, step_a = max(0, i - step_a), 2 * step_a
            if not stable_b:
                j, step_b = min(len(b), j + step_b), 2 * step_b
            window = self._merge(b"".join([self.tokens[t] for t in a[i:] + b[:j]]))

    def tree(self, data: bytes) -> list[int]:
        """Tokens by halves, down to strings that are a token of their own."""
        if (found := self.known.get(data)) is not None:
            return found
        rank = self.ranks.get(data)
        if rank is not None and (len(data) == 1 or self._merge(data) == [rank]):
            found = [rank]
        else:
            half = len(data) // 2
            found = self.join(self.tree(data[:half]), self.tree(data[half:]))
        if len(data) <= KEPT:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[data] = found
        return found

    def encode(self, data: bytes) -> list[int]:
        """A pretoken that is in the vocabulary is one token; any other goes through the tree."""
        rank = self.ranks.get(data)
        return [rank] if rank is not None else self.tree(data) if data else []

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenates up the tree."""
        if len(ids) <= 4096:
            tokens = self.tokens
            return b"".join([tokens[i] for i in ids.tolist()])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Words(dict):
    """Packed ids of pretokens, found once for each."""

    def __init__(self, bpe: TreeBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = np.asarray(self.bpe.encode(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        return ids


_workers: dict[int, TreeBpe] = {}


def _worker(vocabulary: bytes) -> TreeBpe:
    """This process's encoder for a vocabulary."""
    key = hash(vocabulary)
    if key not in _workers:
        _workers.clear()
        _workers[key] = TreeBpe(read_ranks(vocabulary))
    return _workers[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read once by the driver and sent to the workers: some hundred kilobytes, whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_column(df: DataFrame, text: str, path: str, pattern: str) -> Column:
    """Token ids of a text column, as little-endian unsigned 32-bit integers; a null text has none."""
    shared = _vocabulary(df, path)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        words, split = _Words(_worker(shared.value)), regex.compile(pattern).findall
        for texts in batches:
            yield pd.Series([b"".join([words[w] for w in split(t)]) if t else b"" for t in texts], dtype=object)

    return encode(F.col(text))


def decode_column(df: DataFrame, ids: str, path: str) -> Column:
    """The bytes of a column of packed token ids; null ids have none."""
    shared = _vocabulary(df, path)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _worker(shared.value)
        for packed in batches:
            yield pd.Series([bpe.decode(np.frombuffer(p, "<u4")) if p else b"" for p in packed], dtype=object)

    return decode(F.col(ids))


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ids (packed token ids) and decoded (the bytes they stand for).

    No special tokens. Null and empty texts have no ids and decode to no bytes; every row of the input gives one row, repeated rows and
    null ids of documents too; other columns are left out.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    encoded = texts.select(F.col(id_col), encode_column(texts, "_text", path, pattern).alias("ids"))
    return encoded.withColumn("decoded", decode_column(encoded, "ids", path))


def digest(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the ids and the decoded bytes come to, in columns that are easy to compare."""
    return coded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES: dict[str, str] = {}
