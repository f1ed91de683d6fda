import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm import periodic as P

SCHEMA = "doc_id long, text string, n_words int, runs string"


def brute(words, least=24, times=3):
    """Runs (start, length, period) by comparing every word with the one a period further on."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                found.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]


def periodic_texts(rng, n):
    texts = [None, "", "  \n", "a", "a " * 23, "a " * 24, "a b " * 11 + "a", "a b c d e f g h i " * 3, "a b c d e f g h " * 3 + "a"]
    while len(texts) < n:
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abcde") for _ in range(rng.randint(1, 12))] * rng.randint(2, 9)
            at = rng.randint(0, len(words))
            words[at:at] = unit[: len(unit) - rng.randint(0, 3)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    return texts


@pytest.mark.parametrize(("least", "times"), [(24, 3), (1, 2), (6, 3), (10, 5)])
def test_runs_against_brute_force(spark, least, times):
    texts = periodic_texts(random.Random(least), 300)
    found = P.word_runs(spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], SCHEMA), least=least, times=times)
    assert found.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    for r in found.collect():
        words = (texts[r.doc_id] or "").split()
        runs = brute(words, least, times)
        assert (r.text, r.n_words, [tuple(x) for x in r.runs]) == (texts[r.doc_id], len(words), runs)
        assert r.collapsed == " ".join(collapsed(words, runs))


def test_fibonacci_words_and_long_texts():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    for words in (b, [0] * 500, [0, 1] * 300 + [0, 2] * 40):
        one = np.array(words)
        first, length, period = P.runs_of(one, np.array([len(one)]), 1, 2)
        assert list(zip(first.tolist(), length.tolist(), period.tolist(), strict=True)) == brute(words, 1, 2)
    rng = np.random.default_rng(1)
    long = np.concatenate([rng.integers(0, 9, 50_000), np.tile(rng.integers(0, 9, 5_000), 5)])
    first, length, period = P.runs_of(long, np.array([len(long)]))
    assert (5_000, 25_000) in {(p, k - k % 5000) for p, k in zip(period.tolist(), length.tolist(), strict=True)}


def test_no_rows(spark):
    assert P.word_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in P.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(rows)
    sha, some = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for i, text in rows:
        words, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        words, n, g = [w.decode() for w in words], len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        some += len(runs)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        assert tuple(found[i]) == (i, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(collapsed(words, runs))))
    assert some > 20
