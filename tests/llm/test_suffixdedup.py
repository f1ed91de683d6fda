import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import suffixdedup as S

SCHEMA = "doc_id long, text string, n_bytes int, spans string"


def brute(texts, span):
    """Kept bytes, removed bytes and number of removed runs of every text."""
    data = [(t or "").encode() for t in texts]
    found = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if found[d[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, span, **more):
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in enumerate(texts)], SCHEMA)
    found = S.remove_repeats(df, span=span, **more)
    assert found.columns == ["doc_id", "text", "n_bytes", "n_removed", "spans", "kept"]
    return [(r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found.orderBy("doc_id").collect()]


def planted(rng, n, span):
    """Random texts of few letters, with copies, near copies, passages that many share, repeats within a text and periodic stretches."""
    letters = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    shared, texts = [letters(rng.randint(span - 2, 3 * span)) for _ in range(4)], [None, "", "a", letters(span - 1), letters(span)]
    while len(texts) < n:
        kind, text = rng.random(), letters(rng.randint(0, 6 * span))
        if kind < 0.3 and texts[-1]:
            old = rng.choice([t for t in texts if t])
            at = rng.randrange(len(old))
            text = old[:at] + rng.choice(["", "x", letters(5)]) + old[at + rng.randint(0, 2) :]
        elif kind < 0.6:
            text = letters(rng.randint(0, 30)) + rng.choice(shared) + letters(rng.randint(0, 30)) + rng.choice(["", rng.choice(shared)])
        elif kind < 0.7:
            text += rng.choice(["ab", "q", "abc\n"]) * rng.randint(1, 2 * span) + letters(9)
        elif kind < 0.8:
            text = text + letters(3) + text
        texts.append(text)
    return texts + [texts[-1], texts[7], texts[7]]


@pytest.mark.parametrize(("span", "bucket", "piece"), [(24, 20_000, 1 << 20), (24, 1, 64), (13, 2, 1 << 20), (200, 20_000, 1000)])
def test_against_brute_force(spark, monkeypatch, span, bucket, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    texts = planted(random.Random(span + bucket), 120 if span < 100 else 60, span)
    assert run(spark, texts, span, bucket=bucket) == brute(texts, span)


def test_single_bytes_and_pairs(spark):
    texts = ["abc", "cd", "e", "", None, "fgfg"]
    for span in (1, 2, 3):
        assert run(spark, texts, span) == brute(texts, span)


def test_a_hot_text_and_a_long_one(spark):
    rng = random.Random(3)
    hot, long = "".join(rng.choice("abcdef ") for _ in range(300)), "".join(rng.choice("abcdefghij") for _ in range(300_000))
    texts = [hot] * 2000 + [f"{i} {hot[:250]} {i}" for i in range(500)] + [long, "q\n" * 20_000, long[1000:1300]]
    found = run(spark, texts, 200)
    assert found[0][1] == 300 and found[2000][1] == 253  # "0 " before the passage and " " after it are shared too
    assert [found[-3], found[-1]] == [brute([long, long[1000:1300]], 200)[i] for i in (0, 1)] and found[-2][1] == 40_000


def test_no_rows(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    found = [tuple(r) for r in S.op11_suffix_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert found == brute(texts, 200)
