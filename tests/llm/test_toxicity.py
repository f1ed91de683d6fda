import random
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import toxicity as T

SCHEMA = "doc_id long, text string, score double, _terms string"


def test_pairs_of_terms_tell_what_single_ones_do_not():
    """Toxic only if an insult meets a group; either alone is harmless and as frequent."""
    rng = random.Random(0)
    rows, y = [], []
    for k in range(3000):
        insult, group = k % 2, (k // 2) % 2
        rows.append(np.array(sorted({1} | ({2} if insult else {3}) | ({4} if group else {5}) | {rng.randint(100, 4000) for _ in range(10)})))
        y.append(float(insult == group))  # of no use to a sum of weights
    model = T.fit(rows[:2000], np.array(y[:2000]), 0.5)
    right = [(T.raw_score(model, r) >= 0) == (t == 1) for r, t in zip(rows[2000:], y[2000:], strict=True)]
    assert np.mean(right) > 0.9


def test_rare_pairs_among_many_frequent_terms():
    """Both terms of the pair are rarer than a thousand others, and neither tells alone."""
    rng = random.Random(1)
    rows, y = [], []
    for k in range(3000):
        a, b = rng.random() < 0.1, rng.random() < 0.1
        if rng.random() < 0.1:
            a = b = True
        rows.append(np.array(sorted(({7} if a else set()) | ({8} if b else set()) | set(rng.sample(range(100, 1100), 250)))))
        y.append(float(a and b))
    y = np.array(y)
    model = T.fit(rows[:2000], y[:2000], float(y.mean()))
    place = model[1]
    assert place[7] and place[8]
    right = [(T.raw_score(model, r) >= 0) == (t == 1) for r, t in zip(rows[2000:], y[2000:], strict=True)]
    assert np.mean(right) > 0.97


def test_the_sum_over_pairs_is_that_of_explicit_pairs():
    rng = np.random.default_rng(4)
    place = np.zeros(50, np.int32)
    place[5:30] = 1 + np.arange(25)
    model = (0.3, place, np.append(0, rng.normal(size=25)), np.vstack([np.zeros(4), rng.normal(size=(25, 4))]))
    ids = np.arange(0, 40, 3)
    own = [place[i] for i in ids if place[i]]
    plain = 0.3 + sum(model[2][i] for i in own) + sum(model[3][i] @ model[3][j] for k, i in enumerate(own) for j in own[k + 1 :])
    assert abs(T.raw_score(model, ids) - plain) < 1e-9


def test_terms_are_words_and_their_beginnings(spark):
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42)) % T.BUCKETS
    start = lambda w, k: signed(xxhash.xxh64_intdigest(w[:k].encode(), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))) % T.BUCKETS
    got = spark.createDataFrame([("Vile vile, Über7abcdefgh x",), (None,), ("",)], "t string").select(T.terms(F.col("t")).alias("x")).collect()
    long_ = "abcdefgh"
    assert set(got[0].x) == {word("vile"), word("über"), word(long_), word("x"), start(long_, 5), start(long_, 7)}
    assert got[1].x == got[2].x == []


def test_candidates_hold_all_that_fit_may_choose():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 300, 40)) for _ in range(400)]
    y = np.array([float(10 in r and 20 in r or 30 in r) for r in rows])
    flat = np.concatenate(rows)
    has, has1 = np.bincount(flat, minlength=T.BUCKETS), np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), minlength=T.BUCKETS)
    may = T.candidates(has, has1, len(y), y.sum())
    whole, part = T.fit(rows, y, 0.3), T.fit([r[may[r]] for r in rows], y, 0.3)
    assert all(np.array_equal(a, b) for a, b in zip(whole, part, strict=True))


def test_planted_words_are_learned(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    bad = ["vilewort", "nastling", "grubface"]
    rows = []
    for i in range(800):
        words = [word() for _ in range(60)]
        if i % 5 == 0:
            words[rng.randint(0, 59)] = rng.choice(bad).upper()
        rows.append((i, " ".join(words), None, None))
    df = spark.createDataFrame(rows + [(9001, None, None, None), (9002, "", None, None), (None, "x", None, None), (0, rows[0][1], None, None), (9003, "word " * 30000, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "t") for i in range(600)] + [(None, 1, "t"), (3, None, "t"), (10**6, 1, "t")], "doc_id long, toxic int, text string")
    found = T.score(df, T.learn(df, labels)).collect()
    assert len(found) == 805 and all(0 <= r.score <= 1 for r in found)
    of = {r.doc_id: r.score >= 0.5 for r in found}
    assert np.mean([of[i] == (i % 5 == 0) for i in range(600, 800)]) > 0.97
    assert not of[9001] and not of[9002] and not of[9003]


def test_equal_rows_and_many_texts_of_one_id_count(spark):
    """A label is not lost where its id is repeated, and a repeated row is learned from once."""
    rows = [(1, f"vilewort number {i}") for i in range(50)] + [(2, "quiet day")] * 200 + [(i, f"quiet day {i}") for i in range(3, 60)]
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.learn(df, labels, sample=60)
    got = {r.text: r.score for r in T.score(spark.createDataFrame([(9, "vilewort"), (9, "quiet")], "doc_id long, text string"), model).collect()}
    assert got["vilewort"] > 0.5 > got["quiet"]


def test_no_rows_and_no_labels(spark):
    df, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    model = T.learn(df, labels)
    assert T.score(df, model).count() == 0
    assert T.score(spark.createDataFrame([(1, "a", None, None)], SCHEMA), model).first()["score"] < 0.5
