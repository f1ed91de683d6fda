import random

import numpy as np

from quillon.llm import langid as L

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"
PARTS = {"en": ["th", "ing", "er", "wh", "ed"], "de": ["sch", "ung", "ei", "ich", "ver"], "fr": ["eau", "ou", "que", "é", "ai"], "es": ["ción", "mente", "ado", "ñ", "os"]}


def corpus(n, seed):
    rng = random.Random(seed)
    langs = list(PARTS)
    return [(i, " ".join("".join(rng.choice(PARTS[langs[i % 4]]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))), langs[i % 4]) for i in range(n)]


def test_families_then_languages(spark):
    rows = corpus(600, 1)
    extra = [(9000, None, "en"), (9001, "", "en"), (9002, "123 !? 45", "de"), (None, "the thing", "en"), (5, rows[5][1], rows[5][2]), (9003, "schungei " * 30000, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + extra], SCHEMA)
    model = L.learn(df.where("doc_id < 400"))
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    found = L.identify(df, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = found.collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.doc_id is not None and 400 <= r.doc_id < 9000]) > 0.97
    of = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert of[9000] == of[9001] == of[9002] == ("und", 0.0)
    assert of[9003][0] == "de"


def test_one_language_none_and_no_rows(spark):
    df = spark.createDataFrame([(1, "the thing", "en", None, None), (2, "other", None, None, None)], SCHEMA)
    assert [r.lang_pred for r in L.identify(df, L.learn(df)).collect()] == ["en", "en"]
    none = spark.createDataFrame([(1, "the thing", None, None, None)], SCHEMA)
    assert L.learn(none) is None
    assert L.identify(none, None).first()["lang_pred"] == "und"
    assert L.identify(none.limit(0), L.learn(df)).count() == 0


def test_features_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    from quillon.llm import linear

    data = ("schungei  ÄÖ" * 3 + "x" * 40 + "  the. thing\n" * 5 + "é").encode()
    grams = linear.Grams()
    weights = np.random.default_rng(0).normal(size=(grams.size, 3))
    whole, margins = grams.vector(data), grams.margins(data, weights)
    for size in (1, 2, 3, 7, 16, 100, len(data)):
        monkeypatch.setattr(linear, "CHUNK", size)
        assert np.array_equal(grams.vector(data), whole) and np.allclose(grams.margins(data, weights), margins)
        assert np.array_equal(grams.vector(b""), grams.vector(b"  "))


def test_votes_are_those_of_the_machines():
    """The prediction, against a plain count of one-versus-one votes in the family with the largest margin."""
    rng = np.random.default_rng(1)
    languages = ["da", "de", "en", "es", "fr", "xx"]
    families = sorted({L.family(x) for x in languages})
    pairs = L.pairs_of(languages)
    from quillon.llm.linear import Grams

    grams = Grams()
    weights, bias = rng.normal(size=(grams.size, len(families) + len(pairs))), rng.normal(size=len(families) + len(pairs)) * 0.01
    model = L.Model(languages, weights, bias)
    for k in range(60):
        text = bytes(rng.integers(97, 123, 30).astype(np.uint8))
        m = grams.vector(text) @ weights + bias
        best = families[int(np.argmax(m[: len(families)]))]
        members = [x for x in languages if L.family(x) == best]
        votes = {x: sum((a == x and s >= 0) or (b == x and s < 0) for (a, b), s in zip(pairs, m[len(families) :], strict=True)) for x in members}
        got, score = model.predict(text)
        assert votes[got] == max(votes.values()) and 0 <= score <= 1
