"""Similar sequences against a plain alignment of all pairs."""

import random

import numpy as np
import pytest

from quillon.operators import homology as H


def plain(q, t):
    """The score and the matches of the best local alignment, by the whole table."""
    best, table = (0, 0), {}
    for i in range(len(q)):
        for j in range(len(t)):
            d = table.get((i - 1, j - 1), (0, 0))
            cell = max((d[0] + (H.MATCH if q[i] == t[j] else H.OTHER), d[1] + (q[i] == t[j])), *[(a - H.GAP, m) for a, m in (table.get((i - 1, j), (0, 0)), table.get((i, j - 1), (0, 0)))])
            if cell[0] > 0:
                table[i, j] = cell
                best = max(best, cell)
    return best


def mutated(rng, seq, share):
    out = []
    for c in seq:
        x = rng.random()
        if x > share:
            out.append(c)
        elif x > share / 3:
            out.append(rng.choice("ACDEFGHIKLMNPQRSTVWY"))
        elif x > share / 6:
            out += [c, rng.choice("ACDEFGHIKLMNPQRSTVWY")]
    return "".join(out)


def families(rng, n, size, share=0.3):
    out = []
    for _ in range(n):
        root = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(size))
        out += [mutated(rng, root, share) for _ in range(3)]
    return out


def test_alignments():
    rng = random.Random(1)
    pairs = [(rng.choice(s), rng.choice(s)) for s in [families(rng, 2, 25) for _ in range(40)]] + [("A", "A"), ("A", "C"), ("AAAA", "AA"), ("ACDEF", "ACDXEF"), ("WWACDEFGHIKL", "ACDEFHIKL")]
    q, t = [p[0] for p in pairs], [p[1] for p in pairs]
    found = H.aligned(q, t, np.array([1 - len(x) for x in q]), np.array([len(x) - 1 for x in t]))
    for k, (a, b) in enumerate(pairs):
        assert (found["score"][k], found["matches"][k]) == plain(a, b), (a, b)
        if found["score"][k]:
            spans = [found[f"{s}_last"][k] - found[f"{s}_first"][k] + 1 for s in "qt"]
            gaps = 2 * found["columns"][k] - sum(spans)
            assert max(spans) <= found["columns"][k] <= sum(spans) and found["score"][k] == H.MATCH * found["matches"][k] + H.OTHER * (found["columns"][k] - gaps - found["matches"][k]) - H.GAP * gaps


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(5)
    rows = [(i, s, "x", 1.0) for i, s in enumerate(families(rng, 40, 90) + ["A" * 60, "A" * 50 + "C" * 20, "", None, "ACD"])] + [(None, "ACDEFGHIKL" * 5, "x", 1.0)]
    return spark.createDataFrame(rows, "id long, seq string, target string, bits double")


def test_search_finds_what_exact_does(sequences):
    queries = sequences.where("id % 3 = 0 or id is null")
    exact = {(r.query, r.target): r for r in H.search(queries, sequences, "id", "seq", exact=True).collect()}
    fast = {(r.query, r.target): r for r in H.search(queries, sequences, "id", "seq").collect()}
    assert len(exact) > 60 and set(fast) <= set(exact) and len(fast) >= 0.9 * len(exact)
    for key, r in fast.items():
        assert r.bits <= exact[key].bits + 1e-9 and r.pident >= 40 and min(r.qcov, r.tcov) >= 0.8
    assert sum(fast[k].bits == exact[k].bits for k in fast) >= 0.95 * len(fast)
    own = fast["0", "0"]
    assert (own.pident, own.qcov, own.tcov) == (100.0, 1.0, 1.0) and own.evalue < 1e-9


def test_statistics():
    x = H.decay()
    assert abs(np.exp(5 * x) / 20 + np.exp(-4 * x) * 19 / 20 - 1) < 1e-9 and x > 0.1


def test_no_sequences(spark, sequences):
    empty = spark.createDataFrame([], "id long, seq string")
    assert H.search(empty, sequences, "id", "seq").count() == 0 and H.search(sequences, empty, "id", "seq").count() == 0


def test_query_against_exact(spark):
    from quillon.plans import molecule_queries as Q

    s = Q._sequences(spark, "/root/testdata/sf0.001")
    exact = {(r.query, r.target) for r in H.search(s.where("c_custkey % 100 = 0"), s, "c_custkey", "seq", exact=True).collect()}
    found = {(r.query, r.target) for r in Q.homology_hits(spark, "/root/testdata/sf0.001").collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) and len(exact) >= 3


def test_places_of_words_are_not_broadcast(spark):
    """The planner takes exploded places for a small table; they are joined by shuffles all the same."""
    df = spark.createDataFrame([("a", "ACDEFGHIKLMNPQRSTVWY"), ("b", "ACDEFGHIKLMNPQRSTVWW")], "id string, seq string")
    plan = H.candidates(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [seed" in plan and "BroadcastHashJoin [seed" not in plan


def test_scores_are_those_of_alignments():
    """Bands of all widths, beside and within the sequences; the plain scores and the whole alignments agree."""
    rng = random.Random(7)
    texts = families(rng, 30, 40) + ["A" * 50, "AC" * 20, "A", "ACDEFGHIKL" * 4]
    pairs = [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(400)]
    q, t = [texts[a] for a, _ in pairs], [texts[b] for _, b in pairs]
    low = np.array([rng.randint(1 - len(x), len(y) - 1) for x, y in zip(q, t)])
    high = np.array([rng.randint(a, len(y) - 1) for a, y in zip(low, t)])
    whole, letters = H.aligned(q, t, low, high), [H._letters(s) for s in (q, t)]
    sizes = [np.diff(at) for _, at in letters]
    found = H.scores(letters[0][0], letters[0][1][:-1], sizes[0], letters[1][0], letters[1][1][:-1], sizes[1], low, high)
    for name, values in found.items():
        assert (values == whole[name]).all(), name


@pytest.mark.parametrize("met", [1 << 20, 300, 1])
def test_blocks_find_the_candidates(spark, monkeypatch, met):
    """Within two blocks the pairs and diagonals are those of the table of places, with frequent words, repeated names, other letters and few places held at once."""
    monkeypatch.setattr(H, "MET", met)
    rng = random.Random(3)
    texts = families(rng, 12, 50) + ["A" * 40, "A" * 30 + "C" * 9, "ACDE", "AC", "日本語" * 5, "x日本語y\0\0日本語", "\0" * 9, "ACDEFGHIKLMNPQ" * 3]
    names = sorted([f"s{i % (len(texts) - 2)}" for i in range(len(texts))])
    rng.shuffle(texts)
    df = spark.createDataFrame(list(zip(names, texts)), "id string, seq string")
    wanted = {(r.query, r.target): (r.low, r.high) for r in H.candidates(df, df).collect()}
    words = [x[i : i + H.WORD] for x in texts for i in range(len(x) - H.WORD + 1)]
    often = [w for w in set(words) if words.count(w) * H.FREQUENT > len(words)]
    ids = sorted(set(names))
    number = np.array([ids.index(x) for x in names])
    found = [(ids[a], ids[b], low, high) for part in H._near(texts, texts, number, number, often, H.WORD, H.SEEDS, H.BAND) for a, b, low, high in zip(*part)]
    assert len(found) == len(wanted) > 60 and {(a, b): (low, high) for a, b, low, high in found} == wanted


def test_places_that_meet_are_not_shuffled(spark):
    """What a search moves are sequences, in blocks; no row is made of two places that meet."""
    df = spark.createDataFrame([(f"s{i}", "ACDEFGHIKLMNPQRSTVWY" * 3) for i in range(5)], "id string, seq string")
    found = H.search(df, df, "id", "seq")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FlatMapCoGroups" in plan and found.count() == 25
