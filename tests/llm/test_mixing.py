import struct

import numpy as np
import pytest
import xxhash

from quillon.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, n_chars long, size string, start string"


def make(rows):
    return [(i, t, s, None, "x", "y") for i, t, s in rows]


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.integers(0, 200))), ["a", "b", "B", "ü", None][int(rng.integers(0, 5)) if i % 3 else 0]) for i in range(400)]
    return rows + [(900, None, "a"), (901, "", "b"), (902, "word " * 20000, "b"), (None, "one two", "a"), (1, rows[1][1], rows[1][2])]


def test_targets():
    assert M.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert M.targets([10, 1000]) == pytest.approx([20, 1495])
    assert sum(M.targets([5, 0, 70, 3])) == pytest.approx(1.5 * 78)


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        got = M.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(got) == list(range(n))
    assert not (M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)) == M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 2))).all()


def test_draws_come_to_the_slots():
    counts = M.draw([1000, 10, 0, 333], shards=7)
    assert counts.sum(axis=0).tolist() == [1000, 10, 0, 333]
    assert np.ptp(counts.sum(axis=1)) <= 1
    assert len(set(counts[:, 0])) > 1


def test_the_mix(spark):
    rows = corpus()
    df = spark.createDataFrame(make(rows), SCHEMA)
    found = M.mixed_words(df).toPandas()
    again = M.mixed_words(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert found.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    assert sorted(found["size"]) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert (found["taken"] <= 2 * found["size"]).all()
    for (size, target), part in found.groupby(["source_size", "target"]):
        assert part["size"].sum() == size
        assert abs(part["taken"].sum() - target) <= M.BLOCK


def plain_taken(rows):
    """(id, size, taken) in plain loops: the order of a source, its blocks, and how often each slot's block is taken."""
    def spark_hash(i):
        h = xxhash.xxh64_intdigest(struct.pack("<i", M.SEED), 42)
        return h if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), h)

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    docs = [(i, len((t or "").split()), signed(xxhash.xxh64_intdigest((t or "").encode(), 42)) if t is not None else 42, s) for i, t, s in rows]
    sizes = [sum(n for _, n, _, s in docs if s == x) for x in sources]
    blocks = [-(-n // M.BLOCK) for n in sizes]
    slots = [round(t * b / n) if n else 0 for t, b, n in zip(M.targets(sizes), blocks, sizes, strict=True)]
    totals = M.draw(slots).sum(axis=0)
    out = []
    for k, x in enumerate(sources):
        order = sorted((d for d in docs if d[3] == x), key=lambda d: (signed(spark_hash(d[0])) % M.GROUPS, d[0] is not None, d[0] or 0, d[1], d[2]))
        times = [0] * blocks[k]
        for slot in range(int(totals[k])):
            turn, place = divmod(slot, blocks[k])
            key = np.array([(k << 32) ^ (turn << 8) ^ M.SEED], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            times[int(M.permuted(np.array([place]), np.array([blocks[k]]), key)[0])] += 1
        at = 0
        for i, n, _, _ in order:
            out.append((i, n, sum(times[w // M.BLOCK] for w in range(at, at + n))))
            at += n
    return out


def test_against_a_plain_mix(spark):
    rows = [(i, " ".join(f"w{k}" for k in range((i * 37) % 150)), ["a", "b", None][i % 3]) for i in range(60)] + [(3, "other text of an id", "a"), (3, "third text " * 40, "a"), (None, "no name " * 30, None), (7, None, "b")]
    found = M.mixed_words(spark.createDataFrame(make(rows), SCHEMA)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.size, r.taken) for r in found), key=key) == sorted(plain_taken(rows), key=key)


def test_draws_are_multinomial():
    """Shares of a source over the shards vary as a multinomial draw does, and huge counts stay exact."""
    counts = M.draw([600_000, 300_000, 100_000], shards=400)
    assert abs(counts[:399, 0].std() / np.sqrt(2500 * 0.6 * 0.4) - 1) < 0.15
    big = M.draw([3 * 10**12, 10**12, 7], shards=5)
    assert big.sum(axis=0).tolist() == [3 * 10**12, 10**12, 7] and (big >= 0).all() and np.ptp(big.sum(axis=1)) <= 1


def test_slots_are_laid_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN", 4)
    monkeypatch.setattr(M, "TASK", 16)
    plan = M.Mix(spark.createDataFrame(make(corpus()), SCHEMA))
    slots = plan.slots()
    assert plan.n_slots == slots.count() and slots.rdd.getNumPartitions() >= plan.n_slots // 16


def test_mixed_texts_hold_the_taken_words(spark):
    rows = corpus(1)
    df = spark.createDataFrame(make(rows), SCHEMA)
    texts = M.mix(df)
    assert texts.columns == df.columns
    got = {}
    originals = {i: (t or "").split() for i, t, _ in rows}
    for r in texts.collect():
        words = r.text.split()
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words)
        it = iter(originals[r.doc_id])
        assert all(w in it for w in words)  # in the text's order
    taken = M.mixed_words(df).groupBy("doc_id").sum("taken").collect()
    assert got == {r[0]: r[1] for r in taken if r[1]}


def test_no_words_and_no_rows(spark):
    assert M.mixed_words(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in M.mixed_words(spark.createDataFrame(make([(1, None, "a"), (2, " ", None)]), SCHEMA)).collect()] == [0, 0]
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def drawn(rows):
    """The slots by shard and source that a mix of the rows draws, and the sources."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == x) for x in sources]
    blocks = [-(-n // M.BLOCK) for n in sizes]
    return M.draw([round(t * b / n) if n else 0 for t, b, n in zip(M.targets(sizes), blocks, sizes, strict=True)]), sources


def test_blocks_follow_the_draw(spark):
    rows = corpus(2)
    df = spark.createDataFrame(make(rows), SCHEMA)
    found = M.mixed_blocks(df).toPandas()
    counts, sources = drawn(rows)
    of = {s: k for k, s in enumerate(sources)}
    got = np.zeros_like(counts)
    np.add.at(got, (found["shard"], [of[s if isinstance(s, str) else None] for s in found["source"]]), 1)
    assert (got == counts).all() and len({tuple(r) for r in counts}) > 1
    for _, part in found.groupby("shard"):
        assert sorted(part["place"]) == list(range(len(part)))
    mixed = found[found["shard"] == 0].sort_values("place")["source"].fillna("-").tolist()
    assert sum(a != b for a, b in zip(mixed, mixed[1:])) > len(set(mixed))  # sources take turns  # noqa: B905
    words = lambda k, s: sum(len(t.split()) for t in found[(found["pass"] == k) & ((found["source"] == s) | (found["source"].isna() & (s is None)))]["text"])
    full = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in sources}
    assert [s for s in sources if words(0, s) == full[s]]  # a source that is used once or more: all of its words, each once
    sizes = found["text"].str.split().str.len()
    assert sizes.max() == M.BLOCK and (sizes == M.BLOCK).mean() > 0.9


def test_another_draw_is_another_mix(spark, monkeypatch):
    df = spark.createDataFrame(make(corpus(3)), SCHEMA)
    before = M.mixed_words(df).select("doc_id", "size", "taken", "first_shard", "last_shard").toPandas()
    assert before["first_shard"].nunique() > 30 and before.loc[before["taken"] == 0, "first_shard"].isna().all() and before.loc[before["taken"] > 0, "first_shard"].notna().all()
    monkeypatch.setattr(M, "draw", lambda slots, shards=M.SHARDS, seed=M.SEED: np.array([slots] + [[0] * len(slots)] * (shards - 1), np.int64))
    after = M.mixed_words(df).select("doc_id", "size", "taken", "first_shard", "last_shard").toPandas()
    assert after["last_shard"].max() == 0 and sorted(after["taken"]) == sorted(before["taken"])
