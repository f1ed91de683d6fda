import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash as S


def test_the_codes_cover():
    prints = np.random.default_rng(0).integers(0, 2**64, 3000, dtype=np.uint64)
    own, near = S.anchors(prints)
    assert np.bitwise_count(own ^ prints).max() <= 8
    assert (S.anchors(own)[0] == own).all()
    for bit in (0, 22, 23, 46, 61, 63):
        assert (S.anchors(prints ^ np.uint64(1 << bit))[0] == near[:, bit]).all()


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_are_those_of_spark(spark):
    text = "Ä one TWO\tthree\x0bfour é five six"
    assert S.fingerprint(text.encode()) == plain(text)
    h = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert h % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(0, None, "a", 1), (1, "", "a", 1), (2, " \t\n", None, 1), (3, "one", None, None), (4, "ONE", None, None), (5, "one two", None, None), (6, "word " * 30000, None, None)]
    for i in range(10, 60):
        rows.append((i, " ".join(rng.choice(words, 120)), None, None))
        rows.append((i + 100, rows[-1][1].replace("w7", "w8"), None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    found = S.near_duplicates(df).collect()
    prints = {r[0]: plain(r[1]) for r in rows}
    assert {r.doc_id: r.fp % 2**64 for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == brute(prints)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(prints).values()))


def test_links_of_chains_and_dense_groups(spark):
    """Fingerprints given directly: chains at two bits, and many that meet at one anchor."""
    rng = np.random.default_rng(5)
    start = int(rng.integers(0, 2**62))
    prints = {0: start}
    for i in range(1, 12):
        prints[i] = prints[i - 1] ^ (1 << (2 * i)) ^ (1 << (2 * i + 1))
    base = int(rng.integers(0, 2**62))
    for i in range(100, 700):
        bits = rng.choice(64, 3, replace=False)
        prints[i] = base ^ sum(1 << int(b) for b in bits)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    distinct = {signed(v): min(i for i in prints if prints[i] == v) for v in prints.values()}
    df = spark.createDataFrame([(fp,) for fp in distinct], "fp long")
    edges = S.linked(df).collect()
    assert all(bin((r.fp % 2**64) ^ (r.to % 2**64)).count("1") <= 2 for r in edges)
    root = {fp: fp for fp in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        root[find(r.fp)] = find(r.to)
    expected = brute({i: fp % 2**64 for fp, i in distinct.items()})
    groups = {}
    for fp, i in distinct.items():
        groups.setdefault(find(fp), set()).add(i)
    wanted = {}
    for i, c in expected.items():
        wanted.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_repeated_rows_null_ids_no_rows(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(2, "a b c d"), (2, "a b c d"), (1, "x y z w"), (None, "a b c d")], schema)
    assert sorted((r.doc_id or 0, r.component_id) for r in S.near_duplicates(df).collect()) == [(0, 2), (1, 1), (2, 2), (2, 2)]
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == [1, 2]
    shared = spark.createDataFrame([(2, "a b c d"), (2, "one two three four five"), (None, "no name at all here"), (None, "no name at all here"), (None, "quite another text now"), (3, "a b c d"), (3, None), (4, "")], schema)
    kept = sorted(((r.doc_id or 0, r.text) for r in S.keep_one(shared).collect()), key=str)
    assert kept == sorted([(2, "a b c d"), (2, "one two three four five"), (0, "no name at all here"), (0, "quite another text now"), (3, None)], key=str)
    empty = spark.createDataFrame([], schema)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
