import numpy as np
import xxhash

from quillon.llm import linededup as L

SCHEMA = "doc_id long, text string, n_lines int, covered string"


def hashed(text):
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def brute(rows, span=3):
    """rows: (id, text); the texts that are left. Texts of one id are documents of their own, in the order of their hashes."""
    firsts, out = {}, []
    table = {}
    for i, text in rows:
        if i is not None and text is not None:
            lines = text.split("\n")
            full = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
            table[i, hashed(text), text] = (lines, [(full[k][0], tuple(x for _, x in full[k : k + span]), [n for n, _ in full[k : k + span]]) for k in range(max(min(1, len(full)), len(full) - span + 1))])
    for i in sorted(table):
        for at, key, _ in table[i][1]:
            firsts.setdefault(key, (i, at))
    for i, text in rows:
        if i is None or text is None:
            out.append((i, text))
            continue
        name = (i, hashed(text), text)
        gone = {n for at, key, ns in table[name][1] if firsts[key] != (name, at) for n in ns}
        out.append((i, "\n".join(x for k, x in enumerate(table[name][0]) if k not in gone)))
    return out


def test_against_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "a\nb\nc"), (3, " a \nb\r\n\nc\nd"), (4, "x\n" * 7), (5, "\n\n\n"), (6, "a\nb"), (None, "a\nb\nc"), (7, "a\nb\nc\na\nb\nc\na"), (8, "q\n" * 30000)]
    rows += [(i, "\n".join(rng.choice("abcdef") for _ in range(rng.randint(0, 12)))) for i in range(20, 90)]
    rows += [rows[-1], (8, "other\ntext"), (8, "q\nq\nq"), (91, "one line"), (92, "one line"), (93, "two\nlines"), (94, "two\nlines\n"), (95, "lines\ntwo"), (96, "one line\nand more")]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], SCHEMA)
    found = L.dedup_lines(df)
    assert found.columns == ["doc_id", "text", "covered", "n_lines", "n_removed"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in found.collect()], key=key) == sorted(brute(rows), key=key)


def test_no_rows(spark):
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_shared_by_different_texts(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (2, "u v w x\ny z\nq r\ns t")]
    found = {(r.doc_id, r.n_removed, r.text) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 0, "a\nb\nc\nd"), (2, 4, ""), (2, 0, "u v w x\ny z\nq r\ns t")}


def test_a_hot_window(spark):
    rows = [(i, f"k{i}\nx\ny\nz\nl{i}") for i in range(3000)]
    found = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_removed for r in found] == [0] + [3] * 2999
