import hashlib

import numpy as np

from quillon.llm import vectorcodes as V


def brute(rows, parts, entries, rounds):
    """rows: (id, vector), sound and of one length. Python's integers, a vector at a time."""
    ints = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows]
    first = [v for _, v in sorted(ints)[:entries]]
    cuts = V.bounds(len(first[0]), parts)
    books = [[v[a:b] for v in first] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
    part = lambda v, p: v[cuts[p] : cuts[p + 1]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    best = lambda v, p: min(range(len(first)), key=lambda j: (far(part(v, p), books[p][j]), j))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v in ints:
                of.setdefault(best(v, p), []).append(part(v, p))
            for j, xs in of.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = {i: ("".join(f"{best(v, p):02x}" for p in range(parts)), sum(far(part(v, p), books[p][best(v, p)]) for p in range(parts))) for i, v in ints}
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 10)]) for i in range(150)] + [(200, [0.0] * 10), (201, [0.0] * 10), (202, [-0.0] * 10)]
    bad = [(500, None, 1), (501, [float("nan")] + [0.0] * 9, 1), (502, [float("inf")] * 10, 2), (503, [None] + [0.0] * 9, 3), (504, [], 1), (505, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(i, v, i % 3 or None, "old") for i, v in rows] + [(*b, "old") for b in bad], SCHEMA).repartition(5)
    for parts, entries in ((4, 16), (3, 300), (1, 1)):
        coded, books = V.compress(df, parts=parts, entries=entries, rounds=3)
        assert coded.columns == ["vec_id", "label", "code", "error"]
        expected, digest = brute(rows, parts, entries, 3)
        assert {r.vec_id: (r.code if entries <= 256 else None, r.error) for r in coded.collect()} == {i: (c if entries <= 256 else None, e) for i, (c, e) in expected.items()}
        assert V.sha256_of(books) == digest


def test_null_ids_repeated_rows_and_large_numbers(spark):
    rows = [(None, [1e38, 0.0, 0.0, 0.0]), (1, [-1e38, 1.0, 2.0, 3.0]), (1, [-1e38, 1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0, -1e-9])]
    coded, books = V.compress(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA), rounds=1)
    found = coded.collect()
    assert len(found) == 4 and all(r.error == 0 for r in found) and books[3][:, 0].tolist() == [3 * 1024, 3 * 1024, -1, 0]
    assert [r.code for r in found if r.vec_id == 1] == ["00000000"] * 2  # equal entries: the first


def test_no_rows(spark):
    coded, books = V.compress(spark.createDataFrame([(1, None, 0, "")], SCHEMA))
    assert coded.count() == 0 and all(b.size == 0 for b in books)


def test_query_equals_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    ours = V.op12_vector_codes(spark, "/root/testdata/sf0.001")
    sql = db.execute(V.ORACLES["op12_vector_codes"])
    assert [c[0] for c in sql.description] == ours.columns
    assert sorted(map(tuple, ours.collect())) == sorted(sql.fetchall())
