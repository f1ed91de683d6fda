"""The pipeline's stages on small documents, and its parts against the operators' own plain versions."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from quillon.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = np.random.default_rng(9)
    parts = {"en": ["th", "ing", "er", "wh", "ed"], "de": ["sch", "ung", "ei", "ich", "ver"]}
    rows = []
    for i in range(120):
        lang = ["en", "de"][i % 2]
        lines = [" ".join("".join(rng.choice(parts[lang], 3)) for _ in range(12)) for _ in range(6)]
        rows.append((i, "\n".join(lines), lang if i % 5 else None, f"s{i % 3}", None))
    rows += [(200, rows[0][1], "en", "s0", 3), (201, None, "en", "s0", 3), (202, "12 34", None, None, 5), (203, rows[3][1] + "\nlast line of it", "de", None, 5), (204, rows[5][1].replace("\n", " "), "de", "s1", 1)]
    return rows


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert name == "byte_bpe" or docs.columns == list(C.COLUMNS)
    ids = {n: {r.doc_id for r in rs} for n, rs in seen.items()}
    assert ids["language_id"] == {r[0] for r in rows} - {201, 202}
    assert all(r.lang for r in seen["language_id"])
    assert ids["line_dedup"] == ids["language_id"] - {200}
    text = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert text[203] == "last line of it" and text[0] == rows[0][1]
    assert ids["simhash_near_dedup"] == ids["line_dedup"] - {204}
    assert ids["mixing"] <= ids["simhash_near_dedup"]
    words = sum(len(r.text.split()) for r in seen["simhash_near_dedup"])
    assert abs(sum(len(r.text.split()) for r in seen["mixing"]) - 1.5 * words) < 4 * 64
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    wanted = sorted((r.doc_id, np.array(library.encode_ordinary(r.text), "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()) for r in seen["mixing"])
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in seen["byte_bpe"]) == wanted
    assert C.run(spark, str(tmp_path)).count() == len(wanted)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
