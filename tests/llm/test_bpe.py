import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    ranks = B.read_ranks(open(PATH, "rb").read())
    return B.TreeBpe(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcdehinorst AE\n'!éßñ漢字")), st.characters(codec="utf-8")), max_size=60))
def test_the_tree_is_the_library(own, text):
    import regex

    tree, library = own
    ids = [i for word in regex.findall(P.PATTERN, text) for i in tree.encode(word.encode())]
    assert ids == library.encode_ordinary(text)
    assert tree.decode(np.array(ids, "<u4")) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2000, " " * 3000, "é" * 1500, "!?" * 1500, "theth" * 900, "漢" * 700, "abcabcab" * 500])
def test_long_pretokens(own, text):
    import regex

    tree, library = own
    assert [i for word in regex.findall(P.PATTERN, text) for i in tree.encode(word.encode())] == library.encode_ordinary(text)


def test_merging_long_and_short_windows_agrees(own, monkeypatch):
    tree, _ = own
    data = "".join(np.random.default_rng(0).choice(list("abest inrng"), 400)).encode()
    slow = tree._merge(data)
    monkeypatch.setattr(B, "SHORT", 10_000)
    assert tree._merge(data) == slow


def test_the_column(spark, own):
    texts = [(1, "Hello <|endoftext|> world"), (2, ""), (3, None), (None, "x"), (4, "word " * 40000), (1, "Hello <|endoftext|> world")]
    df = spark.createDataFrame([(i, t, "z", "z") for i, t in texts], "doc_id long, text string, ids string, decoded string")
    found = B.digest(B.encode_decode(df, PATH, P.PATTERN)).collect()
    wanted = []
    for i, t in texts:
        ids = own[1].encode_ordinary(t or "")
        wanted.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(wanted)
    assert B.encode_decode(df.limit(0), PATH, P.PATTERN).count() == 0
