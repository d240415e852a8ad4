import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisteppe.llm import tokens as T

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def public():
    with open(T.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300))
def test_equals_the_public_library(public, text):
    import numpy as np

    assert np.frombuffer(T.encoder(T.vocabulary_path()).encode_bytes(text), np.int32).tolist() == public.encode_ordinary(text)


def test_very_long_pretoken_and_specials(spark, public):
    texts = ["аб" * 20_000, "<|endoftext|> и <|startoftext|>", None, "", " \n\t  x", "a" * 5_000, "é́🙂‍↔️"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x")], "doc_id bigint, text string, ids string")
    rows = T.encode(df).collect()
    assert len(rows) == 8
    assert {r.doc_id: r.ids for r in rows} == {i: public.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_rank_queue_gives_ranks_in_order():
    q = T.RankQueue()
    for rank in (50_000, 3, 70, 3, 4_096, 0):
        q.push(rank, rank + 1)
    out = []
    while (x := q.pop()) is not None:
        out.append(x)
    assert out == [(0, [1]), (3, [4, 4]), (70, [71]), (4_096, [4_097]), (50_000, [50_001])]


def test_empty_table(spark):
    assert T.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
