import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from swaplens.llm import tokenizer

PATH = tokenizer.vocabulary_path()


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tokenizer.tokenizer(PATH), tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200) | st.text(" \n\tabeinrst'’éß漢🙂<|>", max_size=300))
def test_same_ids_and_exact_round_trip(both, text):
    mine, theirs = both
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text) and mine.decode_bytes(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000, "ab" * 9_000, "\n" * 3000 + "x", "<|endoftext|>", "é" * 5000, "zzzzyzzzz" * 500])
def test_long_pieces(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (3, "hi", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokenizer.encode_column(df, "doc_id", "text", PATH).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got) == 4
    assert tokenizer.encode_column(df.limit(0), "doc_id", "text", PATH).count() == 0
