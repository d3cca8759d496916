"""Token counts against the vocabulary's own library."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lecturespark.llm import tokens

PATH = public_tokenizers.path(tokens.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
MERGES = tokens.ByteMerges(open(PATH, "rb").read())


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text(alphabet=" \t\n\x0b\x1c\x1f\x85\xa0 'sdtabe1٣½ñ漢😀<|endoftext>") | st.lists(
    st.sampled_from(["<|endoftext|>", " ", "  ", "'ll", "the", " there", "\n\n", "ß", "123"])).map("".join))
def test_any_text(text):
    assert MERGES.tokens(text) == expected(text)


def test_long_word():
    word = "abcabcab" * 2000
    assert MERGES.tokens(word) == expected(word)


def test_rows(spark):
    rows = [(1, "Hello there, world", "x"), (1, "Hello there, world", "x"), (2, None, "y"), (None, "", "z"), (3, "a b " * 3000, "w"), (4, "<|endoftext|>x", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.count_tokens(df, PATH).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), expected(t), expected(t) > 1024) for i, t, _ in rows), key=str)
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: expected(r.text) for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in tokens.token_query(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
