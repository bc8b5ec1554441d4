import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hostvigil.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tokens.BytePairCounter(PATH)


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 1'\n\ts<|endoftxé", max_size=60))
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == expected(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 20_000, "<|endoftext|>" * 3, "x <|endoftext|>y", "they'll  don't\r\n\n", " \x85\x1c é́ 1½²", "漢字" * 500])
def test_special_texts_equal_the_library(text):
    assert COUNTER.count(text) == expected(text)


def test_rows(odd_docs, no_docs):
    rows = tokens.count_tokens(odd_docs, PATH)
    assert rows.columns == [*odd_docs.columns, "n_bytes", "n_tokens", "over_limit"]
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect())
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), expected(r.text or ""), expected(r.text or "") > 512) for r in odd_docs.collect())
    assert found == want
    assert tokens.count_tokens(no_docs, PATH).count() == 0


def test_columns_of_the_same_name_are_replaced(make_docs):
    docs = make_docs([(1, "a b")]).withColumnRenamed("score", "n_tokens")
    assert [r.n_tokens for r in tokens.count_tokens(docs, PATH).collect()] == [2]
