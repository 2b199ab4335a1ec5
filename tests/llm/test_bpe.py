"""Token counts against the tokenizer library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from solvetrail.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    with open(PATH, encoding="utf-8") as source:
        return bpe.Merges(source.read())


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("aA 1.'\n\té ́xIVst", max_size=60))
def test_any_text(text):
    assert bpe._merges(open(PATH, encoding="utf-8").read()).count(text) == library(text)


def test_every_character_below_the_limit_of_the_short_classes(merges):
    for c in map(chr, range(0x260)):
        text = f"a{c}{c}b1{c}2 {c} x{c}\n{c}"
        assert merges.count(text) == library(text)


@pytest.mark.parametrize(
    "text", ["", " ", "a" * 50_000, "ab" * 30_000, "\n" * 3000, "<|endoftext|>", "x<|endoftext|> y<|endoftext", "don't we'll I'M 's", "日本語 русский"]
)
def test_cases(merges, text):
    assert merges.count(text) == library(text)


def test_forgotten_pieces_are_counted_again(merges, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    words = "one two three four five six seven one two eight one"
    assert merges.count(words) == merges.count(words) == library(words)


def test_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.token_counts(docs, PATH).collect()}
    assert found == {i: (len(t.encode()), library(t), library(t) > 512) for i, t in texts.items()}


def test_nulls_repeats_and_clashes(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (1, "", 5), (1, "", 5)], "doc_id bigint, text string, n_tokens int")
    rows = sorted(map(tuple, bpe.token_counts(docs, PATH).collect()), key=str)
    assert rows == sorted([(1, 0, 0, False), (None, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False)], key=str)
    assert bpe.token_counts(docs.limit(0), PATH).collect() == []
