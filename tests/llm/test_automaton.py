"""The automaton against merging by rank and against the library its vocabulary is for."""

import hashlib
import random

import public_tokenizers
import pytest
from helpers import values
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvetrail.llm import automaton, registry

FILE = public_tokenizers.path(registry.WORD_FILE)
ROWS = "doc_id long, text string, found string, n_tokens long"


@pytest.fixture(scope="module")
def words():
    return automaton.words_of(automaton.read_vocabulary(FILE))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def merged(letters, merges):
    """Merge by rank, the leftmost pair first."""
    symbols, rank = [*letters], {pair: i for i, pair in enumerate(merges)}
    while True:
        pairs = [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        if not pairs:
            return symbols
        _, at = min(pairs)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_any_merges(seed):
    """Vocabularies of up to forty random merges over three letters, with and without end marks."""
    draw = random.Random(seed)
    suffix = "_" if seed % 2 else ""
    symbols = [*"abc", *(x + suffix for x in "abc")] if suffix else [*"abc"]
    known, merges = [*symbols], []
    for _ in range(40):
        left = draw.choice([k for k in known if not suffix or not k.endswith(suffix)])
        right = draw.choice(known)
        if left + right not in known:
            merges.append((left, right))
            known.append(left + right)
    machine = automaton.Automaton(symbols, merges, suffix)
    for _ in range(300):
        letters = [draw.choice("abc") for _ in range(draw.randint(1, 14))]
        letters[-1] += suffix
        tokens = machine.encode(letters)
        assert machine.decode(tokens) == merged(letters, merges)
        # What the automaton accepts is this one sequence: its arcs are there, one by one.
        assert all(machine.arc(s, t) for s, t in zip([0, *tokens], tokens, strict=False))


def test_wrong_merges():
    with pytest.raises(ValueError, match="merge 1"):
        automaton.Automaton(["a"], [("a", "b")])


def test_texts_as_the_library(words, library):
    draw = random.Random(5)
    odd = ["", " ", "Hello  world's <|endoftext|> x<|StartOfText|>y", "ΟΔΟΣ Σ", "İ ﬁ Å Å", "'S 'LL 12½", "日本語 한국 🎉👍🏽", "՘Ꟛ \x00\x85"]
    some = ["".join(chr(draw.choice((draw.randrange(32, 0x250), draw.randrange(0x250, 0xD800), draw.randrange(0xE000, 0x1FFFF)))) for _ in range(40)) for _ in range(300)]
    common = ["".join(draw.choice("aeinorst' .</w>-") for _ in range(draw.randint(1, 80))) for _ in range(300)]
    texts = [*odd, *some, *common, "a" * 50_000, "=-" * 20_000]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        n, ids, labels = words.written(text)
        assert words.encode(text) == found.ids
        assert (n, ids) == (len(found.ids), " ".join(map(str, found.ids)))
        assert labels == words.decode(found.ids) == library.decode(found.ids, skip_special_tokens=False)


def test_query_as_the_library(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for row in docs:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        joined = " ".join(map(str, ids))
        expected.append((row.doc_id, len(ids), digest(joined), digest(library.decode(ids, skip_special_tokens=False))))
    frame = registry.queries()["op13_bpe_automaton"](spark, folder)
    assert values(frame, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected)


def test_arrays_of_ids_round_trip(spark, library):
    docs = spark.createDataFrame([(1, "Plain words, 3 of them", "x", 9), (1, "Plain words, 3 of them", "x", 9), (None, None, None, None), (2, "", "", 0)], ROWS)
    ids = automaton.token_ids(F.col("text"), FILE)
    rows = docs.select("text", ids.alias("ids")).select("text", "ids", automaton.decoded(F.col("ids"), FILE).alias("back")).collect()
    for row in rows:
        found = library.encode(row.text or "", add_special_tokens=False).ids
        assert list(row.ids) == found
        assert row.back.replace("</w>", "").split() == "".join(c if c.isalnum() else f" {c} " for c in (row.text or "").lower()).split()


def test_odd_rows(spark):
    """Null and empty texts, repeated rows, null ids, clashing columns, an empty table."""
    docs = spark.createDataFrame([(1, "a b", "x", 9), (1, "a b", "x", 9), (None, None, None, None), (2, "", "", 0)], ROWS)
    empty = hashlib.sha256(b"").hexdigest()
    found = automaton.token_digests(docs, FILE)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [r[:2] for r in values(found)] == [(1, 2), (1, 2), (2, 0), (None, 0)]
    assert {r.ids_sha256 for r in found.collect() if not r.n_tokens} == {empty}
    assert automaton.token_digests(docs.limit(0), FILE).count() == 0
