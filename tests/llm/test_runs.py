"""Runs against their definition, and the query against a plain rebuild of it."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import values

from solvetrail.llm import registry, runs

ROWS = "doc_id long, text string, runs string, n_words string"


def lyndon(word):
    """Longest Lyndon word at each place, by comparing with all its ends."""
    return [max(k for k in range(1, len(word) - i + 1) if all(word[i : i + k] < word[j : i + k] for j in range(i + 1, i + k))) for i in range(len(word))]


def plain_runs(words, least=12):
    """(start, length, period) of all runs: maximal stretches for every period, least period per stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            k = i
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k + q - i >= max(least, 2 * q):
                found.setdefault((i, k + q - i), q)
            i = k + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def plain_planted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = plain_planted(doc_id, text)
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    digests = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), b" ".join(plain_kept(words, found)))]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *digests)


@pytest.mark.parametrize("seed", range(60))
def test_lyndon_lengths(seed):
    draw = random.Random(seed)
    for _ in range(20):
        word = [draw.randint(1, 1 + seed % 4) for _ in range(draw.randint(1, 24))]
        assert runs.lyndon_lengths(word) == lyndon(word)


@pytest.mark.parametrize("seed", range(60))
def test_runs(seed):
    """Words over few letters, some made of repeats of repeats; all runs from two symbols on."""
    draw = random.Random(seed)
    for _ in range(10):
        word = [draw.randint(1, 1 + seed % 3) for _ in range(draw.randint(1, 30))]
        while seed % 2 and len(word) < 40:
            word = (word[: draw.randint(1, len(word))] * draw.randint(1, 4) + word)[:60]
        least = draw.choice((2, 3, 12))
        found = zip(*(x.tolist() for x in runs.runs_of(np.array(word), least)), strict=True)
        assert list(found) == plain_runs(word, least)


@pytest.mark.parametrize("seed", range(20))
def test_texts_searched_together(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(30):
        words = [draw.choice((b"a", b"b", b"c", b"d", b"e")) for _ in range(draw.randint(0, 30))]
        words += words[draw.randint(0, len(words)) :] * draw.choice((0, 0, 1, 2, 5))
        texts.append(words + [b"x%d" % draw.randint(0, 99) for _ in range(draw.randint(0, 3))])
    for words, found in zip(texts, runs.search(texts), strict=True):
        assert list(zip(*(x.tolist() for x in found), strict=True)) == plain_runs(words)
        assert runs.kept_words(words, *found) == plain_kept(words, plain_runs(words))


def test_long_text():
    words = [b"one", b"two", b"three"] * 60_000 + [b"end"] + [b"same"] * 100_000
    (start, length, period), = runs.search([words])
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [(0, 180_000, 3), (180_001, 100_000, 1)]


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in expected) > 10
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert values(registry.queries()["op11_periodic_runs"](spark, folder), *columns) == expected


def test_odd_rows(spark):
    """Null and empty texts, null ids, repeated rows, runs of equal length, clashing columns, an empty table."""
    tie = " ".join(["a"] * 12 + ["x"] + ["b"] * 12)
    data = [(3, tie), (3, tie), (None, "c d " * 6), (4, None), (5, ""), (6, " \t\n"), (7, "word")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in data], ROWS)
    found = runs.run_digests(docs)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted((plain_row(i, t) for i, t in data), key=key)
    assert found.filter("doc_id = 3").first().start == 0
    assert runs.run_digests(docs.limit(0)).count() == 0
    rows = runs.periodic_runs(docs)
    assert rows.columns == ["doc_id", "n_words", "runs", "kept"]
    assert {r.kept for r in rows.filter("doc_id = 3").collect()} == {"a x b"}
