"""Substring dedup against all windows of all documents."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from solvetrail.llm import substrings as sub

SCHEMA = "doc_id bigint, text string, size string, key string"


def plain(docs, length):
    texts = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[s : s + length]) for _, w in texts for s in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone |= set(range(s, s + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, length, gram, parts=3):
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], SCHEMA).repartition(parts)
    return sorted(map(tuple, sub.deduplicated_digests(frame, length, gram).collect()), key=str)


@pytest.mark.parametrize("seed,length,gram", [(0, 6, 3), (1, 6, 2), (2, 9, 4), (3, 5, 5), (4, 7, 1)])
def test_random_texts(spark, seed, length, gram):
    """Passages of about the length, in one document and in several, edited, at the ends, overlapping."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["", "é", "x", "1"])
    pool = [[word() for _ in range(rng.randrange(length - 2, 3 * length))] for _ in range(12)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            text += rng.choice(pool) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(2 * length))]
            if text and rng.random() < 0.4:
                text[rng.randrange(len(text))] = word()
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    docs += docs[:5] + [(100 + i, t) for i, t in docs[5:12]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rng.choice([4, 10_000]))
    try:
        assert run(spark, docs, length, gram) == plain(docs, length)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, docs[3][1]), (-1, None), (-2, ""), (-3, " "), (-4, "again and again " * 30_000), (-5, " a " * 40)]
    assert run(spark, docs, 35, 16) == plain(docs, 35)


def test_text_that_stays(spark):
    docs = [(1, "a b c d  e f"), (2, "x a b c\td y"), (3, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, sub.deduplicated(frame, 4, 2).collect())) == [(1, 6, 4, "e f"), (2, 6, 4, "x y"), (3, 0, 0, "")]
    assert sub.deduplicated(frame.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_entries_are_judged_alike_in_any_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(3), rng.randrange(6), rng.randrange(4), 0, 0, 0, 1, 0) for _ in range(200))
    columns = [pa.array(c, pa.int64() if k < 4 else pa.int32()) for k, c in enumerate(zip(*rows, strict=True))]
    batch = pa.RecordBatch.from_arrays(columns, sub.COLUMNS)
    batches = [batch.slice(at, size) for at in range(0, 200, size)]
    found = Counter()
    for out in sub.shared_entries(iter(batches)):
        found.update(tuple(r.values())[:3] + (r["known"],) for r in out.to_pylist())
    whole, firsts = Counter(r[:3] for r in rows), {}
    for r in set(r[:3] for r in rows):
        firsts.setdefault(r[:2], set()).add(r[2])
    expected = Counter()
    for r, n in whole.items():
        others = len(firsts[r[:2]]) > 1
        if n > 1:
            expected[(*r, sub.REPEATS)] += n - others
            expected[(*r, sub.INFORMS)] += others
        elif others:
            expected[(*r, sub.OPEN)] += 1
    assert found == +expected


def test_rows_that_are_there_many_times(spark):
    """Of one row 3,000 copies, of a short one as many; others share a passage with it, or nothing."""
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n)]
    hot = words(60)
    docs = [(1, " ".join(hot))] * 3000 + [(2, "too short for a window")] * 3000
    docs += [(3, " ".join(words(20) + hot[5:50] + words(20))), (4, " ".join(words(50))), (None, " ".join(words(40)))]
    docs += [(5, None), (5, None), (6, " ".join(words(9) + hot[:36])), (6, " ".join(words(9) + hot[:36]))]
    assert run(spark, docs, 35, 16, parts=7) == plain(docs, 35)
    seen = sub.repeated_rows(sub._keyed(spark.createDataFrame(docs, "id long, text string"), "id", "text"), sub.Scratch(spark, "test"))
    assert seen.count() == 3
