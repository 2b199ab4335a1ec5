"""Exact dedup against grouping by the squeezed text itself."""

import hashlib

from pyspark.sql import functions as F

from solvetrail.llm import exact

SCHEMA = "doc_id bigint, text string, digest string, keep_id string"


def plain(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for norm, members in groups.items():
        first = min(members)
        for m in members:
            sha = hashlib.sha256(norm.encode()).hexdigest()
            out.append((rows[m[3]][0], rows[first[3]][0], len(members), m == first, sha))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


ROWS = [
    (3, "a b"), (1, "ab"), (2, "a\n b"), (5, "a b "), (None, "a   b"), (7, None), (8, ""), (9, " \t"), (4, "Ab"),
    (10, "ä b"), (11, "ä b"), (12, "äb"), (13, "x y"), (13, "x y"), (13, "x\ty"), (None, "lone"), (20, "z" * 200_000),
    (21, "z " * 200_000),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in ROWS], SCHEMA)
    groups = exact.exact_groups(docs)
    assert groups.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(groups) == plain(ROWS)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    expected = sorted(((r[0], r[4]) for r in plain(ROWS) if r[3]), key=str)
    sha = F.sha2(exact.squeezed(F.col("text")), 256)
    assert sorted(((r[0], r[1]) for r in kept.select("doc_id", sha).collect()), key=str) == expected


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    docs = spark.createDataFrame([(i, t, "", "") for i, t in ROWS], SCHEMA)
    weak = exact.exact_groups(docs, digest=lambda text: F.unhex(F.lpad(F.hex(F.char_length(text) % 2), 2, "0")))
    assert found(weak) == plain(ROWS)


def test_large_group_and_empty_table(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text")
    )
    groups = exact.exact_groups(docs)
    assert groups.filter("keep_id = 0 and group_size = 1000").count() == 1000
    assert exact.without_copies(docs).count() == 2001
    assert exact.exact_groups(docs.limit(0)).collect() == [] and exact.without_copies(docs.limit(0)).collect() == []
