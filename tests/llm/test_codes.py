"""Codes against Lloyd rounds that compare everything, one vector at a time."""

import hashlib
import math

import numpy as np
import pytest
from helpers import ordered, values

from solvetrail.llm import codes, registry

ROWS = "vec_id long, embedding array<float>, label int, error string, vector string"


def plain(rows, parts=4, entries=256, rounds=4):
    """Rows (id, vector, label) to the query's rows, by the rules as they are written."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = width // parts
    cut = lambda v, k: v[k * size : (k + 1) * size]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]

    def nearest(v, k):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, k), e, strict=True)), place) for place, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            members = [[] for _ in books[k]]
            for _, v, _ in kept:
                members[nearest(v, k)[1]].append(cut(v, k))
            books[k] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, books[k], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [nearest(v, k) for k in range(parts)], label) for i, v, label in kept]
    total = {}
    for _, hits, label in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in hits)
    return [(i, "".join(f"{p:02x}" for _, p in hits), sum(d for d, _ in hits), total[label], digest) for i, hits, label in found]


COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    expected = ordered(plain([(r.vec_id, r.embedding, r.label) for r in rows]))
    assert values(registry.queries()["op12_vector_codes"](spark, folder), *COLUMNS) == expected


@pytest.mark.parametrize("seed", range(30))
def test_active_entries(seed):
    """Rounds that compare moved entries only against rounds that compare all; small numbers, many ties."""
    draw = np.random.default_rng(seed)
    rows = draw.integers(-4, 5, (200, 3))
    book = codes.Codebook(rows[:12].copy(), np.ones(12, bool))
    entry, error = np.full(200, -1), np.full(200, -1)
    for _ in range(8):
        entry, error = book.assign(rows, entry, error)
        distance = ((rows[:, None] - book.entries[None]) ** 2).sum(axis=2)
        assert (entry == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
        counts, sums = np.bincount(entry, minlength=12), np.zeros((12, 3), np.int64)
        np.add.at(sums, entry, rows)
        book = book.after(counts, sums)
        # Every second round one entry alone moves, so that most rows keep theirs.
        moved = np.zeros(12, bool)
        moved[draw.integers(12)] = True
        if draw.random() < 0.5:
            kept = np.where(moved[:, None], book.entries + draw.integers(-2, 3, 3), book.entries)
            book = codes.Codebook(kept, book.moved | moved)


def test_large_components():
    rows = np.array([[2**29, -(2**29)], [5, 7]])
    assert codes.squared(rows, rows).tolist() == [[0, (2**29 - 5) ** 2 + (2**29 + 7) ** 2], [(2**29 - 5) ** 2 + (2**29 + 7) ** 2, 0]]
    with pytest.raises(ValueError, match="beyond a long"):
        codes.squared(rows * 8, rows)


def test_odd_rows(spark):
    """Nulls everywhere, vectors that are not finite, empty, shorter, repeated; clashing columns; empty tables."""
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [0.5, -0.25, 0.001, 2.0], 1), (1, [0.5, -0.25, 0.001, 2.0], 1), (1, [0.25, 0.0, 0.0, 0.0], None), (2, None, 1),
        (3, [1.0, None, 0.0, 0.0], 1), (4, [nan, 0.0, 0.0, 0.0], 2), (5, [inf, 0.0, 0.0, 0.0], 2), (None, [0.5, 0.5], None), (6, [], 2), (7, [1.0] * 6, 2),
    ]
    docs = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in data], ROWS)
    assert values(codes.compressed(docs), *COLUMNS) == ordered(plain(data))
    assert values(codes.compressed(docs, entries=3, rounds=2), *COLUMNS) == ordered(plain(data, entries=3, rounds=2))
    assert codes.compressed(docs.limit(0)).collect() == []
    only = docs.filter("vec_id = 6")
    assert values(codes.compressed(only), *COLUMNS) == plain([(6, [], 2)])


def test_interface(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    state, books = codes.trained(rows, parts=2, entries=8, rounds=1)
    assert [b.shape for b in books] == [(8, 32), (8, 32)]
    assert state.columns == ["vec_id", "label", "vector", "entries", "errors"] and state.count() == rows.count()
