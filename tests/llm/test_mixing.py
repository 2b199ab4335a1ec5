"""Balanced sampling: targets by the rule, sums kept, results that only depend on the rows."""

import random

import numpy as np
import pytest

from solvetrail.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string"


def resharing(totals):
    """Targets by sharing the excess again and again."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, stopped, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(totals.values())
    while left > 1e-9 and len(stopped) < len(names):
        free = sum(weight[s] for s in names if s not in stopped)
        for s in set(names) - stopped:
            target[s] += left * weight[s] / free
        left = 0.0
        for s in set(names) - stopped:
            if target[s] >= 2 * totals[s]:
                left += target[s] - 2 * totals[s]
                target[s] = 2.0 * totals[s]
                stopped.add(s)
    return target


@pytest.mark.parametrize("totals", [{"a": 100, "b": 10, "c": 1000, "d": 5, None: 40}, {"a": 7}, {"b": 0, "a": 3}, {"x": 0}, {}])
def test_targets(spark, totals):
    frame = spark.createDataFrame(list(totals.items()), "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    expected = resharing(totals)
    assert found.keys() == expected.keys()
    assert all(found[s] == pytest.approx(expected[s]) for s in found)


def test_flight_keeps_both_sums_and_each_mean():
    rng = random.Random(3)
    sizes = [float(rng.choice([1, 5, 5, 5, 80, 700])) for _ in range(200)]
    chances = [rng.random() for _ in sizes]
    taken = np.zeros(len(sizes))
    for _ in range(300):
        p = mixing.flight(sizes, chances, [rng.random() for _ in sizes])
        open_units = [x for x in p if 0 < x < 1]
        assert len(open_units) <= 2
        assert sum(p) == pytest.approx(sum(chances))
        assert np.dot(p, sizes) == pytest.approx(np.dot(chances, sizes))
        landed = mixing.land(sizes, p)
        assert set(landed) <= {0.0, 1.0}
        taken += landed
    assert np.abs(taken / 300 - chances).max() < 0.15


def mixed(docs):
    return sorted(map(tuple, mixing.mix(docs).collect()), key=str)


@pytest.mark.parametrize("block", [20, 4096])
def test_documents(spark, folder, block, monkeypatch):
    monkeypatch.setattr(mixing.balanced, "__defaults__", (block, mixing.SEED))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixed(docs)
    assert rows == mixed(docs.repartition(7))
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    totals, taken, largest = {}, {}, {}
    for doc_id, size, _, _, got in rows:
        text, source = texts[doc_id]
        assert size == len((text or "").encode().split())
        assert got % max(size, 1) == 0 and got <= 2 * size
        totals[source] = totals.get(source, 0) + size
        taken[source] = taken.get(source, 0) + got
        largest[source] = max(largest.get(source, 0), size)
    expected = resharing(totals)
    for doc_id, _, source_size, target, _ in rows:
        source = texts[doc_id][1]
        assert source_size == totals[source] and target == pytest.approx(expected[source])
        assert abs(taken[source] - target) <= largest[source]
    docs_of_mix = mixing.mixed_documents(docs)
    assert docs_of_mix.columns[: len(docs.columns)] == docs.columns
    assert sum(r.mix_size * r.mix_times for r in docs_of_mix.collect()) == sum(taken.values())


def test_nulls_repeats_and_clashes(spark):
    rows = [(1, None, "a", ""), (None, "x y", None, ""), (2, "x", None, ""), (2, "x", None, ""), (3, "", "a", ""), (4, "w " * 100_000, "b", "")]
    rows += [(9, "same words here", "a", "")] * 11
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixed(docs)
    assert len(found) == len(rows)
    assert all(r[4] == 0 for r in found if r[1] == 0)
    repeated = [r[4] for r in found if r[0] == 9]
    assert abs(sum(repeated) - found[[r[0] for r in found].index(9)][3]) <= 3
    whole = mixing.mixed_documents(docs).collect()
    assert sum(r.mix_size * r.mix_times for r in whole) == sum(r[4] for r in found)
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed_documents(docs.limit(0)).collect() == []
