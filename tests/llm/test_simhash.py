"""SimHash groups against all pairs compared one by one."""

import random

import numpy as np
import pytest
import xxhash

from solvetrail.llm import simhash
from solvetrail.llm.components import components
from solvetrail.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string, print string, label string"


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    found = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles)
        found |= (2 * ones > len(shingles)) << bit
    return found


def least_reachable(ids, prints, distance=3):
    """The least id of each row's component, by walking over all pairs."""
    values = np.array(prints, dtype=np.uint64)
    label = {}
    for start in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])):
        queue = [] if start in label else [start]
        while queue:
            here = queue.pop()
            if here not in label:
                label[here] = ids[start]
                queue += np.flatnonzero(np.bitwise_count(values ^ values[here]) <= distance).tolist()
    return [label[i] for i in range(len(ids))]


def pairs_of(spark, prints):
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in set(prints)], "print long")
    labels = {r.node: r.label for r in simhash.linked(rows, Scratch(spark, "test")).collect()}
    return labels


@pytest.mark.parametrize("seed", range(3))
def test_links_of_crowded_prints(spark, seed):
    """Chains, balls and crowds around a few centres, with distances on both sides of the limit."""
    rng = random.Random(seed)
    prints = [0, 2**64 - 1, 2**63, 1]
    for _ in range(25):
        here = rng.getrandbits(64)
        bits = rng.sample(range(64), 12) if rng.random() < 0.5 else range(16 * (k := rng.randrange(4)), 16 * k + 16)
        for _ in range(rng.choice([2, 5, 40])):
            prints.append(here)
            for bit in rng.sample(list(bits), rng.randrange(1, 6)):
                here ^= 1 << bit
    prints = sorted(set(prints))
    expected = least_reachable(list(range(len(prints))), prints)
    labels = pairs_of(spark, prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    groups = {}
    for i, p in enumerate(signed):
        groups.setdefault(labels.get(p, p), []).append(i)
    found = {}
    for members in groups.values():
        found |= dict.fromkeys(members, min(members))
    assert [found[i] for i in range(len(prints))] == expected


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    expected = least_reachable([r.doc_id for r in rows], prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert found == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, expected, strict=True)}
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))


def test_edge_cases(spark):
    long_text = "One two three four five " * 20_000
    rows = [
        (5, None, "x", "a"), (4, "", "x", "b"), (None, " \t\n", "x", "c"), (9, "a B", None, None),
        (9, "A\u000bb", "y", "z"), (7, long_text, "", ""), (7, long_text, "", ""), (8, "Ä b c", "", ""), (None, "lone words here", "", ""),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted(simhash.near_groups(docs).collect(), key=str)
    by = {}
    for r in found:
        by.setdefault(r.fingerprint, []).append((r.doc_id, r.component_id))
    assert sorted(by["0" * 16], key=str) == [(4, 4), (5, 4), (None, 4)]
    assert by[f"{plain_print('a b'):016x}"] == [(9, 9), (9, 9)]
    assert by[f"{plain_print(long_text):016x}"] == [(7, 7), (7, 7)]
    assert by[f"{plain_print('lone words here'):016x}"] == [(None, None)]
    kept = simhash.one_per_group(docs).collect()
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept) == sorted(
        [("4", 0), ("9", 3), ("7", len(long_text)), ("8", 5), ("None", 15)]
    )
    empty = docs.limit(0)
    assert simhash.near_groups(empty).collect() == [] and simhash.one_per_group(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4999), (7, 7)]
    random.Random(1).shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long")
    labels = {r.node: r.label for r in components(frame, Scratch(spark, "test")).collect()}
    expected = dict.fromkeys(range(1, 301), 0) | dict.fromkeys(range(1001, 1200), 1000) | {5000: 4999}
    assert labels == expected
