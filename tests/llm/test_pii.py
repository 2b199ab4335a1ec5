"""Personal data: fixed patterns against plain expressions; the field's consistency within documents."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from solvetrail.llm import pii

SCHEMA = "doc_id bigint, text string, spans string, n_ip string"


def plain(text):
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m[0].split("."))) <= 255:
            found.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, m.start(), m.end()))
    return found


PARTS = ["a", "b.c", "@", "@x.y", "x@y", ".", "..", "-", " ", "+1", "+", "(988) 555-2485", "1", "25", "256", "10.0.0.1", "4041894974608795", "é", "%", "_", "\n", "4111 1111 1111 1111"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join))
def test_fixed_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_beliefs_are_exact_on_a_tree():
    """Message passing on a chain of four nodes against the sum over all labellings."""
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    labels = [pii.OTHER, 2, pii.OTHER, pii.OTHER]
    nodes = [pii.Node(i, i + 1, k, [i], i > 0, [f"k{i}"]) for i, k in enumerate(labels)]
    own = [field.unary[i] if k == pii.OTHER else np.where(np.arange(5) == k, 0, pii.CLAMP) for i, k in enumerate(labels)]
    exact = np.zeros((4, 5))
    for way in itertools.product(range(5), repeat=4):
        weight = np.exp(sum(own[i][x] for i, x in enumerate(way)) + sum(field.chain[a, b] for a, b in itertools.pairwise(way)))
        for i, x in enumerate(way):
            exact[i, x] += weight
    exact /= exact.sum(axis=1, keepdims=True)
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert np.allclose(field.beliefs(nodes), exact, atol=1e-4)
    finally:
        pii.ROUNDS = rounds


def test_skip_edges_are_linear():
    text = "12345678 " * 500
    nodes = pii.nodes_of(text, [])
    chain, skip = pii.edges_of(nodes)
    assert len(nodes) == 500 and len(chain) == 499 and len(skip) == 499


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.trained(docs)


def test_repeated_token_takes_the_label_of_its_pattern(field):
    """The number without its '+' is no match; a match with the same digits elsewhere ties it in."""
    text = "reach +19885552485 today or later, 19885552485 again"
    assert plain(text) == [(3, 6, 18)]
    assert pii.added_spans(text, plain(text), field) == [(3, 35, 46)]
    assert pii.added_spans("Licensed under the Apache License, Version 2.0.", [], field) == []


def test_far_repeats_take_the_label_too(field):
    text = "reach +19885552485 today. " + "Then call 19885552485 again. " * 50
    assert pii.added_spans(text, plain(text), field) == [(3, m.start(), m.end()) for m in re.finditer("(?<![+])19885552485", text)]
    text = "19885552485 first, " + text
    assert len(pii.added_spans(text, plain(text), field)) == 51
    years = "in 2024 we " * 60
    assert pii.added_spans(years, plain(years), field) == []


def test_hubs_are_linear():
    nodes = pii.nodes_of("12345678 " * 500, [])
    assert pii.hubs_of(nodes) == [list(range(500))]


def test_rows(spark):
    texts = [None, "", "mail a.b@c.de and 10.0.0.1, card 4111 1111 1111 1111, +1 (988) 555-2485", "no data", "1" * 50_000 + " x@", "9." * 30_000]
    docs = spark.createDataFrame([(i or None, t, "clash", "clash") for i, t in enumerate(texts)] + [(3, "no data", "", "")], SCHEMA)
    rows = pii.personal_spans(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        base = sorted(plain(texts[r.doc_id or 0] or "")) if r.doc_id != 4 else []
        names = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert set(filter(None, names.split(","))) <= set(r.spans.split(","))
    assert pii.personal_spans(docs.limit(0)).collect() == []


def test_repeats_in_other_formats(field):
    """Numbers that the patterns find once, repeated in forms that they don't match; and ordinary numbers beside them."""
    import random

    rng = random.Random(2)
    caught = total = 0
    for _ in range(100):
        a, b, c = rng.randrange(201, 990), rng.randrange(201, 990), rng.randrange(1000, 9999)
        card = f"4{rng.randrange(10**13, 10**14 - 1)}"
        card = next(card + str(k) for k in range(10) if pii.luhn(card + str(k)))
        cells = [card[i : i + 4] for i in (0, 4, 8, 12)]
        repeats = [(3, f"({a}) {b}-{c}"), (3, f"{a}-{b}-{c}"), (3, f"{a}{b}{c}"), (2, ".".join(cells)), (2, "/".join(cells))]
        rng.shuffle(repeats)
        text = f"reach +1 ({a}) {b}-{c} or pay with {' '.join(cells)} in 2024, room {rng.randrange(100, 999)}. "
        text += " ".join(f"then we wrote {r} in the book on page {rng.randrange(10, 400)}, and" for _, r in repeats)
        spans = pii.added_spans(text, plain(text), field)
        for kind, repeat in repeats:
            at = text.rindex(repeat)
            total += 1
            caught += any(k == kind and s <= at and at + len(repeat) <= e for k, s, e in spans)
        words = {text[s:e] for _, s, e in spans}
        assert not any(w in words or w + "," in words for w in ("2024", "1.0"))
        assert len(spans) <= len(repeats)
    assert caught >= 0.9 * total


def test_brackets_stay_with_their_span():
    assert pii._balanced("call (988) 555-2485 now", 6, 19) == (5, 19)
    assert pii._balanced("call (988) now", 5, 9) == (5, 10)
    assert pii._balanced("(see 988) x", 5, 8) == (5, 8)
