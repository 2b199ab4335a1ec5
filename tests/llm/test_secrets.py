"""Secret scans: fixed patterns against plain expressions, the battery on strings of known making."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from solvetrail.llm import secrets

SCHEMA = "doc_id bigint, text string, spans string, n_hex string"


def plain(text):
    found = []
    keyword = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


PARTS = ["password", "PassWD", "token", "secret", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "\n", "é", "日", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "ABC", "0f", ".", "/x", "ſecret"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=14).map("".join))
def test_fixed_patterns(text):
    assert secrets.base_spans(text, secrets.long_runs(text)) == plain(text)


def keys(rng, letters, length, n):
    return ["".join(rng.choices(letters, k=length)) for _ in range(n)]


def structured(rng, n):
    words = "alpha beta gamma delta user order item page list view edit data".split()
    return ["-".join(rng.choices(words, k=4)) + f"-{rng.randrange(10)}" for _ in range(n)]


def prose(rng, n):
    words = "the of and river water mountain second other number people called through little sentence great".split()
    return [" ".join(rng.choice(words).title() if rng.random() < 0.1 else rng.choice(words) for _ in range(150)) for _ in range(n)]


def histogram(strata):
    counts = {}
    for encoding, length, k in strata:
        own = counts.setdefault((encoding, length), {})
        own[k] = own.get(k, 0) + 1
    return counts


def test_battery_tells_keys_from_names():
    rng = random.Random(2)
    real = keys(rng, secrets.ALPHABETS["base62"], 40, 300) + keys(rng, secrets.ALPHABETS["base64url"], 64, 100)
    names = structured(rng, 900)
    strings = histogram(x for s in real + names for x in secrets.tested(s))
    reference = histogram(x for t in prose(rng, 3000) for x in secrets.ordinary(t))
    limits = secrets.cutoffs(strings, reference)
    assert sum(bool(secrets.scan(s, limits).added) for s in real) >= 360
    assert sum(bool(secrets.scan(s, limits).added) for s in names) <= 30


def test_p_values_of_random_strings_are_level():
    rng = random.Random(3)
    for name, letters in secrets.ALPHABETS.items():
        found = [secrets.random_p(s, name) for s in keys(rng, letters, 64, 400)]
        assert 0.3 < sum(p > 0.5 for p in found) / 400 < 0.7


def test_all_ordinary_text_is_tested():
    """Every stretch counts, in every length class, with the class that it has on its own."""
    rng = random.Random(5)
    text = " ".join(prose(rng, 5)) + "a" * 900
    found = histogram(secrets.ordinary(text, 1100))
    for encoding, length in (("base36", secrets.FIRST), ("hex", 22), ("base62", 30), ("base64", 40)):
        own, n = secrets.own_letters(text.encode(), encoding).decode(), secrets.stretch_length(length)
        alone = [secrets.p_class(secrets.random_p(own[i : i + n], encoding)) for i in range(0, len(own) - n + 1, n)]
        assert found[encoding, length] == histogram((encoding, length, k) for k in alone)[encoding, length]


def test_few_long_documents_are_enough(spark):
    """Two documents have stretches enough for a short and for a very long key."""
    rng = random.Random(6)
    short, long = keys(rng, secrets.ALPHABETS["base62"], 44, 1)[0] + "b7Z", keys(rng, secrets.ALPHABETS["base62"], 3000, 1)[0] + "A7z"
    texts = [" ".join(prose(rng, 40)) + f" {short} ", " ".join(prose(rng, 40)) + f" {long}"]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.spans for r in secrets.secret_spans(docs).collect()}
    assert found == {i: f"random:{texts[i].index(k)}:{texts[i].index(k) + len(k)}" for i, k in enumerate((short, long))}


def test_no_string_is_lost_before_the_test():
    url, plus, letters = "Ab-9_xK3" * 4, "Ab+9/xK3" * 4, "QxZbLkTwPaRmVcYd"
    for text, wanted in (
        (f"com/services/T0/{url}", url), (f"my-key_{plus}", plus), (f"my_key/x-{'Ab9xK3' * 4}/y", "Ab9xK3" * 4),
        (letters, letters), ("Ab9xK3Qw7LmZ2pRt", "Ab9xK3Qw7LmZ2pRt"),
    ):
        assert wanted in [text[a:b] for a, b, _ in secrets.pieces(text, secrets.long_runs(text))]
    limits = {(e, k): secrets.CLASSES for e in secrets.ALPHABETS for k in range(60)}
    spans = secrets.scan(f"com/services/T0/{url}", limits).added
    assert spans == [(16, 3, 48)]


def test_cutoffs_follow_the_rule():
    strings = {("x", 1): {0: 90, 40: 10}, ("y", 1): {0: 2, 30: 98}, ("z", 1): {8: 1}}
    reference = {("x", 1): {30: 99}, ("y", 1): {10: 50, 30: 50}}
    assert secrets.cutoffs(strings, reference, 0.05) == {("x", 1): 0}


def test_rows(spark):
    rng = random.Random(4)
    key = keys(rng, secrets.ALPHABETS["base62"], 48, 1)[0] + "A7z"
    texts = [None, "", f"x é {key} y", 'Token: "abcdefghijkl"', "AKIAABCDEFGHIJKLMN0 0123456789abcdef", "aaaa1111" * 20_000, "internationalization2", key]
    texts += ["plain words only " * 10] * 3 + prose(rng, 600)
    docs = spark.createDataFrame([(i if i else None, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    for i, text in enumerate(texts):
        base, r = plain(text or ""), found[i or None]
        names = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert set(filter(None, names.split(","))) <= set(r.spans.split(","))
    assert found[2].spans == f"random:4:{4 + len(key)}" and found[7].spans == f"random:0:{len(key)}"
    assert found[5].spans.startswith("hex:0:") and found[8].spans == ""
    assert secrets.secret_spans(docs.limit(0)).collect() == []
