"""Secret scans: fixed patterns, and strings that a battery of randomness tests finds too random for text."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
KEYWORDS = ("password", "passwd", "secret", "token", "api")
# Stretches of one alphabet in strings that mix those of base64 and base64url.
PARTS = [re.compile(f"[{own}]{{16,}}") for own in ("A-Za-z0-9_-", "A-Za-z0-9+/", "A-Za-z0-9")]
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
ASSIGNED, SHORTEST = 12, 16
# Strings that the battery looks at. It says little about the shortest; their own limits see to that.
TESTED = SHORTEST
# Of the strings reported as random, the share that may be ordinary ones.
RATE = 0.05
# Cells of an alphabet's classes: strings of so many characters have one more for each class.
CELL = 24

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings from the narrowest on; a string is held to be in the first that has all its characters.
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "lower": LOWER,
    "UPPER": UPPER,
    "base32": UPPER + DIGITS[2:8],
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
_SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in UPPER + LOWER + DIGITS + "+/_=-"]] = True
# The case in which ordinary text is read as an alphabet's, and the bytes that are left out then.
_CASE = {
    name: bytes.lower if own.isdisjoint(UPPER) else bytes.upper if own.isdisjoint(LOWER) else bytes
    for name, own in _SETS.items()
}
_REST = {name: bytes(b for b in range(256) if chr(b) not in own) for name, own in _SETS.items()}
# P-values are counted in classes of a quarter of a power of two.
STEPS, CLASSES = 4, 200
# The first length class, and bytes of ordinary text that are tested at once.
FIRST = int(4 * math.log2(TESTED))
BLOCK = 1 << 20


def long_runs(text: str) -> list[tuple[int, int]]:
    """Where at least SHORTEST characters of encodings follow one another, in code points."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _RUN[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    long = stop - start >= SHORTEST
    if not long.any():
        return []
    start, stop = start[long], stop[long]
    if len(data) != len(text):
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        start, stop = points[start], points[stop]
    return list(zip(start.tolist(), stop.tolist(), strict=True))


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kind as a place in KINDS, in order.

    The access and hex patterns lie inside runs whole, and a match that is too short has no longer
    one behind it, so both are searched with their least length, in the runs alone.
    """
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGNED]
    for start, stop in runs:
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text, start, stop)]
    return sorted(found)


def _encoding(piece: str) -> str | None:
    letters = frozenset(piece)
    return next((name for name, own in _SETS.items() if letters <= own), None)


def pieces(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, encoding) of the strings to be tested: with a letter, parted by '='.

    What no alphabet has all characters of, as a path with a base64url key in it, is parted at those
    of base64 alone, at those of base64url alone and at both. These strings may overlap.
    """
    for start, stop in runs:
        for piece in text[start:stop].split("="):
            if len(piece) >= TESTED and not piece.isdigit():
                if encoding := _encoding(piece):
                    yield start, start + len(piece), encoding
                else:
                    parts = {m.span() for part in PARTS for m in part.finditer(piece)}
                    for a, b in sorted(parts):
                        if not piece[a:b].isdigit() and (encoding := _encoding(piece[a:b])):
                            yield start + a, start + b, encoding
            start += len(piece) + 1


def _above(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def chi_tail(x: float, freedom: int) -> float:
    """Chance of a chi-squared above x, by the Wilson-Hilferty cube root."""
    spread = 2 / (9 * freedom)
    return _above(((max(x, 0.0) / freedom) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


@lru_cache(maxsize=None)
def cells_of(encoding: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an alphabet its cell, and the share of the alphabet in each cell.

    Letters of a case make `parts` cells, two at least if there is nothing else; digits half as many,
    other characters one.
    """
    if encoding in ("lower", "UPPER"):
        parts = max(parts, 2)
    cell, n = [], 0
    for letters, split in ((UPPER, parts), (LOWER, parts), (DIGITS, (parts + 1) // 2), ("+/-_", 1)):
        own = [c for c in ALPHABETS[encoding] if c in letters]
        split = min(split, len(own))
        cell += [(c, n + i * split // len(own)) for i, c in enumerate(own)]
        n += split
    places = np.array([k for _, k in sorted(cell, key=lambda x: _PLACES[encoding][x[0]])])
    return places, np.bincount(places) / len(places)


def uniform_p(values: np.ndarray, encoding: str) -> float:
    """Chi-squared of the alphabet's use, over cells of its classes; more cells for longer strings."""
    places, share = cells_of(encoding, min(10, 1 + len(values) // CELL))
    seen, expected = np.bincount(places[values], minlength=len(share)), len(values) * share
    return chi_tail(float(((seen - expected) ** 2 / expected).sum()), len(share) - 1)


def runs_p(values: np.ndarray, size: int) -> float:
    """Runs in the upper and lower half of the alphabet, two-sided."""
    high = values >= size / 2
    n, up = len(high), int(high.sum())
    mean = 2 * up * (n - up) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    if spread <= 0:
        return 0.5 ** (n - 1)
    return min(1.0, 2 * _above(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)))


def serial_p(values: np.ndarray) -> float:
    """Correlation of neighbours, two-sided."""
    n, centred = len(values), values - values.mean()
    whole = float((centred * centred).sum())
    if not whole:
        return 0.5 ** (n - 1)
    r = float((centred[1:] * centred[:-1]).sum()) / whole
    return min(1.0, 2 * _above(abs(r + 1 / n) * math.sqrt(n)))


def random_p(piece: str, encoding: str) -> float:
    """The three tests by Fisher's rule: small if the string is unlikely to be random."""
    places, size = _PLACES[encoding], len(ALPHABETS[encoding])
    values = np.array([places[c] for c in piece])
    tests = uniform_p(values, encoding), runs_p(values, size), serial_p(values)
    return chi_tail(-2 * sum(math.log(max(p, 1e-300)) for p in tests), 6)


def stratum(encoding: str, length: int) -> tuple[str, int]:
    """Strings of an encoding and of about one length: classes of a quarter of a power of two."""
    return encoding, int(4 * math.log2(length))


def p_class(p: float) -> int:
    """Of two classes the higher has the smaller p-values."""
    return min(CLASSES, int(-STEPS * math.log2(max(p, 1e-300))))


def tested(text: str) -> Iterator[tuple[str, int, int]]:
    """(encoding, length class, p class) of each string of a text that is to be tested."""
    for start, end, encoding in pieces(text, long_runs(text)):
        yield *stratum(encoding, end - start), p_class(random_p(text[start:end], encoding))


def stretch_length(length: int) -> int:
    """Characters of a length class's stretches of ordinary text: as few as its strings may have."""
    return math.ceil(2 ** (length / 4))


def own_letters(data: bytes, encoding: str) -> bytes:
    """The characters of a text that an alphabet has."""
    return _CASE[encoding](data).translate(None, _REST[encoding])


def _erfc(x: np.ndarray) -> np.ndarray:
    """Chebyshev fit with a relative error under 1.2e-7 (Numerical Recipes)."""
    t = 1 / (1 + np.abs(x) / 2)
    fit = np.full_like(t, 0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    tail = t * np.exp(fit - x * x)
    return np.where(x >= 0, tail, 2 - tail)


def _chi_tails(x: np.ndarray, freedom: int) -> np.ndarray:
    spread = 2 / (9 * freedom)
    return _erfc((np.cbrt(np.maximum(x, 0) / freedom) - 1 + spread) / math.sqrt(2 * spread)) / 2


_LOOKUP = {name: bytes(places.get(chr(b), 0) for b in range(256)) for name, places in _PLACES.items()}


def p_classes(rows: np.ndarray, encoding: str) -> np.ndarray:
    """`p_class` of `random_p` of each row of bytes, all rows at once."""
    many, n = rows.shape
    size, data = len(ALPHABETS[encoding]), rows.tobytes().translate(_LOOKUP[encoding])
    values = np.frombuffer(data, np.uint8).reshape(many, n)
    places, share = cells_of(encoding, min(10, 1 + n // CELL))
    cells = np.frombuffer(data.translate(bytes(places.tolist()).ljust(256)), np.uint8).reshape(many, n)
    seen, expected = np.stack([np.count_nonzero(cells == k, axis=1) for k in range(len(share))], axis=1), n * share
    uniform = _chi_tails(((seen - expected) ** 2 / expected).sum(axis=1), len(share) - 1)

    one_sort = 0.5 ** (n - 1)
    high = values >= size / 2
    up = np.count_nonzero(high, axis=1).astype(float)
    mean = 2 * up * (n - up) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    apart = np.abs(1 + np.count_nonzero(high[:, 1:] != high[:, :-1], axis=1) - mean)
    runs = np.where(spread > 0, np.minimum(1, _erfc(apart / np.sqrt(2 * np.where(spread > 0, spread, 1)))), one_sort)

    centred = values - values.mean(axis=1, keepdims=True)
    whole = np.einsum("ij,ij->i", centred, centred)
    r = np.einsum("ij,ij->i", centred[:, 1:], centred[:, :-1]) / np.where(whole > 0, whole, 1)
    serial = np.where(whole > 0, np.minimum(1, _erfc(np.abs(r + 1 / n) * math.sqrt(n / 2))), one_sort)

    logs = sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, runs, serial))
    p = np.maximum(_chi_tails(-2 * logs, 6), 1e-300)
    return np.clip(-STEPS * np.log2(p), 0, CLASSES).astype(int)


def ordinary_classes(texts: list[bytes], strata: Iterable[tuple[str, int]]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(encoding, length class, p classes) of all consecutive stretches of ordinary texts: in each
    stratum's alphabet, of a text's characters that the alphabet has, each as long as the class takes.
    Less than a stretch at a text's end is left."""
    for encoding, group in groupby(sorted(strata), key=lambda x: x[0]):
        own = [own_letters(data, encoding) for data in texts]
        for _, length in group:
            n = stretch_length(length)
            data = b"".join(x[: len(x) // n * n] for x in own)
            rows = np.frombuffer(data, np.uint8).reshape(-1, n)
            step = max(1, BLOCK // n)
            for at in range(0, len(rows), step):
                yield encoding, length, p_classes(rows[at : at + step], encoding)


def ordinary(text: str, longest: int = 64) -> Iterator[tuple[str, int, int]]:
    """The same of ordinary text: of all its stretches in every alphabet and length class of strings up to `longest`."""
    data = text.encode("utf-8", "surrogatepass")
    strata = [(encoding, k) for encoding in ALPHABETS for k in range(FIRST, int(4 * math.log2(longest)) + 1)]
    for encoding, length, classes in ordinary_classes([data], strata):
        yield from ((encoding, length, k) for k in classes.tolist())


def held_against(
    strings: dict[tuple[str, int], dict[int, int]], stretches: dict[tuple[str, int], int], rate: float = RATE
) -> dict[tuple[str, int], tuple[str, int]]:
    """For each stratum of strings the one whose ordinary stretches it is held against.

    That is its own, if there are stretches enough to report a single string, else the next shorter
    class that has as many, else the one with the most. Shorter stretches look more random, so that
    this reports less and not more.
    """
    out = {}
    for (encoding, length), classes in strings.items():
        ways = [(encoding, k) for k in range(length, FIRST - 1, -1) if stretches.get((encoding, k))]
        if ways:
            enough = [w for w in ways if 1 + stretches[w] >= sum(classes.values()) / rate]
            out[encoding, length] = enough[0] if enough else max(ways, key=stretches.__getitem__)
    return out


def cutoffs(
    strings: dict[tuple[str, int], dict[int, int]], reference: dict[tuple[str, int], dict[int, int]], rate: float = RATE
) -> dict[tuple[str, int], int]:
    """The highest p class of each stratum that counts as random; strata without one are left out.

    By Benjamini and Hochberg, the null hypothesis being that a string is ordinary: its chance to look
    as random as it does is the share of ordinary stretches of its alphabet and length that do. As the
    tests' power grows with the length, each stratum has its own bar, and short strings may have none.
    """
    out = {}
    for name, classes in strings.items():
        null = reference.get(name, {})
        total, plain, seen, alike = sum(classes.values()), sum(null.values()), 0, 0
        for k in range(CLASSES + 1):
            seen, alike = seen + classes.get(k, 0), alike + null.get(k, 0)
            if seen and classes.get(k) and (1 + alike) / (1 + plain) <= rate * seen / total:
                out[name] = k
    return out


class Found(NamedTuple):
    base: list[tuple[int, int, int]]
    added: list[tuple[int, int, int]]


def scan(text: str, limits: dict[tuple[str, int], int]) -> Found:
    """Base spans, and the strings outside of them that pass for random, the longer of two that overlap."""
    runs = long_runs(text)
    base = base_spans(text, runs)
    added = []
    for start, end, encoding in pieces(text, runs):
        if any(s < end and start < e for s, _, e in base):
            continue
        if p_class(random_p(text[start:end], encoding)) <= limits.get(stratum(encoding, end - start), -1):
            added.append((start, len(KINDS) - 1, end))
    whole, last = [], -1
    for start, kind, end in added:
        if start >= last:
            whole.append((start, kind, end))
        elif end - start > whole[-1][2] - whole[-1][0]:
            whole[-1] = (start, kind, end)
        last = whole[-1][2]
    return Found(base, whole)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def battery_limits(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[tuple[str, int], int]:
    """Test the strings and all stretches of ordinary text of all documents and set the limits by stratum.

    A first pass tests the strings and counts how many stretches each alphabet and length class has; a
    second one tests the stretches that the strings are held against. Tasks count p-values by
    class; a stratum has at most CLASSES + 1 of them, and strata grow with the logarithm of the
    longest string or text, so what comes to the driver is bounded.
    """

    def strings_counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            seen, sizes = Counter(), {encoding: [] for encoding in ALPHABETS}
            for text in rows["text"]:
                seen.update((True, *k) for k in tested(text))
                data = text.encode("utf-8", "surrogatepass")
                for encoding, own in sizes.items():
                    own.append(len(own_letters(data, encoding)))
            for encoding, own in sizes.items():
                most, length = np.array(own), FIRST
                while many := int((most // stretch_length(length)).sum()):
                    seen[False, encoding, length, 0], length = many, length + 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["string", "encoding", "length", "p", "n"])

    texts = docs.filter(F.octet_length(text_col) >= TESTED).select(F.col(text_col).alias("text"))
    cells = texts.mapInPandas(strings_counted, "string boolean, encoding string, length int, p int, n long")
    found: dict[bool, dict[tuple[str, int], dict[int, int]]] = {True: {}, False: {}}
    for r in cells.groupBy("string", "encoding", "length", "p").agg(F.sum("n").alias("n")).collect():
        found[r.string].setdefault((r.encoding, r.length), {})[r.p] = r.n
    against = held_against(found[True], {name: n[0] for name, n in found[False].items()}, rate)
    strata = set(against.values())

    def stretches_counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {name: np.zeros(CLASSES + 1, int) for name in strata}

        def add(block: list[bytes]) -> None:
            for encoding, length, classes in ordinary_classes(block, strata):
                seen[encoding, length] += np.bincount(classes, minlength=CLASSES + 1)

        for rows in batches:
            block, held = [], 0
            for text in rows["text"]:
                block.append(text.encode("utf-8", "surrogatepass"))
                held += len(block[-1])
                if held >= BLOCK:
                    add(block)
                    block, held = [], 0
            add(block)
        cells = [(*name, int(k), int(counts[k])) for name, counts in seen.items() for k in np.flatnonzero(counts)]
        yield pd.DataFrame(cells, columns=["encoding", "length", "p", "n"])

    reference: dict[tuple[str, int], dict[int, int]] = {}
    if strata:
        cells = texts.mapInPandas(stretches_counted, "encoding string, length int, p int, n long")
        for r in cells.groupBy("encoding", "length", "p").agg(F.sum("n").alias("n")).collect():
            reference.setdefault((r.encoding, r.length), {})[r.p] = r.n
    return cutoffs(found[True], {name: reference[way] for name, way in against.items()}, rate)


def secret_spans(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, joined by commas;
    base_sha256 is over the spans of the fixed patterns, of nothing where there are none. Strings of
    at least TESTED characters with a letter that look more random than ordinary text does,
    with a share of `rate` false ones, come as kind random. Null texts count as empty; rows are scanned one by one, whole. Other columns are not
    read.
    """
    limits = battery_limits(docs, text_col, rate)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base, added = scan(text, limits)
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col), scanned(F.coalesce(F.col(text_col), F.lit(""))).alias("found")).select(id_col, "found.*")
