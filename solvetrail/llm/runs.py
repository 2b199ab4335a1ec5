"""Periodic stretches of words: Lyndon arrays by grouping, their roots extended to runs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fewest words of a run. A run has two periods at least, so it repeats half of that.
LEAST = 12
# Words of short texts are searched together until their texts have so many bytes.
BATCH_BYTES = 4 << 20
# Fixed value: what a word is. Splitting bytes at white space gives the same.
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Per place the length of the longest Lyndon word there; a symbol 0 ends a word.

    Phase one of Baier's suffix sorter. Suffixes start in groups by their first symbol. Groups are
    taken from the greatest down. For every suffix of the group, the nearest place before it in a
    lower group is one whose known beginning continues with this group's: such places leave their
    group for a new one right above it, the higher the more of the group's suffixes follow them, and
    what is known of their beginning grows by as many of the group's. When a group's turn has come, what
    is known of its suffixes is their longest Lyndon word.
    """
    size = len(symbols)
    count = max(symbols, default=0) + 1
    members: list[list[int]] = [[] for _ in range(count)]
    for place, symbol in enumerate(symbols):
        members[symbol].append(place)
    length = [1] * count
    # The order of the groups as a list linked both ways.
    below, above = list(range(-1, count - 1)), list(range(1, count + 1))
    group, found = [*symbols], [1] * size
    # Where to look for a place that is not done: up[i] is at or before i, and -1 is written as size.
    up = [*range(size), size]
    current = count - 1
    while current > 0:
        inside = [i for i in members[current] if group[i] == current]
        members[current] = []
        own = length[current]
        for i in inside:
            found[i] = own
            up[i] = i - 1 if i else size
        followed: dict[int, int] = {}
        for i in inside:
            j = up[i]
            while up[j] != j:
                up[j] = up[up[j]]
                j = up[j]
            up[i] = j
            if j != size and group[j]:
                followed[j] = followed.get(j, 0) + 1
        if followed:
            moved = defaultdict(list)
            for j, times in followed.items():
                moved[times, group[j]].append(j)
            for times, old in sorted(moved, reverse=True):
                places = moved[times, old]
                new = len(members)
                members.append(places)
                length.append(length[old] + times * own)
                after = above[old]
                below.append(old)
                above.append(after)
                above[old] = new
                if after < len(below):
                    below[after] = new
                for j in places:
                    group[j] = new
        current = below[current]
    return found


class Extensions:
    """How far two places of a sequence go on alike, exactly, for many pairs at once.

    Level k numbers the windows of 2**k symbols: equal windows have equal numbers. Levels end where
    no window occurs twice, so there are as many as the longest repeat has binary digits.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels = [symbols.astype(np.int64)]
        while True:
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(last) <= width:
                break
            pairs = last[:-width] * (int(last.max()) + 1) + last[width:]
            values, numbers = np.unique(pairs, return_inverse=True)
            if len(values) == len(pairs):
                break
            self.levels.append(numbers.reshape(-1))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from a and from b on, b > a."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            fits = np.flatnonzero(b + out < len(level))
            fits = fits[level[a[fits] + out[fits]] == level[b[fits] + out[fits]]]
            out[fits] += 1 << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols up to and with a and b, going back, b > a."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            level, width = self.levels[k], 1 << k
            fits = np.flatnonzero(a - out - width + 1 >= 0)
            fits = fits[level[a[fits] - out[fits] - width + 1] == level[b[fits] - out[fits] - width + 1]]
            out[fits] += width
        return out


def runs_of(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of every run of at least `least` symbols, by start, then period.

    Symbols are numbers from 1; 0 parts sequences that are searched together. Every run has, under
    the order of the symbols or its reverse, a Lyndon root: a longest Lyndon word as long as its period.
    So the longest Lyndon words under both orders, extended either way, give all runs.
    """
    none = np.empty(0, np.int64)
    if len(symbols) < least:
        return none, none, none
    _, ranks = np.unique(symbols, return_inverse=True)
    ranks = ranks.reshape(-1) + (0 if (symbols == 0).any() else 1)
    reverse = np.where(ranks == 0, 0, ranks.max() + 1 - ranks)
    places = np.flatnonzero(ranks)
    roots = np.concatenate([np.array(lyndon_lengths(r.tolist()), np.int64)[places] for r in (ranks, reverse)])
    places = np.concatenate([places, places])
    # A root that goes on in neither direction is no run.
    padded = np.concatenate([ranks, [0]])
    more = padded[places] == padded[np.minimum(places + roots, len(ranks))]
    more |= (places > 0) & (padded[places - 1] == padded[places + roots - 1]) & (padded[places - 1] > 0)
    places, roots = places[more], roots[more]
    same = Extensions(ranks)
    right, left = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    go = np.flatnonzero(places + roots < len(ranks))
    right[go] = same.forward(places[go], places[go] + roots[go])
    go = np.flatnonzero(places > 0)
    left[go] = same.backward(places[go] - 1, places[go] + roots[go] - 1)
    start, length = places - left, left + roots + right
    kept = length >= np.maximum(least, 2 * roots)
    rows = np.unique(np.stack([start[kept], roots[kept], length[kept]], axis=1), axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def _repeated(symbols: np.ndarray, texts: np.ndarray, width: int) -> np.ndarray:
    """Places inside windows of `width` symbols that occur twice in one text, and perhaps some others.

    A run of at least 2 * width symbols lies wholly in such windows: each of its windows has another one
    a period away, and its length is two periods. Windows are compared by a hash; two that share one by
    chance only add places to be searched.
    """
    covered = np.zeros(len(symbols) + 1, np.int64)
    if len(symbols) < width:
        return covered[:-1] > 0
    hashed = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(29)
    value = texts[: len(symbols) - width + 1].astype(np.uint64)
    for k in range(width):
        value = (value * np.uint64(0xBF58476D1CE4E5B9)) + hashed[k : len(hashed) - width + 1 + k]
        value ^= value >> np.uint64(31)
    within = np.flatnonzero(texts[: len(value)] == texts[width - 1 :])
    order = within[np.argsort(value[within], kind="stable")]
    equal = value[order[1:]] == value[order[:-1]]
    twice = np.concatenate([order[1:][equal], order[:-1][equal]])
    twice = np.unique(twice)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + width, -1)
    return np.cumsum(covered[:-1]) > 0


def search(texts: list[list[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text, given as words, the start, length and period of its runs.

    Only stretches that can hold a run are sorted, all of them at once, parted by zeros.
    """
    numbers: dict[bytes, int] = {}
    symbols = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for words in texts for w in words), np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    of_text = np.repeat(np.arange(len(texts)), sizes)
    none = np.empty(0, np.int64)
    found = [(none, none, none)] * len(texts)
    mask = _repeated(symbols, of_text, max(least // 2, 1))
    # Stretches of marked places within one text.
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    parted = offsets[1:-1]
    cuts = parted[mask[np.clip(parted - 1, 0, None)] & mask[np.clip(parted, None, len(mask) - 1)]] if len(mask) else none
    first, last = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))
    long_enough = last - first >= least
    first, last = first[long_enough], last[long_enough]
    if not len(first):
        return found
    # Joined behind each other, each with a zero after it.
    lengths = last - first + 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    stretch = np.repeat(np.arange(len(first)), lengths)
    source = np.arange(begins[-1]) - begins[stretch] + first[stretch]
    joined = np.where(source < last[stretch], symbols[np.minimum(source, len(symbols) - 1)], 0)
    start, length, period = runs_of(joined, least)
    place = source[start]
    owner = of_text[place]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for text in np.unique(owner):
        part = slice(bounds[text], bounds[text + 1])
        found[text] = (place[part] - offsets[text], length[part], period[part])
    return found


def kept_words(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run has after its first period."""
    if not len(start):
        return words
    drops = np.zeros(len(words) + 1, np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, start + length, -1)
    gone = np.cumsum(drops[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _batches(texts: pd.Series) -> Iterator[list[list[bytes]]]:
    """The texts' words; short texts together, a text beyond BATCH_BYTES on its own."""
    held, size = [], 0
    for text in texts:
        data = text.encode()
        if held and size + len(data) > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(data.split())
        size += len(data)
    if held:
        yield held


def found_runs(text: Column, least: int = LEAST) -> Column:
    """Struct of n_words, runs (array of start, length, period; by start, then period) and kept.

    `kept` is the text without the words that a run repeats, one space between words. Null counts as empty.
    """

    @F.pandas_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, kept string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for part in _batches(texts):
                for words, (start, length, period) in zip(part, search(part, least), strict=True):
                    kept = b" ".join(kept_words(words, start, length, period)).decode()
                    rows.append((len(words), start, length, period, kept))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "kept"])

    found = find(F.coalesce(text, F.lit("")))
    runs = F.transform(
        F.arrays_zip(found["starts"].alias("start"), found["lengths"].alias("length"), found["periods"].alias("period")),
        lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")),
    )
    return F.struct(found["n_words"].alias("n_words"), runs.alias("runs"), found["kept"].alias("kept"))


def periodic_runs(
    docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of `docs`: id_col, n_words, runs and kept, as in `found_runs`.

    A run is a stretch of words with least period q, of at least `least` words and two periods, that can't be
    made longer at either end. Every row is searched on its own, so ids may be null or repeat; a null or
    empty text has no words. Columns beyond the two named are not looked at. Work and memory of a
    task follow its longest text: a few numbers per word and, where words repeat, per level of `Extensions`.
    """
    return docs.select(F.col(id_col), found_runs(F.col(text_col), least).alias("found")).select(id_col, "found.*")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids its words with a repeated passage from some word on.

    With h the CRC-32 of the id as text and g = floor(h / 10), if h is divisible by ten: from word a = g mod n
    of n on, word i becomes word a + (i - a) mod p, where p = 1 + floor((n - a) / (3 + g mod 8)). A null id
    or a text without words stays as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    # The words are bound once by a one-element array, or every use of them would cut the text again.
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = lambda w: F.size(w).cast("long")
    a = lambda w: F.pmod(g, n(w))
    p = lambda w: 1 + F.floor((n(w) - a(w)) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    bound = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), a(w).alias("a"), p(w).alias("p")))
    source = lambda b, i: F.when(i < b["a"], i).otherwise(b["a"] + F.pmod(i - b["a"], b["p"]))
    rebuilt = F.transform(
        bound, lambda b: F.array_join(F.transform(b["w"], lambda _, i: F.element_at(b["w"], (source(b, i) + 1).cast("int"))), " ")
    )
    chosen = (F.pmod(h, F.lit(10)) == 0) & text.rlike(WORD)
    return F.when(chosen, F.element_at(rebuilt, 1)).otherwise(text)


def run_digests(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`, with repeated passages planted: its number of runs, the longest, and digests of all.

    Of runs of greatest length the one with the smallest start counts, then that with the smallest period; no
    run gives nulls. Rows without text, repeated rows and null ids are as in `periodic_runs`.
    """
    text = planted(F.col(id_col), F.col(text_col))
    rows = periodic_runs(docs.select(F.col(id_col).alias("id"), text.alias("text")), least, "id", "text")
    order = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return rows.select("id", "runs", "kept", F.array_max(order)["run"].alias("best")).select(
        F.col("id").alias(id_col),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
