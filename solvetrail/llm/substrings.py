"""Substring dedup: documents are factored against all reference blocks of the corpus.

The reference is the corpus itself. It is cut into overlapping blocks around words that the text
picks itself: of every LENGTH consecutive words, the k-gram with the least hash is the pick, so equal
stretches have equal picks wherever they stand. A block is a pick and all words a window with that
pick can reach. The index holds every block under its pick and its content.

A document is parsed block by block. A block that another place has too continues the factor: all its
windows repeat. A block whose pick alone is found elsewhere is where a factor begins or ends: there
the factor's boundary is settled window by window, again against every window of that kind in the
corpus. Factors of LENGTH words and more come out as spans; shorter ones have no window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvetrail.llm.scratch import Scratch

LENGTH = 35
# Words of a pick.
GRAM = 16
# Bits of a span for its end.
PLACE = 32

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MASK = (1 << 64) - 1

# An index entry: a pick and its block, or two hashes of a window, of a document (key, size) at a place.
# `run` windows start there. Entries meet in parts.
COLUMNS = ["part", "first", "second", "key", "size", "at", "run", "known"]
ENTRIES = "part long, first long, second long, key long, size int, at int, run int, known int"
# Bits of what is known of an entry. The order matters: of equal entries, sorted, the last has OTHER if any has.
DONE, SAME, OTHER = 1, 2, 4
# What becomes of an entry that is not alone: only its pick is shared; all of it is; all of it is, and
# its windows go to the index for those others that share the pick only.
OPEN, REPEATS, INFORMS = 1, 2, 3


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as they were needed."""

    def __init__(self, base: int):
        self.steps = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            for k, (table, step) in enumerate(zip(self.tables, self.steps, strict=True)):
                self.tables[k] = np.concatenate([table, table * table[-1] * step])
        return self.tables[0][:n], self.tables[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hash:
    """A 64-bit hash of word sequences, for all sequences of a document at once."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.letters = draw.integers(0, MASK, 256, np.uint64, endpoint=True)
        odd = [int(x) | 1 for x in draw.integers(0, MASK, 2, np.uint64, endpoint=True)]
        self.in_words, self.in_texts = map(_Powers, odd)

    def prefix(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Sums over the words before each place, from which `of` takes the hash of any stretch."""
        power, inverse = self.in_words.upto(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * power[:-1], dtype=np.uint64)])
        words = _mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        power, _ = self.in_texts.upto(len(words) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])

    def of(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        _, inverse = self.in_texts.upto(len(prefix))
        return _mixed((prefix[stop] - prefix[start]) * inverse[start])


class Parser:
    """What a document's words look like to the index."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.reach = length - self.gram
        self.one, self.two = _Hash(1), _Hash(2)

    def read(self, text: str) -> Document | None:
        """None if the text has no window."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        space = np.concatenate([[True], SPACE[data], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, stops = edges[::2], edges[1::2]
        return Document(self, data, starts, stops) if len(starts) >= self.length else None


class Document:
    def __init__(self, parser: Parser, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.parser, self.n = parser, len(starts)
        self.one = parser.one.prefix(data, starts, stops)
        at = np.arange(self.n - parser.gram + 1)
        grams = parser.one.of(self.one, at, at + parser.gram)
        views = np.lib.stride_tricks.sliding_window_view(grams, parser.reach + 1)
        #: For each window the place of its pick.
        self.pick = views.argmin(axis=1) + np.arange(len(views))
        self.picks = np.unique(self.pick)
        self.grams = grams[self.picks]
        self._words = data, starts, stops

    @property
    def two(self) -> np.ndarray:
        if not hasattr(self, "_two"):
            self._two = self.parser.two.prefix(*self._words)
        return self._two

    def blocks(self) -> np.ndarray:
        """The hash of each pick's block, which ends where the document does."""
        p = self.parser
        start, stop = np.maximum(self.picks - p.reach, 0), np.minimum(self.picks + p.gram + p.reach, self.n)
        shape = ((self.picks - start) * 64 + stop - self.picks).astype(np.uint64)
        return _mixed(p.two.of(self.two, start, stop) + shape)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each of the windows that start at these places."""
        p = self.parser
        return p.one.of(self.one, at, at + p.length), p.two.of(self.two, at, at + p.length)


def _batch(part, first, second, key, size, at, run, known) -> pa.RecordBatch:
    longs = [pa.array(x.view(np.int64)) for x in (part, first, second)]
    ints = [pa.array(x.astype(np.int32)) for x in (size, at, run, known)]
    return pa.RecordBatch.from_arrays([*longs, pa.array(key.astype(np.int64)), *ints], COLUMNS)


def _entries(first, second, key, size, at, known, by_first: bool) -> pa.RecordBatch:
    """One batch's entries, those that repeat within it thinned out before the shuffle.

    Of equal entries one goes on, marked SAME; the others are DONE. With `by_first`, entries that share
    `first` only have to meet too: one of them goes on under it, and the others, marked OTHER as it is,
    under both hashes. So however frequent an entry is, a batch sends it once.
    """
    order = np.lexsort((second, first))
    first, second, key, size, at, known = (x[order] for x in (first, second, key, size, at, known))
    alike_first = np.concatenate([[False], first[1:] == first[:-1]])
    alike = alike_first & np.concatenate([[False], second[1:] == second[:-1]])
    part = both = _mixed(first + second * np.uint64(3))
    known[np.append(alike[1:], False) & ~alike] |= SAME
    if by_first:
        change = alike_first & ~alike
        mixed = np.zeros(len(first), bool)
        group = np.cumsum(~alike_first) - 1
        mixed[np.unique(group[change])] = True
        known[mixed[group] & ~alike] |= OTHER
        # The entries equal to the first of their group go under `first`, the rest under both.
        past = np.cumsum(change)
        part = np.where(past == past[np.flatnonzero(~alike_first)][group], first, both)
    known[alike] = DONE | SAME
    part = np.where(alike, _mixed(key.view(np.uint64)), part)
    return _batch(part, first, second, key, size, at, np.ones(len(at)), known)


def index_blocks(length: int, gram: int):
    """Entries (pick, block) of documents (key, size, text)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length, gram)
        for batch in batches:
            found = []
            for key, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if document := parser.read(text):
                    n = len(document.picks)
                    found.append((document.grams, document.blocks(), np.full(n, key), np.full(n, size), document.picks))
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield _entries(*columns, np.zeros(len(columns[0]), np.int32), by_first=True)

    return entries


def shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that are not alone, of whole parts sorted by part, first, second and known.

    `known` becomes OPEN, REPEATS or INFORMS. Each entry is compared with its neighbours, so any number
    of equal ones passes through batch by batch. The last row of a batch waits for what follows.
    """
    held = before = None
    earlier = False
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if rows.num_rows > 1:
            judged, earlier = _judged(rows, before, earlier, rows.num_rows - 1)
            yield judged
            before = rows.slice(rows.num_rows - 2, 1)
        held = rows.slice(max(0, rows.num_rows - 1), 1)
    if held is not None and held.num_rows:
        yield _judged(held, before, earlier, 1)[0]


def _judged(rows: pa.RecordBatch, before: pa.RecordBatch | None, earlier: bool, n: int) -> tuple[pa.RecordBatch, bool]:
    """Judge the first `n` rows. `before` is the row before them; `earlier`: ahead of the entries equal
    to it there were others with the same `first`. Returned for the last judged row, too."""
    whole = rows if before is None else pa.concat_batches([before, rows])
    part, first, second = (whole.column(k).to_numpy() for k in range(3))
    group = (first[1:] == first[:-1]) & (part[1:] == part[:-1])
    same = group & (second[1:] == second[:-1])
    # For each row whether, within its group, the content has changed ahead of it.
    place = np.arange(len(part))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], ~group]), place, 0))
    changes = np.cumsum(np.concatenate([[0], (group & ~same).astype(np.int64)]))
    changed = changes > changes[start]
    if before is not None and earlier:
        changed |= start == 0
    skip = 0 if before is None else 1
    own = slice(skip, skip + n)
    known = whole.column(7).to_numpy()[own]
    prev_same, next_same = np.append(False, same)[own], np.append(same, False)[own]
    prev_group, next_group = np.append(False, group)[own], np.append(group, False)[own]
    full = prev_same | next_same | (known & SAME > 0)
    others = changed[own] | (next_group & ~next_same) | (known & OTHER > 0)
    informs = full & others & ~next_same & (known & DONE == 0)
    some = prev_group | next_group | (known & OTHER > 0)
    verdict = np.where(informs, INFORMS, np.where(full, REPEATS, np.where(some, OPEN, 0)))
    out = whole.slice(skip, n)
    out = pa.RecordBatch.from_arrays([*out.columns[:7], pa.array(verdict.astype(np.int32))], COLUMNS)
    return out.filter(pa.array(verdict > 0)), bool(changed[skip + n - 1])


def settle_boundaries(length: int, gram: int):
    """Entries for the windows of documents (key, size, text, marks) whose pick is shared.

    Marks are structs (at, first, known). Windows of repeated blocks are DONE, in runs; those of open
    blocks are looked up, and met there by those of the blocks that inform them.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length, gram)
        for batch in batches:
            looked_up, done = [], []
            bounds = batch.column(3).offsets.to_numpy()
            all_at, all_first, all_known = (x.to_numpy() for x in batch.column(3).values.flatten())
            for row, (key, size, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                document = parser.read(text)
                if not document:
                    continue
                marks = slice(bounds[row], bounds[row + 1])
                at, own = all_at[marks], all_first[marks].view(np.uint64)
                place = np.minimum(np.searchsorted(document.picks, at), len(document.picks) - 1)
                sound = (document.picks[place] == at) & (document.grams[place] == own)
                state = np.zeros(document.n, np.int32)
                np.maximum.at(state, at[sound], all_known[marks][sound])
                state = state[document.pick]
                if len(starts := np.flatnonzero(state == OPEN)):
                    looked_up.append((*document.windows(starts), key, size, starts, 0))
                if len(starts := np.flatnonzero(state == INFORMS)):
                    looked_up.append((*document.windows(starts), key, size, starts, SAME))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], (state >= REPEATS).astype(np.int8), [0]])))
                done += [(key, size, a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            if looked_up:
                one, two, key, size, starts, known = zip(*looked_up, strict=True)
                n = [len(x) for x in starts]
                columns = [np.concatenate(x) for x in (one, two)] + [np.repeat(np.array(x), n) for x in (key, size)]
                yield _entries(*columns, np.concatenate(starts), np.repeat(np.array(known, np.int32), n), by_first=False)
            if done:
                key, size, at, run = (np.array(x, np.int64) for x in zip(*done, strict=True))
                own = _mixed(key.view(np.uint64))
                yield _batch(own, own, at.view(np.uint64), key, size, at, run, np.full(len(at), DONE | SAME))

    return entries


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows that agree in id and text share a key, and no others: the size tells apart what 64 bits might not."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.octet_length(text).alias("size"), text.alias("text"), *more)


def repeated_rows(texts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(key, size) of the rows that agree with another in id and text, written; None if there are none.

    Only keys are shuffled, counted before that. All words of such a row that are in a window go, as the other
    row has it too; so the index needs it once, however often it is there.
    """
    found = texts.groupBy("key", "size").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    again = scratch.keep(found.select("key", "size"), "again")
    return None if again.isEmpty() else again


def duplicate_spans(
    docs: DataFrame, length: int, gram: int, id_col: str, text_col: str, again: DataFrame | None, scratch: Scratch
) -> DataFrame:
    """(key, size, spans) of the documents with words in a window that also starts elsewhere.

    A span is a long, its first word above PLACE bits and the word behind it below; spans are at least
    `length` words long and may overlap. Rows `again`, which are there more than once, come in once.
    """
    texts = _keyed(docs, id_col, text_col)
    if again is not None:
        once = texts.join(again, ["key", "size"], "left_semi").dropDuplicates(["key", "size"])
        texts = texts.join(again, ["key", "size"], "left_anti").unionByName(once)

    def shared(entries: DataFrame) -> DataFrame:
        dealt = entries.repartition("part").sortWithinPartitions("part", "first", "second", "known")
        return dealt.mapInArrow(shared_entries, ENTRIES)

    picks = shared(texts.mapInArrow(index_blocks(length, gram), ENTRIES))
    marks = F.collect_list(F.struct("at", "first", "known")).alias("marks")
    marked = scratch.keep(picks.groupBy("key", "size").agg(marks), "marked")
    known = texts.join(marked, ["key", "size"]).select("key", "size", "text", "marks")
    windows = shared(known.mapInArrow(settle_boundaries(length, gram), ENTRIES)).filter(F.col("known") >= REPEATS)
    at = F.col("at").cast("long")
    span = F.shiftleft(at, PLACE) + at + F.col("run") + (length - 1)
    return scratch.keep(windows.groupBy("key", "size").agg(F.collect_list(span).alias("spans")), "spans")


def _kept(text: str, spans: np.ndarray | None) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the words that stay, joined by spaces."""
    words = text.encode("utf-8", "surrogatepass").split()
    if spans is None or not len(spans):
        return len(words), 0, b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, spans >> PLACE, 1)
    np.add.at(depth, spans & ((1 << PLACE) - 1), -1)
    stays = np.cumsum(depth[:-1]) == 0
    return len(words), int((~stays).sum()), b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


def deduplicated(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: id_col, n_words, n_removed, kept_text.

    Words are what ASCII white space parts. A word goes if some `length` consecutive words around it
    also start at any other place, in the same document or another; all places are judged on the input.
    Rows that agree in id and text are two documents like any others. Null texts have no words. Other
    columns are not read.
    """
    return _judged_documents(docs, length, gram, id_col, text_col, hashed=False)


def deduplicated_digests(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """As `deduplicated`, with kept_sha256 in place of the text."""
    return _judged_documents(docs, length, gram, id_col, text_col, hashed=True)


def _judged_documents(docs, length, gram, id_col, text_col, hashed: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "spans")
    name = "kept_sha256" if hashed else "kept_text"
    texts = _keyed(docs, id_col, text_col, F.col(id_col).alias("id"))
    again = repeated_rows(texts, scratch)
    spans = duplicate_spans(docs, length, gram, id_col, text_col, again, scratch)

    @F.pandas_udf(f"n_words long, n_removed long, {name} string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [_kept(t, s) for t, s in zip(texts, spans, strict=True)]
        last = [hashlib.sha256(k).hexdigest() if hashed else k.decode("utf-8", "surrogatepass") for _, _, k in rows]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "n_removed": [r[1] for r in rows], name: last})

    @F.pandas_udf(f"n_words long, n_removed long, {name} string")
    def emptied(texts: pd.Series) -> pd.DataFrame:
        """What is left of rows that are there twice: nothing, unless they are shorter than a window."""
        rows = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        left = [b"" if len(w) >= length else b" ".join(w) for w in rows]
        last = [hashlib.sha256(k).hexdigest() if hashed else k.decode("utf-8", "surrogatepass") for k in left]
        sizes = [len(w) for w in rows]
        return pd.DataFrame({"n_words": sizes, "n_removed": [n if n >= length else 0 for n in sizes], name: last})

    lone = texts if again is None else texts.join(again, ["key", "size"], "left_anti")
    found = lone.join(spans, ["key", "size"], "left").select("id", kept("text", "spans").alias("kept"))
    if again is not None:
        # Nothing but the text is needed of these, so no key gathers its copies.
        copies = texts.join(again, ["key", "size"], "left_semi").select("id", emptied("text").alias("kept"))
        found = found.unionByName(copies)
    return found.select(F.col("id").alias(id_col), "kept.*")
