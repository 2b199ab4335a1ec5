"""Token counts by byte-pair merging with a heap over a linked list."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies cut a text before they merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same cut for texts below U+0250, where the classes are short: letters, numbers, white space.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LOW_PIECES = rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
HIGH = re.compile(r"[^\x00-\u024f]")
# A worker remembers the counts of so many short pieces, twice.
REMEMBERED = 500_000
SHORT = 48
# Bits of a heap entry for the place; the rank lies above.
PLACE = 32
PLACES = (1 << PLACE) - 1


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level vocabulary: which pair of symbols merges, at which rank, into what."""

    def __init__(self, file: str):
        """`file`: the content of a tokenizer's JSON file."""
        model = json.loads(file)
        if model["normalizer"] or model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters, vocabulary = byte_letters(), model["model"]["vocab"]
        self.byte_symbol = [0] * 256
        for letter, byte in letters.items():
            self.byte_symbol[byte] = vocabulary[letter]
        # For each left symbol: right symbol to rank, shifted to leave room for a place.
        self.pairs: list[dict[int, int]] = [{}] * len(vocabulary)
        self.merged: list[int] = []
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if not self.pairs[vocabulary[left]]:
                self.pairs[vocabulary[left]] = {}
            self.pairs[vocabulary[left]].setdefault(vocabulary[right], rank << PLACE)
            self.merged.append(vocabulary[left + right])
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pieces, self.low_pieces = regex.compile(PIECES), re.compile(LOW_PIECES)
        self.counts = _Remembered(self._tokens)

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string in it counts as that one token."""
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        pieces = self.pieces if HIGH.search(text) else self.low_pieces
        return sum(map(self.counts.__getitem__, pieces.findall(text)))

    def _tokens(self, piece: str) -> int:
        symbols = [self.byte_symbol[b] for b in piece.encode()]
        return len(symbols) - self.merges(symbols)

    def merges(self, symbols: list[int]) -> int:
        """How many merges a piece takes; `symbols` is used up.

        The heap holds adjacent pairs by rank, then place. The list is linked by the places of the
        next and the previous symbol; a merge leaves its symbol at the left place.
        """
        pairs, merged_of, n, done = self.pairs, self.merged, len(symbols), 0
        heap, left = [], symbols[0] if n else 0
        for at in range(1, n):
            right = symbols[at]
            if right in (found := pairs[left]):
                heap.append(found[right] + at - 1)
            left = right
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-1)  # what the last symbol has next, for ever
        while heap:
            entry = heappop(heap)
            at = entry & PLACES
            other = after[at]
            if symbols[at] < 0 or pairs[symbols[at]].get(symbols[other]) != entry - at:
                continue  # one of the two has merged meanwhile
            done += 1
            merged = symbols[at] = merged_of[entry >> PLACE]
            symbols[other] = -1
            follower = after[at] = after[other]
            if follower < n:
                before[follower] = at
                if (found := pairs[merged].get(symbols[follower])) is not None:
                    heappush(heap, found + at)
            leader = before[at]
            if leader >= 0 and (found := pairs[symbols[leader]].get(merged)) is not None:
                heappush(heap, found + leader)
        return done


class _Remembered(dict):
    """Counts by piece. Short pieces are remembered, those not met for long are forgotten."""

    def __init__(self, count):
        super().__init__()
        self.count, self.older = count, {}

    def __missing__(self, piece: str) -> int:
        if (found := self.older.get(piece)) is None:
            found = self.count(piece)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


@lru_cache(maxsize=2)
def _merges(file: str) -> Merges:
    return Merges(file)


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of each whole text as the byte-level vocabulary at path `tokenizer` gives them.

    No begin, end or added tokens, no truncation. Null counts as empty, which has none. The driver
    reads the vocabulary file (one or two MB, of fixed size) and sends it along.
    """
    with open(tokenizer, encoding="utf-8") as source:
        file = source.read()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = _merges(file)
        for texts in batches:
            yield pd.Series([merges.count(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of `docs`: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Every row is counted on its own, so ids may be null or repeat; null texts count as empty.
    """
    return docs.select(
        F.col(id_col),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        token_count(F.col(text_col), tokenizer).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
