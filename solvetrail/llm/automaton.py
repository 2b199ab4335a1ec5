"""Byte-pair encoding by an automaton over tokens, built from the merges one gadget at a time."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvetrail.llm.bpe import HIGH, _L, _N, _S, _Remembered, byte_letters

# A worker remembers so many transitions.
TRANSITIONS = 2_000_000
NEVER = 1 << 60
# Fixed value: how the vocabulary cuts a text into words. Below U+0250 the classes are short.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOW_CUT = rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"


class Automaton:
    """Accepts, of all token sequences, those that merging by rank gives.

    It starts with one state on which every symbol loops. The gadget of a merge (u, v) looks at the
    state q that u leads to. If v leaves q, then u gets a copy of q without the arc v as its new
    target, and next to every arc u there is now an arc uv to where v led. All arcs of one token
    thereby lead to one state, so a state is named by the token that leads to it, and 0 is the start.

    Copies are not written out: `cut[u]` has the arcs that the gadgets took from u's state, with the
    number of the gadget. The state of a token began as the state of its right part at the moment it
    was made, so it also lacks what was cut there before, and so on down `ends`. An arc uv is there
    where u was when uv was made, so `heads` says which cuts of left parts it inherits. `arc` reads
    the transition off these tables; transitions met are remembered, as the full table would have
    one cell per pair of tokens.
    """

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]], suffix: str = ""):
        """`symbols` in order of their numbers is given by the caller; merge k makes symbol len(symbols) + k."""
        self.labels = [*symbols]
        self.suffix = suffix
        number = {label: i + 1 for i, label in enumerate(symbols)}
        self.made = [0] * (len(symbols) + 1)
        # (token, moment up to which its cuts count), from the token itself down its right or left parts.
        self.ends: list[list[tuple[int, int]]] = [[(i, NEVER)] for i in range(len(symbols) + 1)]
        self.heads: list[list[tuple[int, int]]] = [[(i, NEVER)] for i in range(len(symbols) + 1)]
        self.ends[0] = []
        self.cut: list[dict[int, int]] = [{} for _ in range(len(symbols) + 1)]
        self.live = [True] * (len(symbols) + 1)
        for moment, (left, right) in enumerate(merges, 1):
            u, v, label = number.get(left), number.get(right), left + right
            if u is None or v is None or label in number:
                raise ValueError(f"merge {moment}: its parts must be there and its whole must be new")
            w = number[label] = len(self.made)
            self.labels.append(label)
            self.made.append(moment)
            self.cut.append({})
            self._gadget(u, v, w, moment)
        self.known: dict[int, bool] = {}
        self._trie()

    def _gadget(self, u: int, v: int, w: int, moment: int) -> None:
        present = self.live[u] and self.live[v] and self.arc(u, v)
        self.live.append(present)
        if present:
            self.cut[u][v] = moment
        # The new arc leads where v led before this cut, and is where u still is after it.
        self.ends.append([(w, NEVER), *((y, min(until, moment)) for y, until in self.ends[v])])
        self.heads.append([(w, NEVER), *((x, min(until, moment + 1)) for x, until in self.heads[u])])

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token; it then leads to the token's state."""
        heads = self.heads[token]
        for end, until in self.ends[state]:
            if cut := self.cut[end]:
                for head, before in heads:
                    moment = cut.get(head)
                    if moment is not None and moment < until and moment < before:
                        return False
        return True

    def _trie(self) -> None:
        """Tokens by their symbols, so that those which start at a place are found in one walk."""
        size = len(self.suffix)
        self.sizes, self.root = [0], {}
        for token, label in enumerate(self.labels, 1):
            body = label[: -size] if size and label.endswith(self.suffix) and len(label) > size else label
            letters = [*body]
            if len(body) < len(label):
                letters[-1] += self.suffix
            self.sizes.append(len(letters))
            if self.live[token]:
                node = self.root
                for letter in letters:
                    node = node.setdefault(letter, {})
                node[""] = token
        self.longest = max(self.sizes)

    def _from(self, letters: list[str], place: int) -> list[int]:
        """The tokens that start at a place, the longest last."""
        found, node = [], self.root
        for letter in letters[place : place + self.longest]:
            if (node := node.get(letter)) is None:
                break
            if token := node.get(""):
                found.append(token)
        return found

    def encode(self, letters: list[str]) -> list[int]:
        """The accepted token sequence that spells these symbols; numbers are as in `labels`, from 1.

        Every beginning of a word has one such sequence, so a place is entered by one token at most:
        the longest token is tried first, and a place from which no way leads on is not entered twice.
        """
        size, known, sizes = len(letters), self.known, self.sizes
        tokens, places, choices, dead = [0], [0], [self._from(letters, 0)], set()
        while places[-1] < size:
            state, place, options = tokens[-1], places[-1], choices[-1]
            while options:
                token = options.pop()
                after = place + sizes[token]
                if after in dead:
                    continue
                key = state << 32 | token
                there = known.get(key)
                if there is None:
                    if len(known) >= TRANSITIONS:
                        known.clear()
                    there = known[key] = self.arc(state, token)
                if there:
                    tokens.append(token)
                    places.append(after)
                    choices.append(self._from(letters, after))
                    break
            else:
                if not place:
                    raise ValueError(f"no token sequence spells {letters!r}")
                dead.add(place)
                tokens.pop(), places.pop(), choices.pop()
        return tokens[1:]

    def decode(self, tokens: list[int]) -> list[str]:
        """The labels of the arcs that these tokens take."""
        return [self.labels[token - 1] for token in tokens]


class Words:
    """A vocabulary of lower-case words with an end mark: how texts are cut, and the automaton."""

    def __init__(self, file: str):
        """`file`: the content of a tokenizer's JSON file."""
        kept = json.loads(file)
        model, (cut, byte_level) = kept["model"], kept["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in kept["normalizer"]["normalizers"]]
        plain = not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges"))
        if (
            not plain or model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or kept["decoder"] is not None
            or (cut["type"], cut["behavior"], cut["invert"]) != ("Split", "Removed", True)
            or byte_level["type"] != "ByteLevel" or byte_level["use_regex"] or byte_level["add_prefix_space"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in kept["added_tokens"])
        ):
            raise ValueError("not a vocabulary of lower-case words over bytes")
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = [*byte_letters()]
        symbols = [*letters, *(x + suffix for x in letters)] if suffix else letters
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.automaton = Automaton(symbols, merges, suffix)
        # Numbers of the automaton to ids of the vocabulary, and back.
        self.ids = [-1, *(vocabulary[label] for label in self.automaton.labels)]
        self.tokens = {i: token for token, i in enumerate(self.ids) if token}
        self.letter = [""] * 256
        for letter, byte in byte_letters().items():
            self.letter[byte] = letter
        self.suffix = suffix
        if cut["pattern"]["Regex"] != CUT:
            raise ValueError("the vocabulary cuts words in another way")
        self.pieces, self.low_pieces = regex.compile(CUT), re.compile(LOW_CUT)
        # Where Unicode versions differ the library that the file is for has the last word.
        self.newer, self.own = _unassigned(), Tokenizer.from_str(file)
        self.specials = {t["content"]: t["id"] for t in kept["added_tokens"]}
        self.contents = {i: content for content, i in self.specials.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.written_words = _Remembered(self._written)

    def words(self, text: str) -> list[str]:
        """The text in lower case, cut into words; what is between them is gone."""
        if not HIGH.search(text):
            lower = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            return (self.pieces if HIGH.search(lower) else self.low_pieces).findall(lower)
        if self.newer[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            lower = self.own.normalizer.normalize_str(text)
            letters = {letter: bytes([b]) for b, letter in enumerate(self.letter)}
            cut = (word for word, _ in self.own.pre_tokenizer.pre_tokenize_str(lower))
            return [b"".join(map(letters.__getitem__, word)).decode() for word in cut]
        # Letters are lowered one by one: a sigma at a word's end is like any other.
        return self.pieces.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text and the special tokens' strings between them."""
        if self.special is None or not any(s in text for s in self.specials):
            yield text, False
            return
        for i, part in enumerate(self.special.split(text)):
            if part:
                yield part, i % 2 == 1

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word."""
        letters = [self.letter[b] for b in word.encode()]
        letters[-1] += self.suffix
        return [self.ids[token] for token in self.automaton.encode(letters)]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; a special token's string in it is that token."""
        found: list[int] = []
        for part, special in self.parts(text):
            if special:
                found.append(self.specials[part])
            else:
                for word in self.words(part):
                    found.extend(self.encode_word(word))
        return found

    def label(self, token_id: int) -> str:
        return self.contents.get(token_id) or self.automaton.labels[self.tokens[token_id] - 1]

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids' arcs, one space between them."""
        return " ".join(map(self.label, ids))

    def _written(self, word: str) -> tuple[int, str, str]:
        ids = self.encode_word(word)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def written(self, text: str) -> tuple[int, str, str]:
        """Ids of a whole text: how many, the ids as text, and what they decode to."""
        found: list[tuple[int, str, str]] = []
        for part, special in self.parts(text):
            if special:
                found.append((1, str(self.specials[part]), part))
            else:
                found.extend(map(self.written_words.__getitem__, self.words(part)))
        if not found:
            return 0, "", ""
        sizes, ids, labels = zip(*found, strict=True)
        return sum(sizes), " ".join(ids), " ".join(labels)


def _unassigned() -> np.ndarray:
    """Per code point whether our Unicode version does not know it; another one may."""
    return np.array([unicodedata.category(chr(code)) == "Cn" for code in range(sys.maxunicode + 1)])


@lru_cache(maxsize=2)
def words_of(file: str) -> Words:
    return Words(file)


def read_vocabulary(tokenizer: str) -> str:
    """The content of a vocabulary file, one or two MB of fixed size; the driver sends it along."""
    with open(tokenizer, encoding="utf-8") as source:
        return source.read()


def token_ids(text: Column, tokenizer: str) -> Column:
    """The ids of each whole text, an array of ints; null counts as empty, which has none."""
    file = read_vocabulary(tokenizer)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = words_of(file)
        for texts in batches:
            yield pd.Series([words.encode(t) for t in texts], dtype=object)

    return encode(F.coalesce(text, F.lit("")))


def decoded(ids: Column, tokenizer: str) -> Column:
    """What each array of ids decodes to; a null array counts as empty."""
    file = read_vocabulary(tokenizer)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = words_of(file)
        for rows in batches:
            yield pd.Series([words.decode([int(i) for i in row]) for row in rows], dtype=object)

    return decode(F.coalesce(ids, F.array().cast("array<int>")))


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id_col, n_tokens, and the SHA-256 of the ids as text and of what they decode to.

    The same as hashing `token_ids` joined by spaces and `decoded` of them, but ids and decoded texts
    stay in the task that made them. Every row is on its own, so ids may be null or repeat; null and
    empty texts have no tokens. Columns beyond the two named are not looked at. A text is held whole
    with its tokens, so a task's memory follows its longest text.
    """
    file = read_vocabulary(tokenizer)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = words_of(file)
        for texts in batches:
            rows = []
            for text in texts:
                n, ids, labels = words.written(text)
                rows.append((n, digest(ids), digest(labels)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = digests(F.coalesce(F.col(text_col), F.lit(""))).alias("found")
    return docs.select(F.col(id_col), found).select(id_col, "found.*")
