"""Personal data: fixed patterns, and a skip-chain random field that keeps a document's labels consistent."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
OTHER = len(KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits, as it would have begun at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MARK = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
SPACE = frozenset(" \t\n\x0b\x0c\r")
EDGE = "\"'.,;:!?<>()[]{}|"
# Features are counted by hash, so that the tables have a fixed size.
FEATURES = 4096
# Digits from which on tokens with equal digits, or as many equal last ones, are held to be similar.
SIMILAR = 7
# Messages are sent until none changes by more than TOLERANCE; ROUNDS only ends those that go on
# swinging in circles of edges.
TOLERANCE = 1e-4
ROUNDS = 1000
# What two tied tokens with one label weigh more than counts alone say, as a logarithm: labels of a
# document agree unless its contexts say otherwise by more than that.
AGREEMENT = 6.0
SURE = 0.95
CLAMP = -50.0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their '@': what may stand ahead of it
    reaches back to the first character that may not, or to the match before."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            last = domain.end()
            found.append((start, last))
        else:
            last = max(last, at)
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns in order; matches that fail their check are dropped."""
    found = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(part) <= 3 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in m[0].split("."))):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


@dataclass
class Node:
    """A token with a digit or '@'. Only these can be personal data; all others are OTHER for certain,
    so they cut the chain and need no nodes."""

    start: int
    end: int
    label: int
    features: list[int]
    follows: bool
    keys: list[str]


def _shape(token: str) -> str:
    runs = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}", runs)


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """The nodes of a whole text. The label is that of the pattern that covers any of it, else OTHER."""
    found: list[Node] = []
    covered = sorted((a, b, k) for k, a, b in base)
    ahead = last = 0
    tail = ""
    for mark in MARK.finditer(text):
        start, end = mark.start(), mark.end()
        while start > last and text[start - 1] not in SPACE:
            start -= 1
        back = start
        while back > last and text[back - 1] in SPACE:
            back -= 1
        word = back
        while word > last and text[word - 1] not in SPACE:
            word -= 1
        while ahead < len(covered) and covered[ahead][1] <= start:
            ahead += 1
        label = covered[ahead][2] if ahead < len(covered) and covered[ahead][0] < end else OTHER
        token = text[start:end].strip(EDGE)
        digits = "".join(c for c in token if "0" <= c <= "9")
        shape = _shape(token)
        names = (f"s{shape}", f"w{text[word:back].lower()}", f"n{len(digits)}{'@' in token}{token.count('.')}")
        # Equal tokens, tokens of equal digits, and places up to which the same digits stand, in this token
        # and those right before it, share a key.
        follows = bool(found) and back == last
        tail = ((tail if follows else "") + digits)[-SIMILAR:]
        keys = [token.lower()] + [digits] * (len(digits) >= SIMILAR) + [f"..{tail}"] * (len(tail) == SIMILAR and bool(digits))
        found.append(Node(start, end, label, [crc32(n.encode("utf-8", "replace")) % FEATURES for n in names], follows, keys))
        last = end
    return found


def edges_of(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours, skip edges between one occurrence of a token and the next.

    Tokens are alike if they are equal or have the same SIMILAR or more digits; linking each to the
    next alone ties all of them together with edges in proportion to the tokens.
    """
    chain = [(i - 1, i) for i, node in enumerate(nodes) if node.follows]
    skip, seen = set(), {}
    for i, node in enumerate(nodes):
        for key in node.keys:
            if key in seen and seen[key] != i:
                skip.add((seen[key], i))
            seen[key] = i
    return chain, sorted(skip)


def hubs_of(nodes: list[Node]) -> list[list[int]]:
    """The places of all occurrences of each token or digits that occur more than once.

    Each list is tied through a hub of its own, so that any two occurrences are two edges apart
    however many there are, with edges in proportion to the tokens. Lists of the same places count once.
    """
    places: dict[str, list[int]] = {}
    for i, node in enumerate(nodes):
        for key in dict.fromkeys(node.keys):
            places.setdefault(key, []).append(i)
    return [list(x) for x in dict.fromkeys(tuple(x) for x in places.values() if len(x) > 1)]


@dataclass
class Field:
    """Log potentials: of labels given each feature, and of the label pairs of chain and skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, nodes: list[Node]) -> np.ndarray:
        """Probabilities of each node's labels after loopy message passing.

        Nodes that a pattern covers are clamped to its label, and hubs of such nodes to their labels.
        All messages of a round are made at once, from those of the round before, and averaged with
        them, which damps circles. A hub without a label hears the mean of its nodes, as repeating a
        token says nothing new about it.
        """
        hubs = hubs_of(nodes)
        own = np.zeros((len(nodes) + len(hubs), LABELS))
        own[: len(nodes)] = [self.unary[n.features].mean(axis=0) for n in nodes]
        for i, members in enumerate([[i] for i in range(len(nodes))] + hubs):
            if labels := [nodes[m].label for m in members if nodes[m].label != OTHER]:
                own[i] = CLAMP
                own[i, labels] = 0
        chain = [(i - 1, i) for i, node in enumerate(nodes) if node.follows]
        skip = [(len(nodes) + hub, m) for hub, members in enumerate(hubs) for m in members]
        if edges := chain + skip:
            pairs = np.array(edges)
            tables = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.roll(np.arange(len(source)), len(edges))
            weight = np.ones((len(source), 1))
            weight[len(edges) + len(chain) :, 0] = [1 / (len(members) - 1) for members in hubs for _ in members]
            messages = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                total = own.copy()
                np.add.at(total, target, weight * messages)
                sent = np.logaddexp.reduce((total[source] - (weight * messages)[back])[:, :, None] + tables, axis=1)
                change = (sent - np.logaddexp.reduce(sent, axis=1, keepdims=True) - messages) / 2
                messages += change
                if np.abs(change).max() <= TOLERANCE:
                    break
            np.add.at(own, target, weight * messages)
        own = own[: len(nodes)]
        return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Tokens that no pattern covers and whose label the field is SURE of; neighbours of a label as one."""
    nodes = nodes_of(text, base)
    if all(n.label != OTHER for n in nodes):
        return []
    belief = field.beliefs(nodes)
    found: list[tuple[int, int, int]] = []
    open_end = -2
    for i, node in enumerate(nodes):
        label = int(belief[i].argmax())
        if node.label != OTHER or label == OTHER or belief[i, label] < SURE:
            open_end = -2
            continue
        token = text[node.start : node.end]
        start, end = node.start + len(token) - len(token.lstrip(EDGE)), node.start + len(token.rstrip(EDGE))
        if open_end == node.start - 1 and found[-1][0] == label:
            found[-1] = (label, found[-1][1], end)
        else:
            found.append((label, start, end))
        open_end = node.end
    return [(label, *_balanced(text, start, end)) for label, start, end in found]


def _balanced(text: str, start: int, end: int) -> tuple[int, int]:
    """A span with the brackets that belong to those in it, where they stand right beside it."""
    inside = text[start:end]
    for left, right in ("()", "[]"):
        more = inside.count(left) - inside.count(right)
        if more < 0 and text[start - 1 : start] == left:
            start -= 1
        elif more > 0 and text[end : end + 1] == right:
            end += 1
    return start, end


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _counts(text: str, seen: Counter) -> None:
    nodes = nodes_of(text, base_spans(text))
    for node in nodes:
        for feature in node.features:
            seen["unary", feature, node.label] += 1
    for name, edges in zip(("chain", "skip"), edges_of(nodes), strict=True):
        for a, b in edges:
            seen[name, nodes[a].label, nodes[b].label] += 1


def trained(docs: DataFrame, text_col: str = "text") -> Field:
    """Piecewise training on all documents, with the patterns as distant labels.

    Each potential is fitted on its own from counts: P(label | feature), and how much more often two
    labels are joined by an edge than they would be by chance. Tasks count; FEATURES * LABELS + 2 *
    LABELS**2 sums at most come to the driver.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            seen = Counter()
            for text in rows["text"]:
                _counts(text, seen)
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["name", "a", "b", "n"])

    texts = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    sums = texts.mapInPandas(counted, "name string, a int, b int, n long").groupBy("name", "a", "b").agg(F.sum("n").alias("n"))
    tables = {"unary": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    for r in sums.collect():
        tables[r.name][r.a, r.b] = r.n
    unary = tables["unary"] + (tables["unary"].sum(axis=0) + 1) / (tables["unary"].sum() + LABELS)

    def pairs(table: np.ndarray) -> np.ndarray:
        both = table + table.T + 0.5
        margin = both.sum(axis=1) / both.sum()
        return np.log(both / both.sum()) - np.log(np.outer(margin, margin))

    skip = pairs(tables["skip"]) + AGREEMENT * np.eye(LABELS)
    return Field(np.log(unary / unary.sum(axis=1, keepdims=True)), pairs(tables["chain"]), skip)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by kind, then start, joined by commas;
    base_sha256 is over the spans of the fixed patterns, of nothing where there are none. `spans` has
    besides what the random field adds. Null texts count as empty; rows are labelled one by one,
    whole, so ids may be null or repeat. Other columns are not read.
    """
    field = trained(docs, text_col)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                spans = joined(base + added_spans(text, base, field))
                rows.append((*(n[k] for k in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), spans))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(id_col), labelled(F.coalesce(F.col(text_col), F.lit(""))).alias("found")).select(id_col, "found.*")
