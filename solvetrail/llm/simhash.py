"""SimHash near-dedup: fingerprints meet on the variants that both can reach."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvetrail.llm.components import components
from solvetrail.llm.scratch import Scratch

SEED = 42
BITS = 64
# Blocks of a fingerprint, one of which is left out of a variant.
BLOCKS = 4
WIDTH = BITS // BLOCKS
KEPT = BITS - WIDTH
DISTANCE = 3
# Hashes whose bits are counted at a time; fingerprints whose variants are made at a time.
HASHES_AT_ONCE = 1 << 16
PRINTS_AT_ONCE = 1 << 10

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
VARIANTS = "key long, rest int"
PAIRS = "a long, b long"


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text.

    Words are what ASCII white space parts, A-Z lower-cased. A bit is set if it is set in over half
    of the shingles' XXH64; a text of fewer words is one shingle, a text of none gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        shingles = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
        shingles = [line[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    sums = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprints of a text column as signed longs; null counts as empty."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return prints(F.coalesce(text, F.lit("")))


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All variants of distinct fingerprints (column `print`), (1 + KEPT) * BLOCKS of each.

    A variant leaves out one block and flips at most one of the other bits. `key` is the block's
    number above the other bits; `rest` is the block's own bits below the flipped bit's number, from
    1 on, or 0 for none.
    """
    flips = np.concatenate(([0], 1 << np.arange(KEPT, dtype=np.uint64))).astype(np.uint64)
    number = np.arange(KEPT + 1, dtype=np.int32) << WIDTH
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), PRINTS_AT_ONCE):
            part = prints[at : at + PRINTS_AT_ONCE]
            keys, rests = [], []
            for block in range(BLOCKS):
                low = np.uint64(block * WIDTH)
                below = part & np.uint64((1 << int(low)) - 1)
                above = (part >> low) >> np.uint64(WIDTH)
                own = ((part >> low) & np.uint64((1 << WIDTH) - 1)).astype(np.int32)
                kept = np.uint64(block << KEPT) | (above << low) | below
                keys.append((kept[:, None] ^ flips).ravel())
                rests.append((own[:, None] | number).ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rests))], ["key", "rest"]
            )


def _prints(keys: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """The fingerprints that made these variants."""
    block, flip = keys >> np.uint64(KEPT), (rests >> WIDTH).astype(np.uint64)
    kept = keys & np.uint64((1 << KEPT) - 1)
    kept ^= np.where(flip > 0, np.uint64(1) << np.maximum(flip, np.uint64(1)) - np.uint64(1), np.uint64(0))
    low = block * np.uint64(WIDTH)
    below = kept & ((np.uint64(1) << low) - np.uint64(1))
    own = (rests & ((1 << WIDTH) - 1)).astype(np.uint64) << low
    # Shifts of 64 are undefined, hence two.
    return ((kept >> low) << low << np.uint64(WIDTH)) | own | below


def colliding_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that connect all fingerprints of a bucket which are within DISTANCE of each other there.

    `batches` hold whole buckets, sorted by key. A bucket has the fingerprints that share a
    variant: those with equal left-out bits differ in two others at most, so they all hang on the
    first of them, and only these firsts are compared. A bucket of m members gives under m pairs.
    Its size is bounded by (1 + KEPT) << WIDTH distinct fingerprints, whatever the input.
    """
    left_keys, left_rests = np.empty(0, np.int64), np.empty(0, np.int32)
    for batch in batches:
        keys = np.concatenate([left_keys, batch.column(0).to_numpy(zero_copy_only=False)])
        rests = np.concatenate([left_rests, batch.column(1).to_numpy(zero_copy_only=False)])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        left_keys, left_rests = keys[cut:], rests[cut:]
        yield from _bucket_pairs(keys[:cut], rests[:cut])
    yield from _bucket_pairs(left_keys, left_rests)


def _bucket_pairs(keys: np.ndarray, rests: np.ndarray) -> Iterator[pa.RecordBatch]:
    same = keys[1:] == keys[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(keys) else np.empty(0, bool)
    keys, rests = keys[shared], rests[shared]
    if not len(keys):
        return
    own = rests & ((1 << WIDTH) - 1)
    order = np.lexsort((rests >> WIDTH, own, keys))
    keys, rests, own = keys[order], rests[order], own[order]
    prints = _prints(keys.view(np.uint64), rests).view(np.int64)
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    new_class = new_key | np.concatenate([[True], own[1:] != own[:-1]])
    place = np.arange(len(keys))
    first = np.maximum.accumulate(np.where(new_class, place, 0))
    pairs = [(prints[~new_class], prints[first[~new_class]])]

    # One row per class now; `exact`: a member of the class is the variant itself, without a flip.
    firsts = place[new_class]
    exact, own, key_of = rests[firsts] >> WIDTH == 0, own[firsts], np.cumsum(new_key)[firsts]
    starts = np.flatnonzero(np.concatenate([[True], key_of[1:] != key_of[:-1]]))
    sizes = np.diff(np.append(starts, len(key_of)))
    two = starts[sizes == 2]
    near = np.bitwise_count(own[two] ^ own[two + 1]) <= 1 + exact[two].astype(int) + exact[two + 1]
    pairs.append((prints[firsts[two[near] + 1]], prints[firsts[two[near]]]))
    for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        to = at + _hang(own[at : at + size], exact[at : at + size])
        moved = to != np.arange(at, at + size)
        pairs.append((prints[firsts[at : at + size][moved]], prints[firsts[to[moved]]]))
    a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


_BALL = np.array([0] + [sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(WIDTH), n)], np.int32)
_WEIGHT = np.bitwise_count(_BALL).astype(int)


def _hang(own: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """For each class of one bucket, the place of a class it is linked with; its own for the first met.

    The links found connect all classes that any links connect.
    Two classes connect if their left-out bits differ in one place, in two if one of them is exact,
    in three if both are. Each class looks up the values around it, so the work is in proportion to
    the classes.
    """
    at = np.full(1 << WIDTH, -1)
    at[own] = np.arange(len(own))
    to = np.full(len(own), -1)
    for start in range(len(own)):
        if to[start] >= 0:
            continue
        to[start], queue = start, [start]
        while queue:
            here = queue.pop()
            there = at[own[here] ^ _BALL]
            met = (there >= 0) & (_WEIGHT <= 1 + int(exact[here]) + exact[there])
            for other in there[met].tolist():
                if to[other] < 0:
                    to[other] = here
                    queue.append(other)
    return to


def linked(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of the distinct fingerprints in column `print` that links of DISTANCE bits connect.

    Two fingerprints that differ in at most three bits differ in at most two outside some block, so
    flipping at most one bit of either makes them meet: that is the middle.
    """
    # A fixed number of parts, which is not merged: the rows here are small, their variants many.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = prints.select("print").repartition(parts, "print").mapInArrow(variants, VARIANTS)
    met = emitted.repartition("key").sortWithinPartitions("key").mapInArrow(colliding_pairs, PAIRS)
    pairs = met.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return components(pairs, scratch)


def near_groups(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id_col, fingerprint (16 hex digits), component_id.

    Rows are linked if their fingerprints differ in at most DISTANCE bits; component_id is the
    smallest id that links reach, null only where no reachable row has an id. Empty and null texts
    and texts of white space have fingerprint 0, which is linked like any other.
    """
    rows, groups = _grouped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle)
    return rows.join(groups, "print", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.coalesce("least", "id").alias("component_id"),
    )


def _grouped(texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest of the text, print), and for each print that more than one row reaches
    the least id of its component (least) and the least row with it (first)."""
    scratch = Scratch(texts.sparkSession, "simhash")
    rows = scratch.keep(
        texts.select(
            "id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), fingerprint(F.col("text"), shingle).alias("print")
        ),
        "rows",
    )
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    single = scratch.keep(
        rows.groupBy("print").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")), "prints"
    )
    labels = linked(single, scratch).withColumnRenamed("node", "print")
    labelled = scratch.keep(
        single.join(labels, "print", "left").select("print", "first", "n", F.coalesce("label", "print").alias("label")),
        "labelled",
    )
    whole = labelled.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1")
    groups = scratch.keep(
        labelled.select("print", "label")
        .join(whole, "label")
        .select("print", F.col("first.id").alias("least"), F.col("first.digest").alias("digest")),
        "groups",
    )
    return rows, groups


def one_per_group(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which one per group stays: the one with the smallest id.

    Of rows that agree in that id, the one whose text has the least MD5 stays; of rows that agree in
    id and text any one.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, groups = _grouped(texts, shingle)
    first = F.col("id").eqNullSafe(F.col("least")) & (F.col("digest") == F.col("best"))
    kept = (
        rows.join(groups.withColumnRenamed("digest", "best"), "print", "left")
        .filter(F.col("best").isNull() | first)
        .groupBy("id", "digest")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    text = F.col(f"docs.`{text_col}`")
    same = F.col(f"docs.`{id_col}`").eqNullSafe(F.col("kept.id")) & (
        F.unhex(F.md5(F.coalesce(text, F.lit("")))) == F.col("kept.digest")
    )
    row = F.struct(*(F.col(f"docs.`{c}`") for c in docs.columns)).alias("row")
    found = docs.alias("docs").join(kept.alias("kept"), same).select(row, "kept.*")
    lone = found.filter("copies = 1").select("row.*")
    repeated = found.filter("copies > 1").groupBy("id", "digest").agg(F.first("row").alias("row"))
    return lone.unionByName(repeated.select("row.*"))
