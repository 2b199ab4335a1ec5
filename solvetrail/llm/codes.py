"""Vectors as short codes: product quantisation by Lloyd rounds that look at active entries only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvetrail.llm.scratch import Scratch

PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Components become whole numbers of this many to the unit.
SCALE = 1024
# Labels' sums meet their rows in this many portions, as one label may have a third of all rows.
PORTIONS = 64
# Rows whose distances are held at once.
BLOCK = 8192
# Whole numbers up to this are exact as doubles.
EXACT = 2**53


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to entries, one column per entry."""
    reach = int(np.abs(rows).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if reach * reach * max(rows.shape[1], 1) < EXACT:
        # All terms and sums are whole numbers below 2**53: the products are exact.
        a, b = rows.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    if reach * reach * max(rows.shape[1], 1) >= 2**63:
        raise ValueError("components so large that their squared distances are beyond a long")
    found = np.zeros((len(rows), len(entries)), np.int64)
    for k in range(rows.shape[1]):
        found += (rows[:, k, None] - entries[None, :, k]) ** 2
    return found


@dataclass(frozen=True)
class Codebook:
    """One part's entries, and which of them moved since the assignment before; at first all count as moved."""

    entries: np.ndarray
    moved: np.ndarray

    def assign(self, rows: np.ndarray, entry: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and its squared distance per row, given those of the assignment before.

        Where the assigned entry stayed, its stored distance still holds and no other entry that stayed is
        nearer, so only moved ones are compared. Where it moved, all entries are. Of equally near ones the
        lowest counts. An entry of -1 stands for none.
        """
        entry, error = entry.copy(), error.copy()
        stayed = (entry >= 0) & ~self.moved[entry]
        moved, here = np.flatnonzero(self.moved), np.flatnonzero(stayed)
        if len(moved):
            for at in range(0, len(here), BLOCK):
                part = here[at : at + BLOCK]
                distance = squared(rows[part], self.entries[moved])
                nearest = distance.argmin(axis=1)
                least, number = distance[np.arange(len(part)), nearest], moved[nearest]
                better = (least < error[part]) | ((least == error[part]) & (number < entry[part]))
                entry[part[better]], error[part[better]] = number[better], least[better]
        rest = np.flatnonzero(~stayed)
        for at in range(0, len(rest), BLOCK):
            part = rest[at : at + BLOCK]
            distance = squared(rows[part], self.entries)
            nearest = distance.argmin(axis=1)
            entry[part], error[part] = nearest, distance[np.arange(len(part)), nearest]
        return entry, error

    def after(self, counts: np.ndarray, sums: np.ndarray) -> Codebook:
        """Entries replaced by the mean of their rows, rounded down; those without rows stay."""
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = sums[used] // counts[used, None]
        return Codebook(entries, (entries != self.entries).any(axis=1))


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (vec_id, label, vector) with whole-number components, without those that can't have any."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    rows = rows.withColumn("label", F.col("label").cast("int")) if dict(rows.dtypes)["label"] == "void" else rows
    rows = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(sound(x), F.lit(False))))
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE).cast("long")))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones are filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(vectors), width), np.int64)
    rows[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
    return rows


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))


def _assigned(state: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    """The state after one more assignment."""
    size = width // len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["vector"], width)
            entries, errors = (_matrix(batch[name], len(books)) for name in ("entries", "errors"))
            for k, book in enumerate(books):
                part = vectors[:, k * size : (k + 1) * size]
                entries[:, k], errors[:, k] = book.assign(part, entries[:, k], errors[:, k])
            done = [_lists(entries, pa.int32()), _lists(errors, pa.int64())]
            columns = [batch["vec_id"], batch["label"], batch["vector"], *done]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "entries", "errors"])

    return state.mapInArrow(assign, state.schema)


def _sums(state: DataFrame, parts: int, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows per part and entry, and the sums of their components.

    Every task adds up its own rows, so that it sends one row per part and entry at most, and as many come to
    the driver: as many numbers as the codebooks have.
    """
    size = width // parts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, count), np.int64), np.zeros((parts, count, size), np.int64)
        for batch in batches:
            vectors, entries = _matrix(batch["vector"], width), _matrix(batch["entries"], parts)
            for k in range(parts):
                np.add.at(counts[k], entries[:, k], 1)
                np.add.at(sums[k], entries[:, k], vectors[:, k * size : (k + 1) * size])
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), _lists(sums[part, entry], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    partial = state.select("vector", "entries").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    columns = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    counts, sums = np.zeros((parts, count), np.int64), np.zeros((parts, count, size), np.int64)
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect():
        counts[row.part, row.entry], sums[row.part, row.entry] = row.n, row[3:]
    return counts, sums


def trained(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, vector, entries, errors), one per kept vector, and every part's final entries.

    Vectors that are null or hold a null or a component that is not finite are dropped. Components become
    whole numbers. A vector is cut into equal parts; one shorter than the longest, or than the next multiple of
    `parts`, counts as filled up with zeros. The codebooks start as the parts of the vectors with the least ids
    (nulls last; of one id the lesser vector first; repeated rows count each). A round assigns every part to its
    nearest entry and replaces the entries by the means of their parts; a last assignment follows.

    Codebooks have a fixed size and go to every task. Entries and distances of the assignment before are kept
    in a written table per round, so a lost executor costs its tasks and no round.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = whole_vectors(vectors, id_col, vector_col, label_col)
    none = F.array_repeat(F.lit(-1), parts)
    state = scratch.keep(rows.select("*", none.alias("entries"), none.cast("array<long>").alias("errors")), "start")
    longest = state.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    seeds, size = np.array([[*r.vector, *[0] * (width - len(r.vector))] for r in first], np.int64).reshape(len(first), width), width // parts
    books = [Codebook(seeds[:, k * size : (k + 1) * size], np.ones(len(seeds), bool)) for k in range(parts)]
    before = "start"
    for place in range(rounds + 1 if len(seeds) else 0):
        state = scratch.keep(_assigned(state, books, width), f"round-{place}")
        scratch.drop(before)
        before = f"round-{place}"
        if place < rounds:
            counts, sums = _sums(state, parts, len(seeds), width)
            books = [book.after(counts[k], sums[k]) for k, book in enumerate(books)]
    return state, [book.entries for book in books]


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers with commas between, by part, entry, place."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compressed(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per kept vector: id_col, code (two hexadecimal digits a part), error, label_error, codebooks_sha256.

    `error` is the squared distance to the entries of the code, `label_error` its sum over the rows of the same
    label, those without label together. What is kept, and how odd vectors count, is said at `trained`; an
    empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits a part: 1 to 256 entries")
    state, books = trained(vectors, parts, entries, rounds, id_col, vector_col, label_col)
    digit = lambda e: F.lpad(F.lower(F.hex(e.cast("long"))), 2, "0")
    loss = F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = state.select(
        "vec_id",
        "label",
        F.array_join(F.transform("entries", digit), "").alias("code"),
        loss.alias("error"),
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(PORTIONS)).cast("int").alias("portion"),
    )
    totals = state.groupBy(F.col("label").alias("same")).agg(F.sum(loss).alias("label_error"))
    totals = totals.select("same", "label_error", F.explode(F.sequence(F.lit(0), F.lit(PORTIONS - 1))).alias("share"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("same")) & (F.col("portion") == F.col("share"))).select(
        F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )
