"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvetrail.llm.scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"
# Rows of one group are compared in so many parts before the parts are.
PARTS = 64


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of `docs`, with the row of its group that stays.

    Rows belong together when their texts are equal without ASCII white space. Of a group the row
    with the longest original text stays, then the one with the smallest id; null ids come last. Of
    repeated rows that agree in id and length one stays. Empty and null texts are one group. Other
    columns of `docs` are not read.

    Returns id_col, keep_id, group_size, kept, text_sha256.

    Only hashes are grouped, after rows with equal id and content were folded. Then the bytes are
    compared: a digest whose least and greatest text differ covers more than one text, and its rows
    are grouped by the text itself. `digest` makes the content hash of a squeezed text.
    """
    found = _decisions(docs, id_col, text_col, digest)
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _decisions(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "exact")
    norm = squeezed(F.col(text_col))
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
    )
    rows = scratch.keep(
        texts.select("id", "size", "digest", F.unhex(F.sha2("norm", 256)).alias("sha"))
        .groupBy("id", "size", "digest", "sha")
        .agg(F.count(F.lit(1)).alias("copies")),
        "rows",
    )
    repeated = scratch.keep(
        rows.groupBy("digest").agg(F.sum("copies").alias("n")).filter("n > 1").select("digest"), "repeated"
    )
    collided = scratch.keep(_with_two_texts(texts.join(repeated, "digest", "left_semi")), "collided")
    rows = rows.withColumn("part", F.lit(""))
    if not collided.isEmpty():
        apart = (
            texts.join(collided, "digest", "left_semi")
            .groupBy("id", "size", "digest", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("norm").alias("part"))
            .agg(F.count(F.lit(1)).alias("copies"))
        )
        rows = rows.join(collided, "digest", "left_anti").unionByName(apart)

    first = F.min(F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    groups = scratch.keep(
        rows.groupBy("digest", "part")
        .agg(F.sum("copies").alias("group_size"), first.alias("first"))
        .filter("group_size > 1")
        .select("digest", "part", "group_size", F.col("first.id").alias("keep"), (-F.col("first.less")).alias("most")),
        "groups",
    )
    alone = F.col("group_size").isNull()
    stays = alone | (F.col("id").eqNullSafe(F.col("keep")) & (F.col("size") == F.col("most")))
    return (
        rows.join(groups, ["digest", "part"], "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            "id",
            "size",
            "sha",
            "copies",
            F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (stays & (F.col("copy") == 1)).alias("kept"),
        )
    )


def _with_two_texts(texts: DataFrame) -> DataFrame:
    """The digests that more than one text has. A large group is folded in parts first."""
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    return (
        texts.groupBy("digest", part.alias("salt"))
        .agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
        .groupBy("digest")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"))
        .filter("least < most")
        .select("digest")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Of rows that agree in id, length and squeezed text any one stays.
    """
    kept = _decisions(docs, id_col, text_col, content_hash).filter("kept")
    kept = kept.select("id", "size", "sha", "copies").alias("kept")
    text = F.col(f"docs.`{text_col}`")
    same = (
        F.col(f"docs.`{id_col}`").eqNullSafe(F.col("kept.id"))
        & (F.char_length(F.coalesce(text, F.lit(""))) == F.col("kept.size"))
        & (F.unhex(F.sha2(squeezed(text), 256)) == F.col("kept.sha"))
    )
    row = F.struct(*(F.col(f"docs.`{c}`") for c in docs.columns)).alias("row")
    found = docs.alias("docs").join(kept, same).select(row, "kept.*")
    lone = found.filter("copies = 1").select("row.*")
    repeated = found.filter("copies > 1").groupBy("id", "size", "sha").agg(F.first("row").alias("row"))
    return lone.unionByName(repeated.select("row.*"))
