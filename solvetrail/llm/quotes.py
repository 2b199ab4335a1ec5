"""Quotation linking: replies are tied to the messages they quote and freed of the quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvetrail.llm.components import roots
from solvetrail.llm.scratch import Scratch

# Quote marks at the start of a line, one per level, with blanks between.
MARKS = r"^((?:[ \t]*>)+)[ \t]?"
SPACES = r"[\x20\x09-\x0D]+"
AROUND = r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"
# Turns that are searched together; what lies before is known by its last turn.
TURNS = 1024


def normal(text: Column) -> Column:
    """Words parted by one space."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def parsed(messages: DataFrame) -> DataFrame:
    """One row per message with `lines` (level, text), levels from 0, and `body`, the own lines."""
    line = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\r?\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("text"),
        ),
    )
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"])
    return messages.withColumn("lines", line).withColumn("body", F.regexp_replace(F.array_join(own, "\n"), AROUND, ""))


def passages(rows: DataFrame) -> DataFrame:
    """(key, conv, turn, level, place, hash, first, size) of the quoted passages: neighbouring lines of one level.

    `first` is the hash of the first line, `size` the number of lines. Lines without words part passages.
    `rows` has (key, conv, turn, lines); rows of one key count once.
    """
    quoting = rows.filter(F.exists("lines", lambda x: x["level"] > 0)).dropDuplicates(["key"])
    lines = quoting.select("key", "conv", "turn", F.posexplode("lines").alias("place", "line"))
    words = normal(F.col("line.text"))
    by_message = Window.partitionBy("key").orderBy("place")
    same = (F.lag("level").over(by_message) == F.col("level")) & (F.lag("words").over(by_message) != "")
    lines = lines.select("key", "conv", "turn", "place", F.col("line.level").alias("level"), words.alias("words"))
    lines = lines.withColumn("new", F.when(same & (F.col("words") != ""), 0).otherwise(1))
    lines = lines.withColumn("passage", F.sum("new").over(by_message)).filter("level > 0 and words <> ''")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])
    found = lines.groupBy("key", "conv", "turn", "level", "passage").agg(F.min("place").alias("place"), in_order.alias("said"))
    hashes = [_hash(F.array_join("said", " ")).alias("hash"), _hash(F.element_at("said", 1)).alias("first")]
    return found.select("key", "conv", "turn", "level", "place", *hashes, F.size("said").alias("size"))


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def trimmed(quotes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For quotes of several lines that no whole part of a message equals: their lines, and where such lines are.

    Both sides get a hash of the number of lines and the lines' words. Of the messages' bodies, stretches of
    lines are hashed that begin with a quote's first line and have as many; lines without words don't count.
    """
    several = quotes.filter("size > 1")
    sized = lambda words: F.unhex(F.md5(F.concat_ws(":", "size", words)))
    lines = F.filter(F.transform(F.split("body", "\n"), normal), lambda x: x != "")
    wanted = several.select("conv", "first", "size").distinct()
    at = rows.select("conv", "turn", lines.alias("said")).select("conv", "turn", "said", F.posexplode("said").alias("at", "line"))
    at = at.withColumn("first", _hash(F.col("line"))).join(wanted, ["conv", "first"]).filter("at + size <= size(said)")
    stretch = F.array_join(F.slice("said", F.col("at") + 1, F.col("size")), " ")
    there = at.select("conv", "turn", sized(F.hex(_hash(stretch))).alias("hash")).distinct()
    return several.withColumn("hash", sized(F.hex("hash"))), there


def originals(rows: DataFrame) -> DataFrame:
    """(conv, turn, hash) of what can be quoted of each message: its body, its paragraphs, its lines."""
    paragraphs = F.split("body", r"\n[ \t]*\n")
    parts = F.array_distinct(F.concat(F.array("body"), paragraphs, F.split("body", "\n")))
    found = rows.select("conv", "turn", F.explode(F.transform(parts, normal)).alias("words")).filter("words <> ''")
    return found.select("conv", "turn", _hash(F.col("words")).alias("hash")).distinct()


def last_before(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """`quotes` with `source`: the last turn before its own of the same conversation and hash.

    No pairs are made, as a line may stand in any number of turns: within blocks of turns the rows are
    put in order; for the time before a block the last turn of earlier blocks is taken.
    """
    block = F.floor(F.col("turn") / TURNS)
    sources = sources.join(quotes.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    blocks = sources.groupBy("conv", "hash", block.alias("block")).agg(F.max("turn").alias("last"))
    marks = blocks.unionByName(
        quotes.select("conv", "hash", block.alias("block"), F.lit(None).cast("long").alias("last")).distinct()
    ).groupBy("conv", "hash", "block").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("before", F.max("last").over(earlier)).select("conv", "hash", "block", "before")
    own = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = quotes.select("conv", "hash", block.alias("block"), "turn", "key", "level", "place", F.lit(None).cast("long").alias("at"))
    there = sources.select(
        "conv", "hash", block.alias("block"), "turn", F.lit(None).cast("binary").alias("key"),
        F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("place"), F.col("turn").alias("at"),
    )
    found = rows.unionByName(there).withColumn("near", F.max("at").over(own)).filter("key is not null")
    return found.join(marks, ["conv", "hash", "block"], "left").select(
        "key", "conv", "turn", "level", "place", F.coalesce("near", "before").alias("source")
    )


def linked_messages(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per row of `messages`: conv_col, turn_col, role_col, content, n_quotes, n_linked, reply_to, thread, chat.

    `content` is the text without quoted lines, trimmed. Quoted passages are looked up, by the hash of
    their words, among the bodies, paragraphs and lines of earlier turns of the conversation; the last
    such turn is linked. A passage of several lines that is none of these is looked up once more as lines that
    follow each other in an earlier turn, whatever stands before and after them. `reply_to` is the turn that the first linked passage of the lowest level
    comes from, null without one. `thread` is the turn where following reply_to ends, so that
    conv_col, thread, turn_col is reply order: an answer follows what it quotes. `chat` is the message
    between role marks. A conversation is the rows in that order and is not gathered in one row, as it
    may be of any length.

    Null texts are empty, null roles become "user" in `chat`. Rows without conversation or turn link to
    nothing and are their own thread. Rows that agree in conversation and turn share a thread, that of
    the earliest turn they reply to; each keeps its own content.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    named = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    key = F.unhex(F.md5(F.to_json(F.struct("conv", "turn", "text"))))
    rows = parsed(named).withColumn("key", key)
    able = rows.filter("conv is not null and turn is not null")
    quotes = scratch.keep(passages(able), "quotes")
    whole = scratch.keep(last_before(quotes, originals(able)), "whole")
    place = ["key", "level", "place"]
    rest = quotes.join(whole.filter("source is null").select(*place), place, "left_semi")
    parts = last_before(*trimmed(rest, able)).select(*place, F.col("source").alias("part"))
    found = whole.join(parts, place, "left").withColumn("source", F.coalesce("source", "part")).drop("part")
    found = scratch.keep(found, "found")
    first = F.min(F.when(F.col("source").isNotNull(), F.struct("level", "place", "source")))
    ties = found.groupBy("key", "conv", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), first["source"].alias("reply_to")
    )
    ties = scratch.keep(ties, "ties")
    turns = ties.filter("reply_to is not null").groupBy("conv", "turn").agg(F.min("reply_to").alias("reply_to"))
    parents = turns.select(F.struct("conv", "turn").alias("node"), F.struct("conv", F.col("reply_to").alias("turn")).alias("parent"))
    ends = roots(scratch.keep(parents, "parents"), scratch, "roots")
    threads = ends.select("node.conv", "node.turn", F.col("parent.turn").alias("thread"))
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"))
    return (
        rows.select("key", "conv", "turn", "role", "body", chat.alias("chat"))
        .join(ties.select("key", "n_quotes", "n_linked", "reply_to"), "key", "left")
        .join(threads, ["conv", "turn"], "left")
        .select(
            F.col("conv").alias(conv_col),
            F.col("turn").alias(turn_col),
            F.col("role").alias(role_col),
            F.col("body").alias("content"),
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            "reply_to",
            F.coalesce("thread", "turn").alias("thread"),
            "chat",
        )
    )
