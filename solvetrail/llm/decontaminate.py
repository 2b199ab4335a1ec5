"""Benchmark decontamination over a positional inverted index, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvetrail.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
# A document is contaminated if at least one in so many of its words is hit.
SHARE = 20


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: digits, a-z and everything beyond ASCII. Null has none."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


@dataclass
class Index:
    """Postings of the terms that searches start from; `docs` is the word table that `read_words` makes."""

    docs: DataFrame
    postings: DataFrame
    phrases: DataFrame
    scratch: Scratch


def _key(id_col: str, text_col: str) -> Column:
    """128 bits for a row's id and text; rows that agree in both have the same results."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(name, F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))))


def phrases_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, phrase, terms): every `window` consecutive words of each item, or all of fewer."""
    read = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    cut = read.filter(F.size("all") > 0).select("item", F.explode(starts).alias("at"), "all")
    terms = F.slice("all", F.col("at"), F.lit(window))
    return cut.select("item", terms.alias("terms")).select("item", F.unhex(F.md5(F.array_join("terms", " "))).alias("phrase"), "terms")


def read_words(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, key, n_words, words) of every row, written: texts are cut into words once, for all that follows."""
    cut = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"), words(F.col(text_col)).alias("words"))
    return scratch.keep(cut.select("id", "key", F.size("words").cast("long").alias("n_words"), "words"), "words")


def build_index(docs: DataFrame, phrases: DataFrame, scratch: Scratch) -> Index:
    """Count the phrases' terms in all documents, then post the two rarest terms of each phrase.

    `docs` comes from `read_words`. `phrases` has (phrase, terms), one row per phrase. In the index, `terms` is rarest first: structs
    (n, at, term) with the term's count in all documents and its place in the phrase. A phrase with
    a term that no document has is left out.
    """
    placed = scratch.keep(phrases.select("phrase", F.posexplode("terms").alias("at", "term")), "placed")
    vocabulary = scratch.keep(placed.select("term").distinct(), "vocabulary")
    counts = scratch.keep(
        docs.select(F.explode("words").alias("term"))
        .join(vocabulary, "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n")),
        "counts",
    )
    ranked = scratch.keep(
        placed.join(counts, "term", "left")
        .groupBy("phrase")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("terms"))
        .filter(F.col("terms")[0]["n"] > 0),
        "ranked",
    )
    posted = scratch.keep(
        ranked.select(F.explode(F.slice("terms", 1, 2)).alias("x")).select("x.term").distinct(), "posted"
    )
    postings = scratch.keep(
        docs.select("key", F.posexplode("words").alias("pos", "term")).join(posted, "term"), "postings"
    )
    return Index(docs, postings, ranked, scratch)


def phrase_matches(index: Index) -> DataFrame:
    """(key, phrase, start, length) of every exact occurrence of every phrase, places from 0.

    The rarest term's list, shifted by its place in the phrase, gives the candidates; the second
    rarest term's shifted list is intersected with them. What passes both is few: the other terms'
    lists are made for those documents alone and intersected in one join.
    """
    first = F.col("terms")[0]
    entry = index.phrases.select("phrase", first["term"].alias("term"), first["at"].alias("at"))
    started = index.postings.join(entry, "term").select("key", "phrase", (F.col("pos") - F.col("at")).alias("start"))
    started = started.filter("start >= 0")
    more = index.phrases.select("phrase", F.size("terms").alias("length"), F.get("terms", F.lit(1)).alias("x"))
    wanted = started.join(more, "phrase").select(
        "key", "phrase", "start", "length", F.col("x.term").alias("term"), (F.col("start") + F.col("x.at")).alias("pos")
    )
    pairs = wanted.filter("length > 1").join(index.postings.distinct(), ["key", "term", "pos"])
    columns = ["key", "phrase", "start", "length"]
    candidates = index.scratch.keep(
        pairs.select(columns).unionByName(wanted.filter("length = 1").select(columns)).distinct(), "candidates"
    )
    rest = index.phrases.select("phrase", F.explode(F.slice("terms", F.lit(3), F.size("terms"))).alias("x"))
    lists = _lists(index, candidates.filter("length > 2"))
    found = (
        candidates.join(rest, "phrase")
        .select(*columns, F.col("x.term").alias("term"), (F.col("start") + F.col("x.at")).alias("pos"))
        .join(lists, ["key", "term", "pos"])
        .groupBy(columns)
        .agg(F.count(F.lit(1)).alias("met"))
        .filter("met = length - 2")
        .select(columns)
    )
    return found.unionByName(candidates.filter("length <= 2"))


def _lists(index: Index, candidates: DataFrame) -> DataFrame:
    """(key, term, pos) of all words of the documents that have a candidate."""
    keys = index.scratch.keep(candidates.select("key").distinct(), "keys")
    return _words_of(index, keys)


def _words_of(index: Index, keys: DataFrame) -> DataFrame:
    texts = index.docs.join(keys, "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))
    return texts.select("key", F.posexplode("words").alias("pos", "term"))


def proximity_matches(index: Index, span: int) -> DataFrame:
    """(key, phrase, start): all terms of the phrase lie within `span` words from `start` on, in any order.

    Starts are those at which a stretch begins with one of the terms. The two rarest terms must have
    postings less than `span` apart; they are found in equal or neighbouring blocks of `span` words.
    """
    first, second = F.col("terms")[0]["term"], F.get("terms", F.lit(1))["term"]
    entry = index.phrases.select("phrase", first.alias("term"), F.coalesce(second, first).alias("other"))
    block = (F.col("pos") / span).cast("long")
    around = F.explode(F.sequence(block - 1, block + 1)).alias("block")
    left = index.postings.join(entry, "term").select("key", "phrase", "pos", F.col("other").alias("term"), around)
    right = index.postings.select("key", "term", F.col("pos").alias("there"), block.alias("block"))
    near = left.join(right, ["key", "term", "block"]).filter(F.abs(F.col("pos") - F.col("there")) < span)
    candidates = index.scratch.keep(near.select("key", "phrase").distinct(), f"near-{span}")
    bags = index.phrases.select("phrase", F.explode("terms").alias("x")).groupBy("phrase", F.col("x.term").alias("term"))
    wanted = candidates.join(bags.agg(F.count(F.lit(1)).alias("times")), "phrase")
    keys = index.scratch.keep(candidates.select("key").distinct(), f"near-keys-{span}")
    places = index.scratch.keep(wanted.join(_words_of(index, keys), ["key", "term"]).select("key", "phrase", "term", "times", "pos"), f"places-{span}")
    starts = places.select("key", "phrase", F.col("pos").alias("start")).distinct()
    starts = starts.withColumn("block", F.explode(F.sequence((F.col("start") / span).cast("long"), ((F.col("start") + span - 1) / span).cast("long"))))
    inside = starts.join(places.withColumn("block", block), ["key", "phrase", "block"]).filter(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + span)
    )
    terms = inside.groupBy("key", "phrase", "start", "term").agg((F.count(F.lit(1)) >= F.first("times")).alias("enough"))
    met = terms.filter("enough").groupBy("key", "phrase", "start").agg(F.count(F.lit(1)).alias("met"))
    needed = bags.agg(F.lit(1).alias("one")).groupBy("phrase").agg(F.count(F.lit(1)).alias("needed"))
    return met.join(needed, "phrase").filter("met = needed").select("key", "phrase", "start")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    share: int = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per row of `docs` with what of it occurs in `items`.

    A document word inside any occurrence of an item's window is hit. Returns id_col, n_words,
    n_hit, n_items (items with occurring windows), items_sha256 (of those item ids, sorted as text,
    joined by commas; of nothing where there are none) and contaminated (n_hit > 0 and
    share * n_hit >= n_words). Null texts have no words, items without words no windows; a null item
    id counts as the empty id, equal item ids as one item. Rows that agree in id and text get equal
    results. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "index")
    read = read_words(docs, id_col, text_col, scratch)
    found = contaminated_keys(read, items, window, item_id, item_text, scratch).drop("n_words")
    rows = read.select("id", "key", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, "key", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def contaminated_keys(read: DataFrame, items: DataFrame, window: int, item_id: str, item_text: str, scratch: Scratch) -> DataFrame:
    """(key, n_words, n_hit, items) of the documents with any hit, written; `read` comes from `read_words`."""
    named = scratch.keep(phrases_of(items, item_id, item_text, window), "named")
    phrases = named.groupBy("phrase").agg(F.first("terms").alias("terms"))
    matches = scratch.keep(phrase_matches(build_index(read, phrases, scratch)), "matches")
    hit = matches.select("key", F.explode(F.expr("sequence(start, start + length - 1)")).alias("pos")).distinct()
    hits = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    met = matches.select("key", "phrase").distinct().join(named.select("phrase", "item").distinct(), "phrase")
    names = met.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sizes = read.select("key", "n_words").join(matches.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    found = scratch.keep(hits.join(names, "key").join(sizes, "key"), "hits")
    scratch.drop("named", "placed", "vocabulary", "counts", "ranked", "posted", "postings", "candidates", "keys", "matches")
    return found


def without_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns.

    Rows that agree in id and text stay or go together. A null or empty text has no words, so it stays; an empty
    table of items or of documents takes nothing away. Columns of `docs` may have any names.
    """
    scratch = Scratch(docs.sparkSession, "index")
    read = read_words(docs, id_col, text_col, scratch)
    found = contaminated_keys(read, items, window, "item_id", "text", scratch)
    scratch.drop("words")
    bad = found.filter(share * F.col("n_hit") >= F.col("n_words")).select("key")
    keyed = docs.alias("docs").select(F.struct("docs.*").alias("row"), _key(id_col, text_col).alias("key"))
    return keyed.join(bad, "key", "left_anti").select("row.*")
