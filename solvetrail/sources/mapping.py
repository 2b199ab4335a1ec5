"""The ordered topic-to-category mapping, and its use on the distinct topics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Mapping = Sequence[tuple[str, str]]

# Longest mapping that is written into an expression; a longer one is joined.
LITERAL = 256

# The standard mapping. Order matters, the first partial match wins.
STANDARD: Mapping = (
    ("Array", "Arrays & Strings"),
    ("String", "Arrays & Strings"),
    ("Hash Table", "Hash Tables & Sets"),
    ("Dynamic Programming", "Dynamic Programming"),
    ("Math", "Mathematics"),
    ("Sorting", "Sorting & Searching"),
    ("Greedy", "Greedy Algorithms"),
    ("Depth-First Search", "Graph Traversal"),
    ("Binary Search", "Sorting & Searching"),
    ("Database", "Database & SQL"),
    ("Breadth-First Search", "Graph Traversal"),
    ("Tree", "Trees & Graphs"),
    ("Matrix", "Matrix Operations"),
    ("Two Pointers", "Two Pointers"),
    ("Bit Manipulation", "Bit Manipulation"),
    ("Stack", "Stacks & Queues"),
    ("Heap (Priority Queue)", "Heaps & Priority Queues"),
    ("Graph", "Trees & Graphs"),
    ("Design", "System Design"),
    ("Backtracking", "Backtracking"),
    ("Sliding Window", "Sliding Window"),
    ("Union Find", "Union Find"),
    ("Linked List", "Linked Lists"),
    ("Recursion", "Recursion"),
    ("Monotonic Stack", "Advanced Data Structures"),
    ("Binary Tree", "Trees & Graphs"),
    ("Trie", "Advanced Data Structures"),
    ("Divide and Conquer", "Divide & Conquer"),
    ("Ordered Set", "Advanced Data Structures"),
    ("Geometry", "Mathematics"),
    ("Game Theory", "Advanced Algorithms"),
    ("Segment Tree", "Advanced Data Structures"),
    ("Topological Sort", "Graph Algorithms"),
    ("Number Theory", "Mathematics"),
    ("Binary Indexed Tree", "Advanced Data Structures"),
    ("Queue", "Stacks & Queues"),
    ("Brainteaser", "Brain Teasers"),
    ("Memoization", "Dynamic Programming"),
    ("Minimax", "Advanced Algorithms"),
    ("Reservoir Sampling", "Advanced Algorithms"),
    ("Quickselect", "Sorting & Searching"),
    ("Eulerian Circuit", "Graph Algorithms"),
    ("Radix Sort", "Sorting & Searching"),
    ("Strongly Connected Component", "Graph Algorithms"),
    ("Shortest Path", "Graph Algorithms"),
    ("Data Stream", "System Design"),
    ("Iterator", "Design Patterns"),
    ("Rolling Hash", "Advanced Algorithms"),
    ("Monotonic Queue", "Advanced Data Structures"),
    ("Randomized", "Advanced Algorithms"),
    ("Enumeration", "Brute Force"),
    ("Probability and Statistics", "Mathematics"),
    ("Rejection Sampling", "Advanced Algorithms"),
    ("Suffix Array", "Advanced Data Structures"),
    ("Concurrency", "System Design"),
    ("Minimum Spanning Tree", "Graph Algorithms"),
    ("Biconnected Component", "Graph Algorithms"),
)


def read_mapping(spark: SparkSession, path: str) -> Mapping:
    """A mapping kept as one JSON object in a text file, in the order written."""
    return tuple(json.loads(spark.read.text(path, wholetext=True).first()[0]).items())


def entries(mapping: Mapping) -> list[tuple[int, str, str]]:
    """(ord, name, entry) in order. Of entries with one name the first counts."""
    first: dict[str, str] = {}
    for name, entry in mapping:
        first.setdefault(name, entry)
    return [(i, name, entry) for i, (name, entry) in enumerate(first.items())]


def _parts(text: Column, lengths: list[int]) -> Column:
    """All substrings of a text that have one of these lengths, each once."""
    places = lambda n: F.sequence(F.lit(1), F.length(text) - n + 1)
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(text))
    return F.array_distinct(F.flatten(F.transform(fitting, lambda n: F.transform(places(n), lambda i: F.substring(text, i, n)))))


def match_kinds(names: DataFrame, mapping: Mapping) -> DataFrame:
    """For distinct topics (one column `topic`): the category and how it was found.

    The entry of this very name; else the first entry whose name contains the topic or is contained
    in it, in lower case; else the topic itself. Both kinds of containment are joins by key, of
    substrings with the texts they may equal; the empty topic is contained in every name.
    """
    listed = entries(mapping)
    known = names.sparkSession.createDataFrame(listed, "ord bigint, name string, entry string")
    low = known.select("ord", "entry", F.lower("name").alias("part"))
    lengths = sorted({len(name.lower()) for _, name, _ in listed} - {0})
    topics = names.select("topic", F.lower("topic").alias("low"))
    hits = topics.select("topic", F.explode(_parts(F.col("low"), lengths)).alias("part")) if lengths else None
    within = topics.select("topic", F.col("low").alias("part")).join(
        low.select("ord", "entry", F.explode(F.array_distinct(_all_parts(F.col("part")))).alias("part")), "part"
    )
    found = within.select("topic", "ord", "entry")
    if hits is not None:
        found = found.unionByName(hits.join(low, "part").select("topic", "ord", "entry"))
    partial = found.groupBy("topic").agg(F.min(F.struct("ord", "entry")).alias("hit"))
    empty = listed[0][2] if listed else None
    nameless = next(((place, entry) for place, name, entry in listed if name == ""), None)
    exact = known.select(F.col("name").alias("topic"), F.col("entry").alias("own"))
    hit = F.col("hit.entry")
    if nameless is not None:
        place, entry = nameless
        hit = F.when(F.col("topic").isNotNull() & (F.coalesce("hit.ord", F.lit(place + 1)) > place), F.lit(entry)).otherwise(hit)
    hit = F.when(F.col("topic") == "", F.lit(empty)).otherwise(hit)
    return names.join(exact, "topic", "left").join(partial, "topic", "left").select(
        "topic",
        F.coalesce("own", hit, "topic").alias("category"),
        F.when(F.col("own").isNotNull(), "exact").when(hit.isNotNull(), "partial").otherwise("none").alias("match_kind"),
    )


def _all_parts(text: Column) -> Column:
    """All substrings of a text but the empty one."""
    n = F.length(text)
    return F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n),
            lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(text, i, k)),
        )
    )


def category_lists(lists: DataFrame, mapping: Mapping) -> DataFrame:
    """For the distinct lists in column `topics` of `lists`: (topics, categories), each category once."""
    distinct = lists.select("topics").distinct()
    each = distinct.select("topics", F.explode("topics").alias("topic"))
    found = match_kinds(each.select("topic").distinct(), mapping).select("topic", "category")
    return each.join(found, "topic").groupBy("topics").agg(F.collect_set("category").alias("categories"))


def with_categories(rows: DataFrame, mapping: Mapping | None) -> DataFrame:
    """`rows` with `categories`: the topics' categories, each once; without a mapping the topics.

    The mapping is applied to the distinct topics; rows meet it by their whole list of topics, of which
    there are as many as items at most. Rows without topics have no categories.
    """
    if not mapping:
        return rows.withColumn("categories", F.col("topics"))
    return rows.join(category_lists(rows, mapping), "topics", "left")
