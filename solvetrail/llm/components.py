"""Connected components of a graph of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvetrail.llm.scratch import Scratch


def roots(parents: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Follow each `node` along `parent` to the end of its path; paths must not form a circle.

    Every pass doubles the steps a row has gone, so a path of n nodes takes log2(n) passes.
    """
    step = 0
    while True:
        far = parents.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        passed = scratch.keep(
            parents.join(far, "parent", "left").select(
                "node", F.coalesce("far", "parent").alias("parent"), F.col("far").isNotNull().alias("moved")
            ),
            f"{name}-{step}",
        )
        if step:
            scratch.drop(f"{name}-{step - 1}")
        parents, step = passed.select("node", "parent"), step + 1
        if passed.filter("moved").isEmpty():
            return parents


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """For columns a and b of `pairs`: (node, label), label the least node of its component.

    A node that is the least of its component has no row. Each round hangs every node on its least
    smaller neighbour, follows those to the roots and goes on with the pairs between roots; at least
    half of the nodes that still have a pair drop out. All steps are joins and sums by key.
    """
    links = scratch.keep(_links(pairs), "links-0")
    labels, turn = None, 0
    while not links.isEmpty():
        hooks = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        found = roots(scratch.keep(hooks, f"hooks-{turn}"), scratch, f"roots-{turn}")
        left = found.select(F.col("node").alias("a"), F.col("parent").alias("to_a"))
        right = found.select(F.col("node").alias("b"), F.col("parent").alias("to_b"))
        moved = links.join(left, "a", "left").join(right, "b", "left")
        between = _links(moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")))
        if labels is None:
            labels = found
        else:
            further = found.select(F.col("node").alias("label"), F.col("parent").alias("far"))
            labels = (
                labels.withColumnRenamed("parent", "label")
                .join(further, "label", "left")
                .select("node", F.coalesce("far", "label").alias("parent"))
                .unionByName(found)
            )
        turn += 1
        labels = scratch.keep(labels, f"labels-{turn}")
        links = scratch.keep(between, f"links-{turn}")
        scratch.drop(f"links-{turn - 1}", f"hooks-{turn - 1}", f"labels-{turn - 1}")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.withColumnRenamed("parent", "label")


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
