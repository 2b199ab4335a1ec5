"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvetrail.llm.scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20240131
# Units that one flight takes; two of them at most stay open.
BLOCK = 4096
EPS = 1e-9


def word_count(text: Column) -> Column:
    """What ASCII white space parts; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for one row (source, source_size) per source.

    Sources by code point, null last, take the weights in turn and share `share` times all sizes in
    proportion. Targets stop at `most` times the source's size; what is over goes to the others by
    weight until none is above, which is: every target is the lesser of its stop and level * weight.
    The level rises with each round; only sums come to the driver. Ranking needs the list of sources
    in one place, one short row each.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("weight", weight.cast("double")).withColumn("stop", F.col("source_size") * float(most))
    level = 0.0
    while True:
        stopped = F.col("stop") < F.col("weight") * level
        total, taken, free = rows.agg(
            F.sum("source_size"), F.sum(F.when(stopped, F.col("stop"))), F.sum(F.when(~stopped, F.col("weight")))
        ).first()
        higher = (share * (total or 0) - (taken or 0.0)) / free if free else level
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return rows.select("source", "source_size", F.least("stop", F.col("weight") * level).alias("target"))


def flight(sizes: list[float], chances: list[float], uniforms: list[float]) -> list[float]:
    """Move chances to 0 or 1 with the sums of chances and of size * chance unchanged.

    Three open units at a time: the two sums leave one direction free, the null space of the
    constraints, along which the three move until one of them is settled. Which way is drawn so that
    each chance keeps its mean. At most two stay open.
    """
    p, open_units = list(chances), []
    for unit, size in enumerate(sizes):
        if not EPS < p[unit] < 1 - EPS:
            p[unit] = round(p[unit])
            continue
        open_units.append(unit)
        if len(open_units) < 3:
            continue
        a, b, c = open_units
        way = (sizes[b] - size, size - sizes[a], sizes[a] - sizes[b])
        if not any(way):
            way = (1.0, -1.0, 0.0)
        ahead = back = float("inf")
        for k, w in zip(open_units, way, strict=True):
            if w:
                up, down = (1 - p[k]) / abs(w), p[k] / abs(w)
                ahead, back = min(ahead, up if w > 0 else down), min(back, down if w > 0 else up)
        step = ahead if uniforms[unit] * (ahead + back) < back else -back
        for k, w in zip(open_units, way, strict=True):
            p[k] += step * w
            if not EPS < p[k] < 1 - EPS:
                p[k] = round(p[k])
        open_units = [k for k in open_units if EPS < p[k] < 1 - EPS]
    return p


def land(sizes: list[float], chances: list[float]) -> list[float]:
    """Settle the last open units, two at most: nearest in size, then in number, then fewer taken."""
    p = list(chances)
    still = [k for k, x in enumerate(p) if EPS < x < 1 - EPS]
    tokens, units = sum(sizes[k] * p[k] for k in still), sum(p[k] for k in still)

    def miss(choice):
        return abs(sum(sizes[k] * x for k, x in zip(still, choice, strict=True)) - tokens), abs(sum(choice) - units), choice

    for k, x in zip(still, min(product((0, 1), repeat=len(still)), key=miss), strict=True):
        p[k] = float(x)
    return p


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """One block's flight, large units first, so that what stays open is small; landing if it is the last."""
    rows = rows.sort_values(["size", "draw"], ascending=[False, True], kind="stable").reset_index(drop=True)
    # A number for each unit that depends on the unit alone: reruns agree however rows are dealt out.
    uniforms = (rows["draw"].to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
    sizes, last = rows["size"].astype(float).tolist(), bool(rows["last"].iloc[0])
    p = flight(sizes, rows["chance"].tolist(), uniforms.tolist())
    return rows.assign(chance=land(sizes, p) if last else p)


def balanced(units: DataFrame, scratch: Scratch, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """`units` (source, unit, size, chance) with every chance settled at 0 or 1.

    `unit` is a long that tells units apart. Blocks of about `block` units fly on their own; the two
    at most that each leaves open fly again with those of other blocks of their source, until a
    source has one block, which lands. So each source keeps its size and number but for that landing.
    """
    done, level = [], 0
    while True:
        counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        blocks = scratch.keep(counts.select(F.col("source").alias("of"), F.ceil(F.col("n") / block).alias("blocks")), f"blocks-{level}")
        draw = F.xxhash64(F.lit(seed), F.lit(level), "unit")
        dealt = units.join(blocks, F.col("source").eqNullSafe(F.col("of"))).select(
            *units.columns,
            draw.alias("draw"),
            F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.lit("block"), "unit"), F.col("blocks")).alias("block"),
            (F.col("blocks") == 1).alias("last"),
        )
        flown = scratch.keep(dealt.groupBy("source", "block").applyInPandas(_settled, dealt.schema), f"flown-{level}")
        still = (F.col("chance") > EPS) & (F.col("chance") < 1 - EPS)
        done.append(flown.filter(~still).select(units.columns))
        units, level = flown.filter(still).select(units.columns), level + 1
        if units.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _plan(docs: DataFrame, weights, share, most, seed, id_col, text_col, source_col) -> DataFrame:
    """One row per distinct (source, id, size, digest): copies, and for copy i how often it is taken:
    `base` times, once more for i < sure, and for i = sure once more if `extra`."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(
        F.col(source_col).cast("string").alias("source"),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("digest"),
    )
    rows = scratch.keep(rows.groupBy(rows.columns).agg(F.count(F.lit(1)).alias("copies")), "rows")
    totals = scratch.keep(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), "totals")
    targets = scratch.keep(
        source_targets(totals, weights, share, most).withColumnRenamed("source", "of"), "targets"
    )
    # The ratio is target / size, so 1 and 2 come out exactly where the target is the size or its double.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    planned = planned.withColumn("base", F.floor(ratio)).withColumn("each", ratio - F.floor(ratio))
    planned = planned.withColumn("sure", F.floor(F.col("each") * F.col("copies")))
    planned = scratch.keep(planned.withColumn("unit", F.xxhash64("source", "id", "size", "digest")), "planned")
    chance = F.col("each") * F.col("copies") - F.col("sure")
    units = planned.filter("size > 0").select("source", "unit", "size", chance.alias("chance"), "id", "digest")
    settled = balanced(units.filter(f"chance > {EPS}"), scratch, seed=seed).filter("chance > 0.5")
    chosen = settled.select(
        F.col("source").alias("s"), F.col("id").alias("i"), F.col("size").alias("z"), F.col("digest").alias("d"), F.lit(1).alias("extra")
    )
    same = (
        F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("z")) & (F.col("digest") == F.col("d"))
    )
    return planned.join(chosen, same, "left").select(
        "source", "id", "size", "digest", "copies", "source_size", "target", "base", "sure", F.coalesce("extra", F.lit(0)).alias("extra")
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of `docs`: id_col, size, source_size, target, taken (words, repeats counted).

    A source whose target is r times its size has every document taken floor(r) times and, with
    balanced chance r - floor(r), once more; size is the number of words. Null and empty texts have
    size 0 and nothing taken; null sources are one source, the last. Repeated rows share their
    chance: of m copies floor(m * chance) are taken once more for certain and one more by draw.
    Results depend on the rows and the seed alone. Other columns are not read.
    """
    plan = _plan(docs, weights, share, most, seed, id_col, text_col, source_col)
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    times = F.col("base") + F.when(F.col("copy") < F.col("sure"), 1).when(F.col("copy") == F.col("sure"), F.col("extra")).otherwise(0)
    return plan.withColumn("copy", copy).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents of the mix: the columns of `docs`, then mix_size, mix_target and mix_times (how often it is taken).

    Rows that agree in source, id and text come as one row that carries the times of all. A column of `docs`
    that bears one of the new names stays as it is; the new one's name then ends in as many '_' as it takes.
    """
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("mix_size", "mix_target", "mix_times"):
        while name in taken:
            name += "_"
        names.append(name)
    plan = _plan(docs, weights, share, most, seed, id_col, text_col, source_col)
    times = (F.col("base") * F.col("copies") + F.col("sure") + F.col("extra")).cast("long")
    plan = plan.select("source", "id", "digest", "size", "target", "copies", times.alias("times")).filter("times > 0 and size > 0")
    text = F.coalesce(F.col(f"docs.`{text_col}`"), F.lit(""))
    same = (
        F.col(f"docs.`{source_col}`").cast("string").eqNullSafe(F.col("plan.source"))
        & F.col(f"docs.`{id_col}`").eqNullSafe(F.col("plan.id"))
        & (F.unhex(F.md5(text)) == F.col("plan.digest"))
    )
    row = F.struct(*(F.col(f"docs.`{c}`") for c in docs.columns)).alias("row")
    found = docs.alias("docs").join(plan.alias("plan"), same).select(row, "plan.*")
    lone = found.filter("copies = 1")
    keys = ["source", "id", "digest", "size", "target", "times"]
    repeated = found.filter("copies > 1").groupBy(keys).agg(F.first("row").alias("row"))
    out = ["row", "size", "target", "times"]
    return lone.select(out).unionByName(repeated.select(out)).select(
        "row.*", *(F.col(c).alias(name) for c, name in zip(("size", "target", "times"), names, strict=True))
    )
