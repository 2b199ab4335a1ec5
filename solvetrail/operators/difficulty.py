"""Difficulty over time: by month, as shares, and as a trend between two halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvetrail.functions.dates import month_key
from solvetrail.functions.levels import LEVELS, counts_by_level, score, share

# Fewest rows for a trend, the band around no change, and the answers.
FEWEST_ROWS = 10
BAND = 0.2
TOO_FEW = "Insufficient data"
HARDER = "Improving - solving harder problems"
EASIER = "Focusing on easier problems"
SAME = "Consistent difficulty level"


def _weight(n: str | None) -> Column:
    return F.col(n) if n else F.lit(1).cast("bigint")


def monthly_levels(rows: DataFrame, n: str | None = None) -> DataFrame:
    """Easy, medium and hard per month; a month with none of them does not show.

    With `n`, the column that says for how many each row stands, as in `level_days`.
    """
    # The condition is inside the sums, so that cells shared with other metrics are read alike.
    known = F.col("date_solved").isNotNull() & F.col("difficulty").isin(*LEVELS)
    counts = rows.groupBy("user_id", month_key(F.col("date_solved")).alias("month")).agg(
        *counts_by_level(F.when(known, F.col("difficulty")), _weight(n))
    )
    return counts.filter(F.col("easy") + F.col("medium") + F.col("hard") > 0)


def level_shares(rows: DataFrame, n: str | None = None) -> DataFrame:
    """Each level's share of all dated rows, those of unknown level included; `n` as in `monthly_levels`."""
    weight = F.when(F.col("date_solved").isNotNull(), _weight(n)).otherwise(0)
    counts = rows.groupBy("user_id").agg(F.sum(weight).alias("all"), *counts_by_level(F.col("difficulty"), weight))
    names = [name.lower() for name in LEVELS]
    return counts.filter(F.col("all") > 0).select(
        "user_id", *[share(F.col(name), F.col("all")).alias(name) for name in names]
    )


# A boundary day of up to this many rows is put in order in one window. A longer one is cut
# at about SPLITS of its own places first, and only the stretch that is wanted is put in order.
DAY_ROWS = 2**21
SPLITS = 512


def _dated(rows: DataFrame) -> DataFrame:
    # seq is never NULL, so that Spark adds no checks to some of the uses of these rows and sees
    # that they are all the same shuffle.
    return rows.filter(F.col("date_solved").isNotNull()).select(
        "user_id",
        F.col("date_solved").alias("date"),
        F.coalesce("seq", F.lit(-(2**63))).alias("seq"),
        "title_slug",
        score(F.col("difficulty")).alias("score"),
    )


def _cells(cells: DataFrame) -> DataFrame:
    dated = cells.filter(F.col("date_solved").isNotNull())
    return dated.select("user_id", F.col("date_solved").alias("date"), score(F.col("difficulty")).alias("score"), "n")


def _with_ahead(cells: DataFrame, order: str) -> DataFrame:
    """`need` becomes a row's number from the cell's start on; `before` gets the scores ahead of the cell."""
    ahead = Window.partitionBy("user_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumns(
        {
            "need": F.col("need") - F.coalesce(F.sum("n").over(ahead), F.lit(0)),
            "before": F.col("before") + F.coalesce(F.sum("score").over(ahead), F.lit(0)),
        }
    )


def _days(dated: DataFrame, n: str | None = None) -> DataFrame:
    """Every user's days with `n` rows, and where the first half's last row is from there.

    It is row number `need` counted from the day's start: on the day if that is 1 to n, else before
    or after it. A lone row counts as the last one. `rows` and `score_sum` are the user's, `before` is
    the score of the days ahead.
    """
    user = Window.partitionBy("user_id")
    sums = (F.sum(n), F.sum(F.col("score") * F.col(n))) if n else (F.count("*"), F.sum("score"))
    days = dated.groupBy("user_id", "date").agg(sums[0].alias("n"), sums[1].alias("score"))
    days = days.withColumns({"rows": F.sum("n").over(user), "score_sum": F.sum("score").over(user)})
    days = days.withColumns({"need": F.expr("greatest(rows div 2, 1)"), "before": F.lit(0).cast("bigint")})
    return _with_ahead(days, "date").drop("score")


_ON_DAY = "need between 1 and n"


def _stretch(many: DataFrame, splits: int) -> DataFrame:
    """Of every boundary day the stretch between two of its places that holds row number `need`.

    The places are drawn by their hash, about `splits` of a day's distinct ones, so that also rows
    of one seq are told apart; one counting pass finds the stretch.
    """
    place = F.struct("seq", "title_slug")
    drawn = F.pmod(F.xxhash64("seq", "title_slug"), F.expr(f"greatest(n div {splits}, 1)")) == 0
    marks = many.filter(drawn).groupBy("user_id").agg(F.array_sort(F.collect_set(place)).alias("marks"))
    passed = F.size(F.filter("marks", lambda mark: mark < place))
    cut = many.join(marks, "user_id", "left").withColumn("stretch", F.coalesce(F.when(F.col("marks").isNotNull(), passed), F.lit(0)))
    cut = cut.drop("marks", "n")
    cells = cut.groupBy("user_id", "stretch", "need", "before").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    wanted = _with_ahead(cells, "stretch").filter(_ON_DAY).select("user_id", "stretch", "need", "before")
    return cut.drop("need", "before").join(wanted, ["user_id", "stretch"]).drop("stretch")


def _numbered(edge: DataFrame) -> DataFrame:
    """Rows of one boundary day per user with their `number`, and `first_sum` up to and with each."""
    order = Window.partitionBy("user_id").orderBy("seq", "title_slug").rowsBetween(Window.unboundedPreceding, 0)
    return edge.withColumns({"number": F.count(F.lit(1)).over(order), "first_sum": F.col("before") + F.sum("score").over(order)})


def middle_rows(
    rows: DataFrame, day_rows: int = DAY_ROWS, splits: int = SPLITS, cells: DataFrame | None = None
) -> DataFrame:
    """Per user the last row of the first half by (date, seq); of a lone row, that row.

    Columns: rows, score_sum (all of the user), date, seq, title_slug (of that row),
    first_sum (scores up to and with it). Only the day that has the row is put in order.
    `cells` are the rows' `level_days`, if they are at hand.
    """
    dated = _dated(rows)
    days = _days(dated) if cells is None else _days(_cells(cells), "n")
    # The join may meet a busy day, which adaptive execution splits; a shuffle follows on either way.
    edge = dated.join(days.filter(_ON_DAY), ["user_id", "date"])
    few = edge.filter(F.col("n") <= day_rows).drop("n")
    many = _stretch(edge.filter(F.col("n") > day_rows), splits)
    return _numbered(few.unionByName(many)).filter("number = need").select(
        "user_id", "rows", "score_sum", "date", "seq", "title_slug", "first_sum"
    )


def halves(rows: DataFrame, day_rows: int = DAY_ROWS, splits: int = SPLITS) -> DataFrame:
    """Every dated row with the half (1 or 2) of its user's rows it is in.

    The first half has `rows div 2` rows, so a user's only row is in the second. Days on either
    side of the boundary go whole, by their counts; of the boundary day the rows are put in order.
    """
    dated = _dated(rows).withColumn("score", F.lit(0).cast("bigint"))
    days = _days(dated).select("user_id", "date", "n", "need", "before", "rows")
    placed = dated.join(days, ["user_id", "date"])
    on_day = F.expr(_ON_DAY) & (F.col("rows") > 1)
    edge = placed.filter(on_day)
    few = _numbered(edge.filter(F.col("n") <= day_rows))
    many = edge.filter(F.col("n") > day_rows)
    last = _numbered(_stretch(many, splits)).filter("number = need")
    last = last.select("user_id", F.struct("seq", "title_slug").alias("last"))
    halved = [
        (placed.filter(~on_day), F.col("need") > F.col("n")),
        (few, F.col("number") <= F.col("need")),
        (many.join(last, "user_id"), F.struct("seq", "title_slug") <= F.col("last")),
    ]
    whole, ordered, cut = [
        frame.select("user_id", "title_slug", F.col("date").alias("date_solved"), F.when(first, 1).otherwise(2).cast("bigint").alias("half"))
        for frame, first in halved
    ]
    return whole.unionByName(ordered).unionByName(cut)


def complexity_trend(
    rows: DataFrame, day_rows: int = DAY_ROWS, splits: int = SPLITS, cells: DataFrame | None = None
) -> DataFrame:
    """Mean score of the first half against the second, in words; averages from ten rows on."""
    enough = F.col("rows") >= FEWEST_ROWS
    size = F.expr("rows div 2")
    first = F.when(enough, F.col("first_sum") / size)
    second = F.when(enough, (F.col("score_sum") - F.col("first_sum")) / (F.col("rows") - size))
    return (
        middle_rows(rows, day_rows, splits, cells)
        .select("user_id", first.alias("first_avg"), second.alias("second_avg"), enough.alias("enough"))
        .select(
            "user_id",
            "first_avg",
            "second_avg",
            F.when(~F.col("enough"), TOO_FEW)
            .when(F.col("second_avg") > F.col("first_avg") + BAND, HARDER)
            .when(F.col("second_avg") < F.col("first_avg") - BAND, EASIER)
            .otherwise(SAME)
            .alias("trend"),
        )
    )
