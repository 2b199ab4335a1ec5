"""Small frames for the tests."""

import datetime as dt

ROWS = (
    "user_id bigint, seq bigint, title string, title_slug string, difficulty string, "
    "topics array<string>, date_solved date"
)


def day(number: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=number - 1)


def problems(spark, rows):
    """Rows (user, difficulty, topics, day number or None) in list order."""
    out = [
        (u, i, f"Item {i}", f"item-{i}", level, topics, day(d) if d is not None else None)
        for i, (u, level, topics, d) in enumerate(rows)
    ]
    return spark.createDataFrame(out, ROWS)


def ordered(rows):
    """Tuples in order, None last."""
    return sorted(rows, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


def values(frame, *columns):
    """The frame's rows as an ordered list of tuples."""
    rows = frame.select(*columns) if columns else frame
    return ordered(tuple(r) for r in rows.collect())
