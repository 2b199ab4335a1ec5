import datetime as dt
import math

import pytest
from helpers import values
from pyspark.sql import functions as F

from solvetrail.functions import dates, levels, tags, text


def apply(spark, function, cells, kind="string"):
    """The function over a column of cells, results in the order of the cells."""
    frame = spark.createDataFrame(list(enumerate(cells)), f"i int, x {kind}")
    rows = frame.select("i", function(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "cell, number",
    [
        ("12 ms", 12.0), ("14.2 MB", 14.2), ("52.3%", 52.3), ("5 s", 5.0), ("3m", 3.0),
        ("7MB ", 7.0), ("\t8 ms\n", 8.0), ("1 KB", 0.0), ("N/A", 0.0), ("1d", 0.0), ("1f", 0.0),
        ("0x1p3", 0.0), ("", 0.0), (None, 0.0), ("-2.5 ms", -2.5), ("1e3", 1000.0), (".5%", 0.5),
        ("6.", 6.0), ("5 %", 5.0), ("9smMB", 0.0), ("9MBsm", 9.0), ("9%%", 9.0), ("% 5", 0.0),
        ("1 2", 0.0), ("1_0", 0.0), ("inf", math.inf),
    ],
)
def test_number_with_unit(spark, cell, number):
    assert apply(spark, text.number_with_unit, [cell]) == [number]


def test_number_with_unit_on_all_short_texts(spark):
    """By the definition: a number in blanks, then units of at most one run of each kind in that order."""
    plain = [("", None), ("1", 1.0), ("1.", 1.0), (".1", 0.1), ("11", 11.0), ("1.1", 1.1), (".", None)]
    units = ["", "m", "s", "B", "M", "%", "ms", "sm", "Bm", "Ms", "%%", "m%", "B%"]
    wrong = ["%m", "mB", "%B", "sM"]
    cells = {f"{a}{n}{b}{u}{c}": value for n, value in plain for u in units + wrong for a in ("", " ") for b in ("", " ") for c in ("", " ")
             if value is None or u not in wrong}
    bad = [f"1{u}" for u in wrong] + ["1 1", "1.1.", "m1", "%"]
    names = [*cells, *bad]
    expected = [0.0 if cells[c] is None else cells[c] for c in cells] + [0.0] * len(bad)
    assert apply(spark, text.number_with_unit, names) == expected


def test_truth(spark):
    assert apply(spark, text.truth, ["true", "abc", None, "", "0", "yes"]) == [True, False, False, False, False, True]
    assert apply(spark, text.truth, [True, None, False], "boolean") == [True, False, False]


def test_written_date(spark):
    good = ["2024-01-05", "2024-1-5"]
    bad = [
        "2024-02-30", "2024-001-05", " 2024-01-05", "24-01-05", "12024-01-05", "0000-01-01", "",
        None, "2024/01/05", "2024-01-05 ",
    ]
    assert apply(spark, dates.written_date, good) == [dt.date(2024, 1, 5)] * 2
    assert apply(spark, dates.written_date, bad) == [None] * len(bad)


def test_epoch_date(spark):
    cells = ["1704067200", " 1704067199 ", "0", "-1", "x", "", None, "1.5", "99999999999999", "+86400"]
    expected = [
        dt.date(2024, 1, 1), dt.date(2023, 12, 31), dt.date(1970, 1, 1), dt.date(1969, 12, 31),
        None, None, None, None, None, dt.date(1970, 1, 2),
    ]
    assert apply(spark, dates.epoch_date, cells) == expected


def test_epoch_date_does_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert apply(spark, dates.epoch_date, ["1704067200"]) == [dt.date(2024, 1, 1)]
        assert apply(spark, dates.epoch_hour, ["1704070800", "-1"]) == [1, 23]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_calendar_keys(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 7), dt.date(2023, 12, 31), None]
    monday = [dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2023, 12, 25), None]
    first = [dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2023, 12, 1), None]
    assert apply(spark, dates.week_start, days, "date") == monday
    assert apply(spark, dates.month_start, days, "date") == first
    assert apply(spark, dates.month_key, days, "date") == ["2024-01", "2024-01", "2023-12", None]
    assert apply(spark, dates.weekday_name, days, "date") == ["Monday", "Sunday", "Sunday", None]


def test_strip_takes_every_blank_python_takes(spark):
    cells = [f"{chr(c)}a b{chr(c)}" for c in range(1, 0x3100) if chr(c).isspace()]
    assert len(cells) == len(text.BLANKS)
    assert apply(spark, text.strip, cells) == ["a b"] * len(cells)
    others = ["a", "a​b​", "é ", " \n ", "", None, "a\nb", "x\n"]
    assert apply(spark, text.strip, others) == [c.strip() if c is not None else None for c in others]
    assert apply(spark, text.has_text, [None, "", " \t", "\tx"]) == [False, False, False, True]


def test_whole_number(spark):
    cells = ["3", " 4 ", "x", None, "1.5"]
    assert apply(spark, lambda c: text.whole_number(c, 1), cells) == [3, 4, 1, 1, 1]


def test_lists_and_text(spark):
    lists = [["a", "b"], [], None, ["a"]]
    assert apply(spark, text.join_list, lists, "array<string>") == ["a, b", "", "", "a"]
    assert apply(spark, text.split_list, ["a, b", "", None, "a"]) == [["a", "b"], [], [], ["a"]]
    messy = [[" a ", "", None, "  "], None]
    assert apply(spark, text.clean_list, messy, "array<string>") == [["a", ""], []]


def test_levels(spark):
    cells = [" easy ", "MEDIUM", "Hard", "Extreme", "", None]
    names = ["Easy", "Medium", "Hard", "Unknown", "Unknown", "Unknown"]
    assert apply(spark, levels.level, cells) == names
    assert apply(spark, levels.score, names) == [1, 2, 3, 0, 0, 0]


def test_shares(spark):
    frame = spark.createDataFrame([(1, 4), (0, 0)], "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    rows = frame.select(levels.share(a, b).alias("s"), levels.percent(a, b).alias("p")).collect()
    assert [tuple(r) for r in rows] == [(0.25, 25.0), (None, 0.0)]


def test_json_cells(spark):
    companies = [
        '[{"tagName": "A"}, {"x": 1}]', '{"stats": [{"tagName": "B"}]}', '{"stats": "B"}',
        "{}", "not json", '"A"', None, "[]",
    ]
    names = [["A", ""], ["B"], [], [], [], [], [], []]
    assert apply(spark, tags.company_names, companies) == names
    topics = ['[{"name": "x", "slug": "y"}]', None, "bad", "[]"]
    assert apply(spark, tags.topic_names, topics) == [["x"], [], [], []]
    figures = apply(spark, tags.stats, ['{"acRate": "5.5%", "totalAccepted": 3}', "bad"])
    assert [tuple(f) for f in figures] == [("5.5%", "3", None), (None, None, None)]
    assert apply(spark, tags.json_map, ['{"a": 1}', "bad", None]) == [{"a": "1"}, None, None]


def test_values_helper_sorts(spark):
    assert values(spark.range(3)) == [(0,), (1,), (2,)]
