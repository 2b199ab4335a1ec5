import json
import random

from helpers import day, problems, values

from solvetrail.operators import topics
from solvetrail.sources import mapping

SMALL = (("old", "Age"), ("Tree", "Trees"), ("tree house", "Houses"), ("cold front", "Weather"))


def mapped(spark, names, table=SMALL):
    frame = spark.createDataFrame([(names,)], "topics array<string>")
    return sorted(mapping.with_categories(frame, table).first()["categories"] or [])


def test_exact_entry_wins_over_an_earlier_partial_one(spark):
    table = (("tre", "First"), ("Tree", "Exact"))
    assert mapped(spark, ["Tree"], table) == ["Exact"]
    assert mapped(spark, ["tree"], table) == ["First"]


def test_partial_match_works_in_both_directions_and_in_order(spark):
    assert mapped(spark, ["Binary tree"]) == ["Trees"]
    assert mapped(spark, ["front"]) == ["Weather"]
    assert mapped(spark, ["cold"]) == ["Age"]
    assert mapped(spark, ["House"]) == ["Houses"]
    assert mapped(spark, ["Math"]) == ["Math"]


def test_empty_topic_takes_the_first_category(spark):
    assert mapped(spark, [""]) == ["Age"]
    assert mapped(spark, []) == []


def test_match_kinds(spark):
    frame = spark.createDataFrame([("Tree",), ("cold",), ("x",)], "topic string")
    assert values(mapping.match_kinds(frame, SMALL)) == [
        ("Tree", "Trees", "exact"), ("cold", "Age", "partial"), ("x", "x", "none"),
    ]


def test_standard_mapping():
    assert len(mapping.STANDARD) == 57
    assert len(set(t for t, _ in mapping.STANDARD)) == 57
    assert len(set(c for _, c in mapping.STANDARD)) == 27


def test_read_mapping_keeps_the_order(spark, tmp_path):
    path = tmp_path / "mapping.json"
    path.write_text(json.dumps(dict(SMALL), indent=1))
    assert mapping.read_mapping(spark, str(path)) == SMALL


def test_of_a_repeated_name_the_first_entry_counts(spark):
    assert mapped(spark, ["a", "b"], (("a", "X"), ("a", "Y"), ("b", "Z"))) == ["X", "Z"]
    assert mapped(spark, ["q", ""], (("zz", "Z"), ("", "All"))) == ["All"]


def test_a_mapping_of_any_size(spark):
    """5,000 entries, with topics found in each way, against the definition."""
    random.seed(3)
    word = lambda n: "".join(random.choices("abcd", k=n))
    table = [(word(random.randint(4, 9)).title(), f"c{i}") for i in range(5000)]
    names = {word(random.randint(1, 12)) for _ in range(300)} | {name for name, _ in table[::100]} | {"zzz", ""}
    found = mapping.match_kinds(spark.createDataFrame([(n,) for n in names], "topic string"), table)
    first = dict(reversed(table))

    def expected(topic):
        if topic in first:
            return topic, first[topic], "exact"
        low = topic.lower()
        hit = next((c for n, c in table if n.lower() in low or low in n.lower()), None)
        return (topic, hit, "partial") if hit else (topic, topic, "none")

    assert values(found) == sorted(expected(n) for n in names)


ROWS = [
    (1, "Easy", ["a", "a", "b"], 3),
    (1, "Hard", ["a"], 5),
    (1, "Unknown", ["a"], None),
    (1, "Medium", [], 9),
    (2, "Easy", ["b"], 1),
]


def test_totals_without_mapping_count_repeats(spark):
    assert values(topics.topic_totals(problems(spark, ROWS))) == [
        (1, "a", 4, 4, 2, 0, 1, day(5)), (1, "b", 1, 1, 1, 0, 0, day(3)), (2, "b", 1, 1, 1, 0, 0, day(1)),
    ]


def test_totals_with_mapping_count_an_item_once(spark):
    table = (("a", "X"), ("b", "X"))
    assert values(topics.topic_totals(problems(spark, ROWS), table)) == [
        (1, "X", 3, 3, 1, 0, 1, day(5)), (2, "X", 1, 1, 1, 0, 0, day(1)),
    ]


def test_totals_add_up(spark):
    rows = problems(spark, ROWS)
    first, rest = rows.filter("seq < 2"), rows.filter("seq >= 2")
    both = topics.add_topic_totals(topics.topic_totals(first), topics.topic_totals(rest))
    columns = ["user_id", "topic", "total", "easy", "hard", "last_solved"]
    assert values(both, *columns) == values(topics.topic_totals(rows), *columns)


def test_analytics_rows(spark):
    rows = topics.analytics_rows(topics.topic_totals(problems(spark, ROWS)))
    assert {r["percentage"] for r in rows.collect()} == {1.0}


def test_completion(spark):
    catalogue = spark.createDataFrame([(["a", "a"],), (["a", "b"],), (["c"],)], "topics array<string>")
    rows = problems(spark, [(1, "Easy", ["a", "a"], 1), (1, "Easy", ["z"], 1)])
    assert values(topics.completion(rows, catalogue)) == [(1, "a", 2, 1, 0.5), (1, "z", 0, 1, None)]


def test_topic_levels(spark):
    rows = problems(spark, [(1, "Easy", ["a"], 1), (1, "Hard", ["a"], 40), (1, "Hard", ["a"], 2), (1, "Hard", ["a"], None)])
    assert values(topics.topic_levels(rows)) == [(1, "a", day(1), 2.0), (1, "a", day(32), 3.0)]
