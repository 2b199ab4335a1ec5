"""Sources, result tables, batch jobs and the ingest stream."""

import datetime as dt
import json
import os
import subprocess
import sys

import pytest
from helpers import day, problems, values
from pyspark.sql import functions as F

from solvetrail import schemas
from solvetrail.plans import jobs
from solvetrail.plans.solved import solved, validated
from solvetrail.session import shared_folder
from solvetrail.sources import backup, items, profiles, submissions, tables
from solvetrail.streaming.ingest import ingest, landed_pages, landed_rows

TS = dt.datetime(2024, 1, 31, 6)
TABLES = ("problems", "analytics", "progress")


def epoch(number):
    return str(int(dt.datetime(2024, 1, number, 12, tzinfo=dt.timezone.utc).timestamp()))


def landed(spark, rows):
    """Submissions from (user, seq, item, day or None, status)."""
    out = [(u, s, f"Item {k}", f"item-{k}", epoch(d) if d else None, status, "sql", "5 ms", "1 MB")
           for u, s, k, d, status in rows]
    return spark.createDataFrame(out, schemas.SUBMISSIONS)


def metadata(spark, count=20):
    out = [
        (str(k), f"Title {k}", f"item-{k}", ["Easy", "Medium", "Hard"][k % 3],
         json.dumps([{"name": f"t{k % 4}"}, {"name": "all"}]), None, '{"acRate": "50%"}', False, "c")
        for k in range(count)
    ]
    return spark.createDataFrame(out, schemas.ITEMS)


def a_run(spark, mapping=None):
    return jobs.Run(tables.Store(spark, shared_folder(spark, "test")), TS, mapping)


def contents(store):
    return {n: values(store.read(n).drop("last_updated")) for n in TABLES}


OK = "Accepted"
BASIC = [
    (1, 0, 1, 9, OK), (1, 1, 1, 3, OK), (1, 2, 2, 4, "Wrong Answer"), (1, 3, 3, 5, OK),
    (1, 4, 99, 5, OK), (2, 0, 1, None, OK), (2, 1, 4, 6, OK),
]


def test_submission_pages(spark):
    page = {"recentSubmissionList": [{"title": "A", "titleSlug": "a", "timestamp": "1", "statusDisplay": OK,
                                      "lang": "x", "runtime": "1 ms", "memory": "2 MB"}, {"title": "B"}]}
    empty = json.dumps({"recentSubmissionList": []})
    bodies = [(1, 0, json.dumps(page)), (1, 2, json.dumps(page)), (2, 0, "not json"), (3, 0, "{}"), (4, 0, empty),
              (5, 0, json.dumps(page)[:-9]), (6, 7, None), (7, 0, '{"recentSubmissionList": 5}')]
    frame = spark.createDataFrame(bodies, "user_id bigint, offset bigint, body string")
    found = submissions.opened(frame)
    assert values(found.rows, "user_id", "seq", "title") == [(1, 0, "A"), (1, 1, "B"), (1, 2, "A"), (1, 3, "B")]
    assert found.rows.first()["memory"] == "2 MB"
    assert values(found.rejected, "source", "key", "reason") == [
        ("submissions", "2/0", "unreadable"), ("submissions", "3/0", "no list"), ("submissions", "5/0", "unreadable"),
        ("submissions", "6/7", "missing"), ("submissions", "7/0", "unreadable"),
    ]
    assert set(r["body"] for r in found.rejected.collect()) == {b for u, _, b in bodies if u in (2, 3, 5, 6, 7)}
    assert submissions.from_payloads(frame.filter("user_id in (1, 4)")).count() == 4
    for user, reason in ((2, "unreadable"), (3, "no list"), (6, "missing")):
        with pytest.raises(Exception, match=f"body of {user}/. is {reason}"):
            submissions.from_payloads(frame.filter(F.col("user_id") == user)).collect()


def test_landed_files(spark):
    """The readers for folders of landed lines."""
    folder = shared_folder(spark, "test-landed")
    page = json.dumps({"recentSubmissionList": [{"title": "A", "titleSlug": "a"}]})
    spark.createDataFrame([(1, 4, page), (1, 5, "cut")], submissions.PAGES).write.json(f"{folder}/pages")
    found = submissions.read_pages(spark, f"{folder}/pages")
    assert values(found.rows, "user_id", "seq", "title_slug") == [(1, 4, "a")]
    assert values(found.rejected) == [("submissions", "1/5", "unreadable", "cut")]
    body = json.dumps({"matchedUser": {"username": "u", "userCalendar": {"submissionCalendar": '{"0": 3}'}}})
    spark.createDataFrame([(1, body)], submissions.USER_BODIES).write.json(f"{folder}/users")
    assert values(submissions.read_calendars(spark, f"{folder}/users").rows, "n") == [(3,)]
    assert values(profiles.read_users(spark, f"{folder}/users").rows, "username") == [("u",)]
    body = json.dumps({"question": {"titleSlug": "a"}})
    spark.createDataFrame([("a", body), ("b", "cut")], items.ITEM_BODIES).write.json(f"{folder}/items")
    found = items.read_bodies(spark, f"{folder}/items")
    assert values(found.rows, "title_slug") == [("a",)]
    assert values(found.rejected) == [("items", "b", "unreadable", "cut")]


def test_calendar_last_entry_of_a_day_wins(spark):
    second = int(epoch(1))
    cells = [
        (1, json.dumps({str(second): 5, str(second + 60): 2, "x": 9, str(second + 86400): 1})),
        (2, "bad"),
        (3, None),
    ]
    frame = spark.createDataFrame(cells, "user_id bigint, calendar string")
    assert values(submissions.calendar_days(frame)) == [(1, day(1), 2), (1, day(2), 1)]
    body = json.dumps({"matchedUser": {"userCalendar": {"submissionCalendar": cells[0][1]}}})
    payloads = spark.createDataFrame([(1, body)], "user_id bigint, body string")
    assert submissions.calendars_from_payloads(payloads).first()["calendar"] == cells[0][1]
    wrapped = [(u, json.dumps({"matchedUser": {"userCalendar": {"submissionCalendar": c}}})) for u, c in cells]
    found = submissions.opened_calendars(spark.createDataFrame([*wrapped, (4, "cut"), (5, None)], submissions.USER_BODIES))
    assert values(found.rows) == [(1, day(1), 2), (1, day(2), 1)]
    assert values(found.rejected, "key", "reason") == [("2", "calendar"), ("4", "unreadable"), ("5", "missing")]


def test_item_bodies(spark):
    question = {"questionId": "7", "title": "T", "titleSlug": "t", "difficulty": "Hard",
                "topicTags": [{"name": "a", "slug": "b"}], "companyTagStats": '[{"tagName": "C"}]',
                "stats": '{"acRate": "12.5%", "totalAccepted": 4}', "isPaidOnly": None, "categoryTitle": "x"}
    bodies = [(json.dumps({"question": question}),), (json.dumps({"question": None}),), ("bad",)]
    found = items.opened(spark.createDataFrame(bodies, "body string"))
    assert values(found.rejected) == [("items", None, "unreadable", "bad")]
    row = items.catalogue(found.rows).collect()
    assert len(row) == 1
    assert row[0]["topics"] == ["a"] and row[0]["companies"] == ["C"]
    assert (row[0]["acceptance_rate"], row[0]["total_accepted"], row[0]["total_submissions"]) == ("12.5%", "4", "0")
    assert row[0]["is_paid_only"] is False
    broken = json.dumps({"question": question | {"stats": "{cut", "companyTagStats": " "}})
    found = items.opened(spark.createDataFrame([("t", broken)], items.ITEM_BODIES))
    assert values(found.rejected) == [("items", "t", "stats", "{cut")]
    assert values(items.catalogue(found.rows), "title_slug", "total_accepted") == [("t", "0")]
    with pytest.raises(Exception, match="body of b is unreadable"):
        items.from_payloads(spark.createDataFrame([("b", "cut")], items.ITEM_BODIES)).collect()


def test_user_bodies(spark):
    levels = [{"difficulty": "All", "count": 9, "submissions": 9}, {"difficulty": "Easy", "count": 1, "submissions": 4},
              {"difficulty": "easy", "count": 2, "submissions": 5}, {"difficulty": "Hard", "count": 1, "submissions": 1}]
    body = {"matchedUser": {"username": "u", "profile": {"realName": "R"}, "submitStats": {"acSubmissionNum": levels},
                            "badges": [{"displayName": "B"}]}, "userContestRanking": {"rating": 1500.5}}
    frame = spark.createDataFrame([(1, json.dumps(body)), (2, "{}"), (3, "cut")], "user_id bigint, body string")
    found = profiles.opened(frame)
    assert values(found.rejected) == [("profiles", "3", "unreadable", "cut")]
    assert found.rows.count() == 2
    one, two = profiles.from_payloads(frame.filter("user_id < 3")).orderBy("user_id").collect()
    assert (one["easy_solved"], one["hard_solved"], one["total_solved"], one["total_submissions"]) == (2, 1, 3, 6)
    assert (one["acceptance_rate"], one["contest_rating"], one["real_name"]) == (50.0, 1500.5, "R")
    assert [tuple(b) for b in one["badges"]] == [("B", "", "")]
    assert (two["username"], two["total_solved"], two["acceptance_rate"], two["badges"]) == ("", 0, 0.0, [])


def test_validation_parses_texts(spark):
    schema = ("user_id bigint, title string, difficulty string, topics array<string>, date_solved string, "
              "attempts string, acceptance_rate string, status string, is_paid_only boolean")  # fmt: skip
    rows = [
        (1, " A ", " easy", [" x", "", None], " 2024-1-5", "3", "1.5", None, None),
        (1, "B", None, None, "2024-02-30", "x", "y", " Done ", True),
        (1, "  ", "Easy", [], "2024-01-01", "1", "1", "Solved", False),
    ]
    assert values(validated(spark.createDataFrame(rows, schema)).drop("topics")) == [
        (1, "A", "Easy", dt.date(2024, 1, 5), 3, 1.5, "Solved", False),
        (1, "B", "Unknown", None, 1, 0.0, "Done", True),
    ]


def test_solved_set(spark):
    rows = solved(landed(spark, BASIC), items.catalogue(metadata(spark)))
    assert values(rows, "user_id", "title", "date_solved", "runtime", "acceptance_rate") == [
        (1, "Title 1", day(9), 5.0, 50.0), (1, "Title 3", day(5), 5.0, 50.0),
        (2, "Title 1", None, 5.0, 50.0), (2, "Title 4", day(6), 5.0, 50.0),
    ]
    assert len(rows.columns) == 18


def test_records_survive_the_table(spark):
    rows = validated(solved(landed(spark, BASIC), items.catalogue(metadata(spark))))
    back = tables.problem_records(tables.problem_rows(rows, TS))
    columns = ["user_id", "title", "difficulty", "topics", "date_solved", "attempts", "status", "problem_id"]
    assert values(back, *columns) == values(rows, *columns)


def test_headings(spark):
    rows = tables.problem_rows(validated(solved(landed(spark, BASIC), items.catalogue(metadata(spark)))), TS)
    shown = tables.with_headings(rows, "problems")
    assert shown.columns[1:] == list(schemas.HEADINGS["problems"])
    assert {r["Date Solved"] for r in shown.collect()} == {"2024-01-05", "2024-01-06", "2024-01-09", ""}


def test_tables_are_created_empty(spark):
    store = a_run(spark).store
    assert store.latest() is None
    with pytest.raises(FileNotFoundError):
        store.read("problems")
    store.ensure(TS)
    store.ensure(TS)
    assert store.runs().count() == 1
    assert contents(store) == {n: [] for n in TABLES}


def test_full_refresh(spark):
    run = a_run(spark)
    outcome = jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    assert (outcome.status, outcome.counters) == ("written", tables.Counters(4, 4))
    assert values(jobs.run_stats(run.store)) == [(4, 4, 0, 0)]
    assert values(run.store.read("progress"), "user_id", "date", "total_solved") == [
        (1, day(5), 1), (1, day(9), 2), (2, day(6), 1),
    ]
    assert run.store.read("analytics").filter("topic = 'all'").count() == 2


def test_full_refresh_stops_without_rows(spark):
    run = a_run(spark)
    rejected = landed(spark, [(1, 0, 1, 1, "Wrong Answer")])
    assert jobs.full_refresh(run, rejected, metadata(spark)).status == "nothing_fetched"
    untitled = metadata(spark).withColumn("title", F.lit(" "))
    assert jobs.full_refresh(run, landed(spark, BASIC), untitled).status == "nothing_valid"
    assert run.store.latest() is None


def test_incremental_equals_full_on_the_union(spark):
    """The stored totals and day counts plus the new ones are what counting all rows gives."""
    later = BASIC + [(1, -1, 5, 10, OK), (3, 0, 6, 2, OK), (2, 5, 7, 6, OK)]
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    outcome = jobs.incremental_refresh(run, landed(spark, later), metadata(spark))
    assert outcome.counters == tables.Counters(7, 3)
    whole = a_run(spark)
    jobs.full_refresh(whole, landed(spark, later), metadata(spark))
    assert contents(run.store) == contents(whole.store)


def test_incremental_keeps_the_stored_row(spark):
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, [(1, 0, 1, 3, OK)]), metadata(spark))
    again = landed(spark, [(1, 0, 1, 9, OK), (1, 1, 2, 9, OK)])
    jobs.incremental_refresh(run, again, metadata(spark))
    assert values(run.store.records(), "title", "date_solved") == [("Title 1", day(3)), ("Title 2", day(9))]


def test_incremental_writes_nothing_without_new_items(spark):
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    before = run.store.latest().last
    assert jobs.incremental_refresh(run, landed(spark, BASIC), metadata(spark)).status == "nothing_new"
    assert jobs.incremental_refresh(run, landed(spark, []), metadata(spark)).status == "nothing_fetched"
    assert run.store.latest().last == before


def test_incremental_starts_from_nothing(spark):
    run, whole = a_run(spark), a_run(spark)
    assert jobs.incremental_refresh(run, landed(spark, BASIC), metadata(spark)).ok
    jobs.full_refresh(whole, landed(spark, BASIC), metadata(spark))
    assert contents(run.store) == contents(whole.store)


def test_a_changed_mapping_counts_all_items_again(spark):
    later = BASIC + [(1, -1, 5, 10, OK)]
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    mapped = jobs.Run(run.store, TS, (("t1", "One"), ("all", "Every")))
    jobs.incremental_refresh(mapped, landed(spark, later), metadata(spark))
    whole = a_run(spark, mapped.mapping)
    jobs.full_refresh(whole, landed(spark, later), metadata(spark))
    assert contents(run.store) == contents(whole.store)


def test_topics_are_counted_as_the_table_holds_them(spark):
    """A name with the separator in it comes back from Problems as two, so it counts as two from the start."""
    odd = metadata(spark).withColumn("topic_tags", F.lit('[{"name": "a, b"}, {"name": "c"}]'))
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, [(1, 0, 1, 1, OK)]), odd)
    assert values(run.store.read("analytics"), "topic", "total") == [("a", 1), ("b", 1), ("c", 1)]
    jobs.incremental_refresh(run, landed(spark, [(1, 0, 2, 2, OK)]), metadata(spark))
    assert values(run.store.read("analytics"), "topic", "total") == [
        ("a", 1), ("all", 1), ("b", 1), ("c", 1), ("t2", 1),
    ]


def changed_metadata(spark):
    """Item 1 gets another level and loses its topics, item 3 another topic."""
    slug = F.col("title_slug")
    return metadata(spark).withColumns({
        "difficulty": F.when(slug == "item-1", "Easy").otherwise(F.col("difficulty")),
        "topic_tags": F.when(slug == "item-1", "[]").when(slug == "item-3", '[{"name": "t9"}]').otherwise(F.col("topic_tags")),
    })


def test_changed_items_replace_their_rows(spark):
    """Users 1 and 2 have item 1; dates and attempts stay as stored, totals follow the new metadata."""
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    later = [(1, 0, 1, 20, OK), (1, 1, 3, 21, OK), (1, 2, 5, 22, OK), (2, 0, 1, 23, OK)]
    outcome = jobs.incremental_refresh(run, landed(spark, later), changed_metadata(spark))
    assert outcome.counters == tables.Counters(5, 1, 3, 0)
    assert values(jobs.run_stats(run.store)) == [(5, 1, 3, 0)]
    assert values(run.store.records(), "user_id", "title", "difficulty", "topics", "date_solved") == [
        (1, "Title 1", "Easy", [], day(9)), (1, "Title 3", "Easy", ["t9"], day(5)), (1, "Title 5", "Hard", ["t1", "all"], day(22)),
        (2, "Title 1", "Easy", [], None), (2, "Title 4", "Medium", ["t0", "all"], day(6)),
    ]
    assert values(run.store.read("analytics"), "user_id", "topic", "total", "last_solved") == [
        (1, "all", 1, day(22)), (1, "t1", 1, day(22)), (1, "t9", 1, day(5)), (2, "all", 1, day(6)), (2, "t0", 1, day(6)),
    ]
    assert values(run.store.read("progress"), "user_id", "date", "total_solved") == [
        (1, day(5), 1), (1, day(9), 2), (1, day(22), 3), (2, day(6), 1),
    ]
    runs = run.store.runs().count()
    assert jobs.incremental_refresh(run, landed(spark, later), changed_metadata(spark)).status == "nothing_new"
    assert run.store.runs().count() == runs


def test_an_updated_user_can_lose_all_topics(spark):
    """The Analytics partition of a user whose only item lost its topics goes."""
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, [(1, 0, 1, 3, OK)]), metadata(spark))
    assert run.store.read("analytics").count() == 2
    assert jobs.incremental_refresh(run, landed(spark, [(1, 0, 1, 4, OK)]), changed_metadata(spark)).counters.updated_problems == 1
    assert values(run.store.read("analytics")) == []
    assert values(run.store.records(), "date_solved") == [(day(3),)]


def test_a_full_refresh_says_what_changed(spark):
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    again = jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    assert (again.status, run.store.runs().count()) == ("nothing_new", 1)
    more = landed(spark, BASIC + [(3, 0, 6, 2, OK)])
    assert jobs.full_refresh(run, more, changed_metadata(spark)).counters == tables.Counters(5, 1, 3, 0)
    fewer = jobs.full_refresh(run, landed(spark, BASIC[:1]), changed_metadata(spark))
    assert (fewer.status, fewer.counters) == ("written", tables.Counters(1))
    assert run.store.read("progress").count() == 1


def files(store, name):
    """Names and times of a table's files, by partition."""
    found = {}
    for folder, _, names in os.walk(store.path(store.latest().last["version"], name)):
        rows = [(n, os.stat(f"{folder}/{n}").st_mtime_ns) for n in names if n.startswith("part-")]
        if rows:
            found[folder] = sorted(rows)
    return found


def test_work_follows_the_batch(spark):
    """One new item of one user: one partition of each table is written, of 16 buckets and 3 months."""
    run = a_run(spark)
    rows = [(u, k, k, 1 + 9 * k, OK) for u in range(200) for k in range(3)]
    jobs.full_refresh(run, landed(spark, rows), metadata(spark))
    before = {name: files(run.store, name) for name in TABLES}
    assert len(before["analytics"]) == len(before["progress"]) == tables.BUCKETS
    jobs.incremental_refresh(run, landed(spark, [(7, 9, 9, 4, OK)]), metadata(spark))
    for name in TABLES:
        after = files(run.store, name)
        assert sum(after.get(k) != before[name].get(k) for k in after.keys() | before[name].keys()) == 1
    whole = a_run(spark)
    jobs.full_refresh(whole, landed(spark, [*rows, (7, 9, 9, 4, OK)]), metadata(spark))
    assert contents(run.store) == contents(whole.store)


def months_apart(spark, users=8):
    """Items of four months per user, and one without a date."""
    moments = [dt.datetime(2024, m, 20, tzinfo=dt.timezone.utc) for m in (1, 2, 3, 4)] + [None]
    out = [(u, k, f"Item {k}", f"item-{k}", str(int(t.timestamp())) if t else None, OK, "sql", "5 ms", "1 MB")
           for u in range(users) for k, t in enumerate(moments)]
    return spark.createDataFrame(out, schemas.SUBMISSIONS)


def test_whole_months_go_unread(spark):
    """Partitions of months that stay whole are not written again, those that go are never read."""
    run = a_run(spark)
    jobs.full_refresh(run, months_apart(spark), metadata(spark))
    before = files(run.store, "problems")
    # What is in the oldest month can't be read, so reading it would fail.
    for folder in before:
        if folder.endswith("month=2024-01"):
            for name, _ in before[folder]:
                size = os.path.getsize(f"{folder}/{name}")
                with open(f"{folder}/{name}", "r+b") as file:
                    file.write(b"x" * (size - 2000 if size > 4000 else 8))
                os.path.exists(f"{folder}/.{name}.crc") and os.remove(f"{folder}/.{name}.crc")
    outcome = jobs.cleanup(run, dt.date(2024, 4, 30), 60)
    assert (outcome.status, outcome.counters.total_problems) == ("written", 16)
    after = files(run.store, "problems")
    assert {f.rsplit("=")[-1] for f in after} == {"2024-03", "2024-04"}
    assert all(before[folder] == after[folder] for folder in after)
    whole = a_run(spark)
    jobs.full_refresh(whole, months_apart(spark).filter("seq in (2, 3)"), metadata(spark))
    assert contents(run.store) == contents(whole.store)
    kept = run.store.latest().placed("problems").filter("month >= '2024-04'")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_cleanup_inside_a_month(spark):
    run = a_run(spark)
    rows = [(u, k, k, 5 + 5 * k, OK) for u in range(6) for k in range(4)]
    jobs.full_refresh(run, landed(spark, rows), metadata(spark))
    jobs.cleanup(run, day(31), 20)
    whole = a_run(spark)
    jobs.full_refresh(whole, landed(spark, [r for r in rows if r[3] >= 11]), metadata(spark))
    assert contents(run.store) == contents(whole.store)


def test_what_cannot_be_read_is_kept_and_counted(spark):
    """A run over pages and items of which some are broken."""
    page = lambda k: json.dumps({"recentSubmissionList": [{"titleSlug": f"item-{k}", "statusDisplay": OK, "timestamp": epoch(k)}]})
    bodies = [(1, 0, page(1)), (1, 1, "cut"), (2, 0, page(2)), (2, 1, None)]
    pages = submissions.opened(spark.createDataFrame(bodies, submissions.PAGES))
    details = [(f"item-{k}", json.dumps({"question": {"titleSlug": f"item-{k}", "title": f"T{k}", "stats": "x" if k == 1 else None}})) for k in (1, 2)]
    bad = items.opened(spark.createDataFrame([*details, ("item-3", "<html>")], items.ITEM_BODIES))
    run = a_run(spark)
    assert jobs.full_refresh(run, pages, bad).counters == tables.Counters(2, 2, 0, 4)
    assert values(run.store.rejected(), "job", "source", "key", "reason") == [
        ("full", "items", "item-1", "stats"), ("full", "items", "item-3", "unreadable"),
        ("full", "submissions", "1/1", "unreadable"), ("full", "submissions", "2/1", "missing"),
    ]
    assert jobs.incremental_refresh(run, pages, bad).counters.errors == 4
    assert values(jobs.run_stats(run.store), "errors") == [(4,)]


def test_cleanup(spark):
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    assert jobs.cleanup(run, day(15), 9).counters.total_problems == 2
    assert values(run.store.records(), "title", "date_solved") == [("Title 1", day(9)), ("Title 4", day(6))]
    assert run.store.read("progress").count() == 2
    before = run.store.latest().last
    assert jobs.cleanup(run, day(15), 9).status == "nothing_old"
    assert run.store.latest().last == before
    assert jobs.cleanup(run, day(31), 1).ok
    assert contents(run.store) == {n: [] for n in TABLES}


def test_backup_and_restore(spark):
    run, again = a_run(spark), a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    path = shared_folder(spark, "test-backup")
    assert jobs.backup(run, path) == 4
    manifest = spark.read.schema(backup.MANIFEST).json(f"{path}/manifest").first()
    assert manifest["sync_stats"]["total_problems"] == 4 and manifest["backup_timestamp"] == TS
    assert jobs.restore(again, path).counters.total_problems == 4
    assert contents(again.store) == contents(run.store)


def test_damaged_or_empty_backups_are_refused(spark):
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    path = shared_folder(spark, "test-backup")
    jobs.backup(run, path)
    run.store.records().limit(1).write.mode("append").json(f"{path}/problems")
    with pytest.raises(ValueError):
        backup.read_backup(spark, path)
    run.store.ensure(TS)
    empty = a_run(spark)
    empty.store.ensure(TS)
    path = shared_folder(spark, "test-backup")
    assert jobs.backup(empty, path) == 0
    with pytest.raises(ValueError):
        backup.read_backup(spark, path)


def test_one_changed_cell_makes_restore_fail(spark):
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    path = shared_folder(spark, "test-backup")
    jobs.backup(run, path)
    rows = backup._rows(spark, path)
    changed = rows.withColumn("difficulty", F.when(F.col("title") == "Title 3", "Hard").otherwise(F.col("difficulty")))
    other = shared_folder(spark, "test-backup")
    changed.write.json(f"{other}/problems")
    spark.read.text(f"{path}/manifest").write.text(f"{other}/manifest")
    with pytest.raises(ValueError, match="not the ones"):
        jobs.restore(a_run(spark), other)
    same = shared_folder(spark, "test-backup")
    rows.repartition(3).write.json(f"{same}/problems")
    spark.read.text(f"{path}/manifest").write.text(f"{same}/manifest")
    assert jobs.restore(a_run(spark), same).counters.total_problems == 4


def test_a_version_without_its_run_is_not_seen(spark):
    """What a dead full refresh left is not read, and goes with the next one that ends."""
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    before = contents(run.store)
    run.store.write("v-lost", "problems", run.store.latest().placed("problems"))
    assert contents(run.store) == before
    for k in (5, 6):
        assert jobs.full_refresh(run, landed(spark, BASIC + [(1, 9, k, 2, OK)]), metadata(spark)).ok
    versions = [name for name in os.listdir(run.store.base.removeprefix("file:")) if name.startswith("v-")]
    assert len(versions) == 2 and "v-lost" not in versions


def test_a_dead_run_blocks_nobody(spark):
    """An empty file and a torn row among the runs count for nothing, and the next run ends well."""
    run = a_run(spark)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    open(f"{run.store.base.removeprefix('file:')}/runs/part-dead.json", "w").close()
    with open(f"{run.store.base.removeprefix('file:')}/runs/part-torn.json", "w") as torn:
        torn.write('{"run_id":9,"job":"f')
    more = landed(spark, BASIC + [(1, 9, 5, 12, OK), (2, 9, 6, 12, OK)])
    assert jobs.incremental_refresh(run, more, metadata(spark)).counters == tables.Counters(6, 2)
    whole = a_run(spark)
    jobs.full_refresh(whole, more, metadata(spark))
    assert contents(run.store) == contents(whole.store)


@pytest.mark.parametrize("dies_at", ["analytics", "progress", "problems", "record"])
def test_a_run_that_died_is_made_good_by_the_next(spark, monkeypatch, dies_at):
    """Wherever an incremental run dies, running it again gives the tables that it would have left."""
    run, more = a_run(spark), landed(spark, BASIC + [(1, 9, 5, 12, OK), (2, 9, 6, 12, OK)])
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    write, record = tables.Store.write, tables.Store.record

    def dying_write(store, version, name, placed):
        if name == dies_at:
            raise RuntimeError("dead")
        write(store, version, name, placed)

    def dying_record(*args, **more):
        if dies_at == "record":
            raise RuntimeError("dead")
        record(*args, **more)

    monkeypatch.setattr(tables.Store, "write", dying_write)
    monkeypatch.setattr(tables.Store, "record", dying_record)
    with pytest.raises(RuntimeError):
        jobs.incremental_refresh(run, more, metadata(spark))
    monkeypatch.undo()
    jobs.incremental_refresh(run, more, metadata(spark))
    whole = a_run(spark)
    jobs.full_refresh(whole, more, metadata(spark))
    assert contents(run.store) == contents(whole.store)


def test_unreadable_tables_are_an_error(spark, tmp_path):
    run = jobs.Run(tables.Store(spark, str(tmp_path / "t")), TS)
    jobs.full_refresh(run, landed(spark, BASIC), metadata(spark))
    import shutil

    shutil.rmtree(run.store.path(run.store.latest().last["version"], "problems"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jobs.incremental_refresh(run, landed(spark, BASIC), metadata(spark))


STREAM = [
    [(1, 0, 1, 2, OK), (1, 1, 2, 1, OK)],
    [(1, 0, 1, 6, OK), (1, 1, 3, 5, OK), (2, 0, 1, 5, "Wrong Answer")],
    [(2, 0, 1, 8, OK), (3, 0, 4, 9, OK)],
]


def test_stream_equals_incremental_runs(spark):
    stream, batch = a_run(spark), a_run(spark)
    landing, state = shared_folder(spark, "test-landing"), shared_folder(spark, "test-state")
    for rows in STREAM:
        landed(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        ingest(stream, landed_rows(spark, landing), metadata(spark), state)
        jobs.incremental_refresh(batch, landed(spark, rows), metadata(spark))
        assert contents(stream.store) == contents(batch.store)
    commits = stream.store.runs().count()
    ingest(stream, landed_rows(spark, landing), metadata(spark), state)
    assert stream.store.runs().count() == commits


def test_stream_batches_and_replays_give_the_same_titles(spark):
    """All landings at once, file by file; then all of them once more under a new checkpoint."""
    run = a_run(spark)
    landing = shared_folder(spark, "test-landing")
    for rows in STREAM:
        landed(spark, rows).coalesce(1).write.mode("append").parquet(landing)
    one_by_one = landed_rows(spark, landing, files_per_batch=1)
    ingest(run, one_by_one, metadata(spark), shared_folder(spark, "test-state"))
    found = contents(run.store)
    assert [r[:2] for r in found["problems"]] == [
        (1, "Title 1"), (1, "Title 2"), (1, "Title 3"), (2, "Title 1"), (3, "Title 4"),
    ]
    ingest(run, landed_rows(spark, landing), metadata(spark), shared_folder(spark, "test-state"))
    assert contents(run.store) == found


def test_stream_of_pages(spark):
    run = a_run(spark)
    landing = shared_folder(spark, "test-landing")
    rows = [{"titleSlug": f"item-{k}", "statusDisplay": OK, "timestamp": epoch(k)} for k in (1, 2)]
    page = json.dumps({"recentSubmissionList": rows})
    spark.createDataFrame([(1, 0, page), (1, 2, "cut")], submissions.PAGES).write.json(landing)
    ingest(run, landed_pages(spark, landing), metadata(spark), shared_folder(spark, "test-state"))
    assert values(run.store.records(), "title", "date_solved") == [("Title 1", day(1)), ("Title 2", day(2))]
    assert values(run.store.rejected(), "key", "reason") == [("1/2", "unreadable")]


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    first, second = shared_folder(spark, "p"), shared_folder(spark, "p")
    assert first != second and first.startswith(f"{base.rstrip('/')}/solvetrail/p-")


def test_problem_rows_fill_in_defaults(spark):
    rows = problems(spark, [(1, None, None, None)]).withColumn("attempts", F.lit(None).cast("bigint"))
    rows = rows.withColumn("status", F.lit(None).cast("string")).withColumn("problem_id", F.lit(None).cast("string"))
    assert values(tables.problem_rows(rows, TS).drop("last_updated")) == [
        (1, "Item 0", "", "", None, 1, "Solved", ""),
    ]


def test_no_submission_is_dropped_however_many_a_user_has(spark):
    """12,000 submissions of one user, through every job and the stream."""
    many = [(1, s, s, 1 + s % 28, OK) for s in range(12_000)]
    frame, items_of = landed(spark, many), metadata(spark, 12_000)
    run = a_run(spark)
    assert jobs.full_refresh(run, frame.filter("seq < 6000"), items_of).counters.total_problems == 6000
    assert jobs.incremental_refresh(run, frame, items_of).counters.new_problems == 6000
    folder = shared_folder(spark, "test-many")
    assert jobs.backup(run, folder) == 12_000
    again = a_run(spark)
    assert jobs.restore(again, folder).counters.total_problems == 12_000
    assert jobs.cleanup(again, dt.date(2024, 1, 31), 365).counters.total_problems == 12_000
    stream = a_run(spark)
    frame.write.parquet(f"{folder}-landing")
    ingest(stream, landed_rows(spark, f"{folder}-landing"), items_of, f"{folder}-state")
    assert stream.store.records().count() == 12_000


def test_a_replayed_batch_writes_nothing(spark):
    """The number of a stream's batch is recorded with the run; so the same batch again changes nothing."""
    run = a_run(spark)
    assert jobs.incremental_refresh(run, landed(spark, BASIC), metadata(spark), source="s", batch=0).status == "written"
    before, runs = contents(run.store), run.store.runs().count()
    other = landed(spark, [(5, 0, 5, 5, OK)])
    assert jobs.incremental_refresh(run, other, metadata(spark), source="s", batch=0).status == "nothing_new"
    assert (contents(run.store), run.store.runs().count()) == (before, runs)
    assert jobs.incremental_refresh(run, other, metadata(spark), source="s", batch=1).status == "written"
    assert jobs.incremental_refresh(run, landed(spark, [(6, 0, 5, 5, OK)]), metadata(spark), source="t", batch=0).status == "written"


def test_the_stream_drops_what_earlier_batches_brought(spark, monkeypatch):
    """The refresh of a later landing sees only items that no batch before had; an item waits for its metadata."""
    run, seen = a_run(spark), []
    refresh = jobs.incremental_refresh

    def counted(run, rows, items, *args, **more):
        seen.append(values(rows, "user_id", "title_slug", "seq"))
        return refresh(run, rows, items, *args, **more)

    monkeypatch.setattr("solvetrail.streaming.ingest.incremental_refresh", counted)
    landing, state = shared_folder(spark, "test-landing"), shared_folder(spark, "test-state")
    known = [metadata(spark, 3), metadata(spark, 3), metadata(spark, 30)]
    rows = [
        [(1, 5, 1, 3, OK), (1, 2, 1, 4, OK), (1, 3, 2, 4, "Wrong Answer"), (1, 4, 25, 4, OK)],
        [(1, 0, 1, 6, OK), (1, 1, 2, 6, OK), (2, 0, 1, 6, OK)],
        [(1, 0, 1, 8, OK), (1, 0, 25, 8, OK)],
    ]
    for batch, items_of in zip(rows, known, strict=True):
        landed(spark, batch).coalesce(1).write.mode("append").parquet(landing)
        ingest(run, landed_rows(spark, landing), items_of, state)
    assert seen == [[(1, "item-1", 2)], [(1, "item-2", 1), (2, "item-1", 0)], [(1, "item-25", 0)]]
    assert values(run.store.records(), "user_id", "title", "date_solved") == [
        (1, "Title 1", day(4)), (1, "Title 2", day(6)), (1, "Title 25", day(8)), (2, "Title 1", day(6)),
    ]


@pytest.mark.parametrize("limit", [None, 1])
def test_a_stream_refresh_reads_written_rows_and_the_items_they_name(spark, monkeypatch, limit):
    """A batch's own plans are not adaptive, and parsing all items costs the same for every landing."""
    run, seen = a_run(spark), []
    refresh = jobs.incremental_refresh

    def looked(run, rows, items, *args, **more):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        adaptive = rows.sparkSession.conf.get("spark.sql.adaptive.enabled")
        seen.append((plan.startswith("Relation"), adaptive, values(items, "title_slug")))
        return refresh(run, rows, items, *args, **more)

    monkeypatch.setattr("solvetrail.streaming.ingest.incremental_refresh", looked)
    landing, state = shared_folder(spark, "test-landing"), shared_folder(spark, "test-state")
    for rows in ([(1, 0, 1, 2, OK), (1, 1, 2, 1, OK), (2, 0, 99, 1, OK)], [(1, 0, 1, 6, OK), (None, 0, 3, 5, OK)]):
        landed(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        ingest(run, landed_rows(spark, landing), metadata(spark).unionByName(metadata(spark, 2)), state, limit=limit)
    again = [("item-1",), ("item-1",)] if limit else []
    assert seen == [
        (True, "true", [("item-1",), ("item-1",), ("item-2",)]),
        (True, "true", [*again, ("item-3",)]),
    ]


def test_a_stream_with_a_limit(spark):
    """Each landing's first submissions count; what is new is found by the refresh alone."""
    run, batch = a_run(spark), a_run(spark)
    landing, state = shared_folder(spark, "test-landing"), shared_folder(spark, "test-state")
    for rows in STREAM:
        landed(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        ingest(run, landed_rows(spark, landing), metadata(spark), state, limit=1)
        jobs.incremental_refresh(batch, landed(spark, rows), metadata(spark), limit=1)
    assert contents(run.store) == contents(batch.store)


ELSEWHERE = """
import datetime as dt, sys
sys.path.insert(0, sys.argv[1])
from solvetrail.session import local_session
from solvetrail.sources import backup, tables
spark = local_session("1", "1g")
ts = dt.datetime(2024, 1, 31, 6)
rows = spark.createDataFrame([(1, "a", "Easy", [], None, 1, "Solved", "1")], "user_id bigint, title string, difficulty string, topics array<string>, date_solved date, attempts bigint, status string, problem_id string")
problems = tables.problem_rows(rows, ts)
store = tables.Store(spark, sys.argv[2] + "/store")
store.ensure(ts)
backup.write_backup(tables.problem_records(problems), sys.argv[2] + "/backup", tables.Counters(), ts)
shown = [
    tables.with_headings(problems, "problems").first()["Last Updated"],
    store.runs().selectExpr("cast(run_ts as string) t").first()["t"],
    spark.read.schema(backup.MANIFEST).json(sys.argv[2] + "/backup/manifest").selectExpr("cast(backup_timestamp as string) t").first()["t"],
]
print("SHOWN", shown == ["2024-01-31 06:00:00"] * 3, shown)
"""


def test_moments_are_utc_on_a_machine_in_another_zone(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-c", ELSEWHERE, root, str(tmp_path)], env=os.environ | {"TZ": "America/New_York"},
        capture_output=True, text=True, timeout=300, check=False,
    )
    assert "SHOWN True" in done.stdout, done.stdout + done.stderr[-2000:]
