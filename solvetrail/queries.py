"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvetrail.functions import dates, levels
from solvetrail.functions.text import join_list, number_with_unit
from solvetrail.operators import changes, daily, difficulty, patterns, select, streaks, topics
from solvetrail.plans import analytics, jobs
from solvetrail.plans.solved import accepted_submissions, catalogue_with_categories, solved, validated
from solvetrail.session import shared_folder, tune
from solvetrail.sources import backup as backups
from solvetrail.sources import items as item_source
from solvetrail.sources import mapping as topic_mapping
from solvetrail.sources import profiles, samples
from solvetrail.sources import submissions as submission_source
from solvetrail.sources.tables import Store, problem_records, problem_rows, with_headings
from solvetrail.streaming.ingest import ingest, landed_rows

Query = Callable[[SparkSession, str], DataFrame]

RUN_TS = dt.datetime(2024, 1, 31, 6, 0, 0)
SPLIT_DATE = dt.date(2024, 1, 20)
LINES_AS_OF = dt.date(2001, 11, 5)
KEPT_DAYS = 10
SHORT_LIMIT = 20
# The test tables are small; a real one has more.
STORE_BUCKETS = 4

_REGISTERED: dict[str, Query] = {}


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(tune(spark), folder)

    run.__doc__ = function.__doc__
    _REGISTERED[function.__name__] = run
    return run


def _catalogue(spark, folder):
    return item_source.catalogue(samples.items(spark, folder))


def _solved(spark, folder, limit=None):
    return solved(samples.submissions(spark, folder), _catalogue(spark, folder), limit)


def _clean(spark, folder):
    return validated(_solved(spark, folder))


def _clean_lines(spark, folder):
    lines = samples.submissions_from_lines(spark, folder)
    return validated(solved(lines, _catalogue(spark, folder), None))


def _days(spark, folder):
    return daily.day_counts(_clean(spark, folder))


def _days_lines(spark, folder):
    return daily.day_counts(_clean_lines(spark, folder))


def _six(name: str):
    return F.round(name, 6).alias(name)


def _solved_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "user_id", "title_slug", "problem_id", "title", "difficulty", "date_solved", "language",
        "runtime", "memory", "is_paid_only", "category", "acceptance_rate", "attempts", "status",
        join_list(F.col("topics")).alias("topics_text"),
        join_list(F.col("companies")).alias("companies_text"),
    )


# Sources


@query
def s1_submissions(spark, folder):
    """Landed submission pages, opened; a page has all rows of a user's day."""
    return submission_source.from_payloads(samples.pages(spark, folder))


@query
def s1_readable_pages(spark, folder):
    """The rows of the readable pages, where one page in ten is broken."""
    found = submission_source.opened(samples.damaged(samples.pages(spark, folder), "user_id", "offset"))
    return found.rows.select("user_id", "seq", "title_slug")


@query
def s1_rejected_pages(spark, folder):
    """The pages that can't be read, with their keys."""
    return submission_source.opened(samples.damaged(samples.pages(spark, folder), "user_id", "offset")).rejected


@query
def s2_details(spark, folder):
    """Landed item bodies, opened."""
    return item_source.catalogue(item_source.from_payloads(samples.item_bodies(spark, folder))).select(
        "title_slug", "problem_id", "title", "difficulty", "category", "is_paid_only",
        join_list(F.col("topics")).alias("topics_text"),
        join_list(F.col("companies")).alias("companies_text"),
        "acceptance_rate", "total_accepted", "total_submissions",
    )


@query
def s2_rejected_items(spark, folder):
    """Item bodies that can't be read, and cells of items that can't."""
    return item_source.opened(samples.damaged(samples.item_bodies(spark, folder, cells=True), "title_slug")).rejected


@query
def s3_rejected_profiles(spark, folder):
    return profiles.opened(samples.damaged(samples.user_payloads(spark, folder), "user_id")).rejected


@query
def a12_rejected_calendars(spark, folder):
    """Calendar bodies that can't be read, and those whose calendar can't."""
    return submission_source.opened_calendars(samples.damaged(samples.calendar_bodies(spark, folder), "user_id")).rejected


@query
def a12_readable_calendars(spark, folder):
    return submission_source.opened_calendars(samples.damaged(samples.calendar_bodies(spark, folder), "user_id")).rows


@query
def s3_user_profiles(spark, folder):
    users = profiles.from_payloads(samples.user_payloads(spark, folder))
    return users.select(
        "user_id", "username", "real_name", "country", "star_rating", "ranking", "reputation",
        "contest_rating", "contest_rank", "contests_attended",
        F.size("badges").cast("bigint").alias("n_badges"),
    )


@query
def a9_user_stats(spark, folder):
    users = profiles.from_payloads(samples.user_payloads(spark, folder))
    return users.select(
        "user_id", "total_solved", "total_submissions", _six("acceptance_rate"),
        "easy_solved", "medium_solved", "hard_solved", "easy_total", "medium_total", "hard_total",
    )


@query
def a12_calendar_days(spark, folder):
    return submission_source.calendar_days(samples.calendars(spark, folder))


# Functions over whole columns


@query
def f2_numbers(spark, folder):
    rows = samples.submissions(spark, folder)
    return rows.select(
        "user_id",
        "seq",
        number_with_unit(F.col("runtime")).alias("runtime"),
        number_with_unit(F.col("memory")).alias("memory"),
    )


@query
def f3_f7_calendar_keys(spark, folder):
    rows = samples.submissions(spark, folder)
    rows = rows.withColumn("date", dates.epoch_date(F.col("timestamp")))
    date = F.col("date")
    return rows.select(
        "user_id",
        "seq",
        "date",
        dates.week_start(date).alias("week_start"),
        dates.month_start(date).alias("month_start"),
        dates.month_key(date).alias("month_key"),
        dates.weekday_name(date).alias("day_name"),
    )


@query
def f11_scores(spark, folder):
    rows = _catalogue(spark, folder)
    name = levels.level(F.col("difficulty"))
    return rows.select("title_slug", name.alias("difficulty"), levels.score(name).alias("score"))


# Filters, first-n, first per item, joins


@query
def p1_accepted(spark, folder):
    rows = select.with_slug(select.accepted(samples.submissions(spark, folder)))
    return rows.select("user_id", "seq", "title_slug")


@query
def o3_limited(spark, folder):
    """A limit small enough to bite."""
    rows = accepted_submissions(samples.submissions(spark, folder), SHORT_LIMIT)
    return rows.select("user_id", "seq", "title_slug")


@query
def u3_first_per_item(spark, folder):
    rows = select.accepted(samples.submissions(spark, folder))
    return select.first_per_item(rows).select("user_id", "seq", "title_slug")


@query
def j1_with_items(spark, folder):
    rows = select.first_per_item(select.accepted(samples.submissions_from_lines(spark, folder)))
    joined = select.with_items(rows, _catalogue(spark, folder))
    return joined.select("s.user_id", "s.seq", "s.title_slug", "d.problem_id", "d.category")


@query
def j2_calendar(spark, folder):
    rows = accepted_submissions(samples.submissions(spark, folder))
    days = submission_source.calendar_days(samples.calendars(spark, folder))
    return select.with_daily_count(rows, days).select(
        "user_id", "seq", "date_solved", "daily_count"
    )


@query
def j3_j4_topic_map(spark, folder):
    names = _catalogue(spark, folder).select(F.explode("topics").alias("topic")).distinct()
    return topic_mapping.match_kinds(names, samples.MAPPING)


@query
def s10_standard_mapping(spark, folder):
    """Names that are in the mapping, that contain or are contained in one or several, and that are not."""
    return topic_mapping.match_kinds(samples.topic_names(spark, folder), topic_mapping.STANDARD)


@query
def u2_item_categories(spark, folder):
    rows = _catalogue(spark, folder).select("title_slug", "topics")
    mapped = topic_mapping.with_categories(rows, samples.MAPPING)
    return mapped.select("title_slug", F.explode("categories").alias("category"))


# The solved set and its clean form


@query
def e1_solved(spark, folder):
    return _solved_columns(_solved(spark, folder))


@query
def e1_solved_short(spark, folder):
    """The solved set under a limit that bites: the limit comes before the status filter."""
    return _solved_columns(_solved(spark, folder, SHORT_LIMIT))


@query
def e1_solved_lines(spark, folder):
    lines = samples.submissions_from_lines(spark, folder)
    return _solved_columns(solved(lines, _catalogue(spark, folder)))


@query
def e2_validated(spark, folder):
    return _solved_columns(_clean(spark, folder))


@query
def e2_text_records(spark, folder):
    """Records whose cells are texts: blank titles, bad dates, numbers and flags."""
    return validated(samples.text_records(spark, folder))


@query
def p13_with_slug(spark, folder):
    """Submissions of which every ninth item has lost its slug."""
    rows = samples.submissions(spark, folder)
    lost = F.substring("title_slug", -1, 1) == "9"
    rows = rows.withColumn("title_slug", F.when(~lost, F.col("title_slug")).otherwise(""))
    return select.with_slug(rows).select("user_id", "seq", "title_slug")


# Topics


@query
def a1_topics(spark, folder):
    return topics.topic_totals(_clean(spark, folder))


@query
def a1_topics_mapped(spark, folder):
    catalogue = catalogue_with_categories(_catalogue(spark, folder), samples.MAPPING)
    return topics.topic_totals(validated(solved(samples.submissions(spark, folder), catalogue)))


@query
def a1_topics_lines(spark, folder):
    return topics.topic_totals(_clean_lines(spark, folder))


@query
def p9_analytics_table(spark, folder):
    rows = topics.analytics_rows(topics.topic_totals(_clean(spark, folder)))
    return rows.withColumn("percentage", F.round("percentage", 6))


@query
def x5_topic_difficulty(spark, folder):
    rows = topics.topic_levels(_clean(spark, folder))
    return rows.withColumn("avg_score", F.round("avg_score", 6))


@query
def x5_topic_difficulty_lines(spark, folder):
    rows = topics.topic_levels(_clean_lines(spark, folder))
    return rows.withColumn("avg_score", F.round("avg_score", 6))


@query
def x7_completion(spark, folder):
    rows = topics.completion(_clean(spark, folder), _catalogue(spark, folder))
    return rows.withColumn("percentage", F.round("percentage", 6))


# Days, streaks, weekdays


@query
def a2_daily(spark, folder):
    return daily.dated_days(_days(spark, folder))


@query
def e3_daily_progress(spark, folder):
    return daily.progress(_days(spark, folder))


@query
def e3_daily_progress_lines(spark, folder):
    return daily.progress(_days_lines(spark, folder))


@query
def w4a_streaks(spark, folder):
    return streaks.streaks(_days(spark, folder), samples.AS_OF)


@query
def w4a_streaks_lines(spark, folder):
    return streaks.streaks(_days_lines(spark, folder), LINES_AS_OF)


@query
def w4b_streaks(spark, folder):
    return streaks.streaks(_days(spark, folder), samples.AS_OF, "day")


@query
def x1_running_streak(spark, folder):
    rows = daily.dated_days(streaks.running_streaks(_days(spark, folder)))
    return rows.select("user_id", "date", "streak")


@query
def a4_weekdays(spark, folder):
    return patterns.weekdays(_days(spark, folder)).select("user_id", "day_name", "n")


@query
def a5_best_weekday(spark, folder):
    return patterns.best_weekday(_days(spark, folder))


@query
def x8_weekly(spark, folder):
    return daily.weeks(_days(spark, folder))


@query
def x8_monthly(spark, folder):
    return daily.months(_days(spark, folder))


@query
def x8_monthly_lines(spark, folder):
    return daily.months(_days_lines(spark, folder))


# Difficulty


@query
def a3_monthly_difficulty_lines(spark, folder):
    return difficulty.monthly_levels(_clean_lines(spark, folder))


@query
def a3_monthly_difficulty(spark, folder):
    return difficulty.monthly_levels(_clean(spark, folder))


@query
def a6_difficulty_ratio(spark, folder):
    rows = difficulty.level_shares(_clean(spark, folder))
    return rows.select("user_id", _six("easy"), _six("medium"), _six("hard"))


@query
def w5_halves(spark, folder):
    return difficulty.halves(_clean(spark, folder))


@query
def a7_complexity_trend(spark, folder):
    rows = difficulty.complexity_trend(_clean(spark, folder))
    return rows.select("user_id", _six("first_avg"), _six("second_avg"), "trend")


@query
def a7_complexity_trend_lines(spark, folder):
    rows = difficulty.complexity_trend(_clean_lines(spark, folder))
    return rows.select("user_id", _six("first_avg"), _six("second_avg"), "trend")


@query
def o4_difficulty_trend(spark, folder):
    return patterns.difficulty_history(_clean(spark, folder))


# Summary and further counts


@query
def a8_summary(spark, folder):
    return analytics.summary(_days(spark, folder), samples.AS_OF)


@query
def a8_summary_lines(spark, folder):
    return analytics.summary(_days_lines(spark, folder), LINES_AS_OF)


@query
def x2_attempts(spark, folder):
    return patterns.attempts(samples.submissions(spark, folder))


@query
def x3_changes(spark, folder):
    """The solved set as of the split date against the one of the later submissions, undated ones too."""
    landed = samples.submissions(spark, folder)
    happened = F.date_from_unix_date(F.floor(-F.col("seq") / F.lit(86_400_000_000)).cast("int"))
    catalogue = _catalogue(spark, folder)
    old = solved(landed.filter(happened < F.lit(SPLIT_DATE)), catalogue)
    new = solved(landed.filter(happened >= F.lit(samples.AS_OF - dt.timedelta(days=25))), catalogue)
    return changes.change_counts(old, new, ["difficulty", "date_solved", "language"])


@query
def x1_progress_streaks(spark, folder):
    """The Progress table of a run that counts streaks."""
    run = jobs.Run(_store(spark, "streaks"), RUN_TS, streak_rule="row")
    jobs.full_refresh(run, samples.submissions(spark, folder), samples.items(spark, folder))
    return run.store.read("progress").drop("last_updated")


@query
def x2_solved_attempts(spark, folder):
    rows = solved(samples.submissions(spark, folder), _catalogue(spark, folder), count_attempts=True)
    return rows.select("user_id", "title_slug", "date_solved", "attempts")


@query
def e6_metrics(spark, folder):
    """One row per user out of the progress metrics."""
    found = analytics.metrics(_clean(spark, folder), samples.AS_OF)
    history = found.difficulty_history.groupBy("user_id").agg(F.count("*").alias("n_history"))
    months = found.monthly_levels.groupBy("user_id").agg(F.count("*").alias("n_months"))
    trend = found.complexity_trend.select("user_id", "trend")
    return (
        found.summary.join(found.best_weekday.withColumnRenamed("day_name", "best_day"), "user_id", "left")
        .join(found.level_shares.select("user_id", _six("hard")), "user_id", "left")
        .join(history, "user_id", "left")
        .join(months, "user_id", "left")
        .join(trend, "user_id", "left")
    )


@query
def e7_analytics_bundle(spark, folder):
    """One row per user out of the bundle, with the standard test mapping."""
    found = analytics.analytics(_clean(spark, folder), samples.AS_OF, samples.MAPPING)
    by_topic = found.topics.groupBy("user_id").agg(F.count("*").alias("n_topics"), F.sum("total").alias("topic_rows"))
    by_day = found.progress.groupBy("user_id").agg(F.count("*").alias("n_days"), F.max("total_solved").alias("last_total"))
    return found.summary.join(by_topic, "user_id", "left").join(by_day, "user_id", "left")


@query
def s11_created_empty(spark, folder):
    """Rows of each table when they are created, and after the first incremental run on them."""
    run = jobs.Run(_store(spark, "created"), RUN_TS)
    created = run.store.ensure(RUN_TS)
    counts = lambda shot, name: shot.read(name).agg(F.count("*").alias("n"))
    names = ("problems", "analytics", "progress")
    before = [counts(created, name).select(F.lit(name).alias("name"), F.col("n").alias("created")) for name in names]
    jobs.incremental_refresh(run, samples.submissions(spark, folder), samples.items(spark, folder))
    after = [counts(run.store.snapshot(), name).select(F.lit(name).alias("name"), F.col("n").alias("filled")) for name in names]
    return before[0].union(before[1]).union(before[2]).join(after[0].union(after[1]).union(after[2]), "name")


@query
def a11_backup_manifest(spark, folder):
    """What the manifest of a backup says."""
    run = _full(spark, folder, "manifest")
    path = shared_folder(spark, "manifest-rows")
    jobs.backup(run, path)
    manifest = spark.read.schema(backups.MANIFEST).json(f"{path}/manifest")
    return manifest.select("problems_count", "sync_stats.total_problems", "sync_stats.new_problems")


@query
def x4_hours(spark, folder):
    rows = select.accepted(samples.submissions(spark, folder))
    return patterns.hours(select.first_per_item(rows))


@query
def x6_paid_share(spark, folder):
    return patterns.paid_share(_clean(spark, folder))


# Result tables and jobs


def _store(spark, purpose):
    return Store(spark, shared_folder(spark, purpose), STORE_BUCKETS)


def _problem_columns(rows: DataFrame) -> DataFrame:
    return rows.drop("last_updated")


def _record_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "user_id", "title", "difficulty", F.size("topics").cast("bigint").alias("n_topics"),
        "date_solved", "attempts", "status", "problem_id",
    )


def _full(spark, folder, purpose, mapping=None) -> jobs.Run:
    run = jobs.Run(_store(spark, purpose), RUN_TS, mapping)
    jobs.full_refresh(run, samples.submissions(spark, folder), samples.items(spark, folder))
    return run


def _before_split(spark, folder, purpose) -> jobs.Run:
    """Tables that hold the items solved before the split date."""
    run = jobs.Run(_store(spark, purpose), RUN_TS)
    landed = samples.submissions(spark, folder)
    early = landed.filter(dates.epoch_date(F.col("timestamp")) < F.lit(SPLIT_DATE))
    jobs.full_refresh(run, early, samples.items(spark, folder))
    return run


@query
def p7_retained(spark, folder):
    rows = select.retained(_clean(spark, folder), samples.AS_OF, KEPT_DAYS)
    return rows.select("user_id", "title_slug", "date_solved")


@query
def p8_problems_table(spark, folder):
    return _problem_columns(problem_rows(_clean(spark, folder), RUN_TS))


@query
def s5_problems_headed(spark, folder):
    """The Problems table the way people see it: headings, dates as text, no NULLs."""
    return with_headings(problem_rows(_clean(spark, folder), RUN_TS), "problems")


@query
def s4_problems_roundtrip(spark, folder):
    return _record_columns(problem_records(problem_rows(_clean(spark, folder), RUN_TS)))


@query
def j5_new_items(spark, folder):
    fetched = _clean(spark, folder)
    existing = fetched.filter(F.col("date_solved") < F.lit(SPLIT_DATE))
    return select.new_items(fetched, existing).select("user_id", "title", "date_solved")


@query
def u1_appended(spark, folder):
    """Stored records, with fewer columns, and the new rows under one schema."""
    fetched = _clean(spark, folder)
    early = fetched.filter(F.col("date_solved") < F.lit(SPLIT_DATE))
    existing = problem_records(problem_rows(early, RUN_TS))
    rows = select.append_rows(existing, select.new_items(fetched, existing))
    return rows.select("user_id", "title", "title_slug", "language", "date_solved")


@query
def e8_full_refresh(spark, folder):
    return _problem_columns(_full(spark, folder, "full").store.read("problems"))


@query
def s6_analytics_written(spark, folder):
    rows = _full(spark, folder, "analytics", samples.MAPPING).store.read("analytics")
    return rows.withColumn("percentage", F.round("percentage", 6))


@query
def s7_progress_written(spark, folder):
    return _full(spark, folder, "progress").store.read("progress").drop("last_updated")


@query
def e9_incremental(spark, folder):
    run = _before_split(spark, folder, "incremental")
    jobs.incremental_refresh(run, samples.submissions(spark, folder), samples.items(spark, folder))
    return run.store.records().select("user_id", "title", "date_solved")


@query
def e9_incremental_analytics(spark, folder):
    """The Analytics table after the stored totals took up the new items."""
    run = _before_split(spark, folder, "incremental")
    jobs.incremental_refresh(run, samples.submissions(spark, folder), samples.items(spark, folder))
    return run.store.read("analytics").drop("percentage")


@query
def e9_incremental_progress(spark, folder):
    run = _before_split(spark, folder, "incremental")
    jobs.incremental_refresh(run, samples.submissions(spark, folder), samples.items(spark, folder))
    return run.store.read("progress").drop("last_updated")


@query
def e10_cleanup(spark, folder):
    run = _full(spark, folder, "cleanup")
    jobs.cleanup(run, samples.AS_OF, KEPT_DAYS)
    return run.store.records().select("user_id", "title", "date_solved")


@query
def e11_e12_backup_restore(spark, folder):
    run = _full(spark, folder, "backup")
    path = shared_folder(spark, "backup-rows")
    jobs.backup(run, path)
    again = jobs.Run(_store(spark, "restore"), RUN_TS)
    jobs.restore(again, path)
    return again.store.records().select("user_id", "title", "date_solved", "problem_id")


@query
def a10_run_stats(spark, folder):
    run = _before_split(spark, folder, "stats")
    jobs.incremental_refresh(run, samples.submissions(spark, folder), samples.items(spark, folder))
    return jobs.run_stats(run.store)


@query
def a10_errors(spark, folder):
    """The counters of a full run over pages and items some of which can't be read."""
    run = jobs.Run(_store(spark, "errors"), RUN_TS)
    pages = submission_source.opened(samples.damaged(samples.pages(spark, folder), "user_id", "offset"))
    items = item_source.opened(samples.damaged(samples.item_bodies(spark, folder, cells=True), "title_slug"))
    jobs.full_refresh(run, pages, items)
    kept = run.store.rejected().agg(F.count("*").alias("rejected"))
    return jobs.run_stats(run.store).crossJoin(kept)


def _upserted(spark, folder, purpose) -> jobs.Run:
    """Tables that hold the items solved before the split date, then one run with changed items."""
    run = _before_split(spark, folder, purpose)
    jobs.incremental_refresh(run, samples.submissions(spark, folder), samples.changed_items(spark, folder))
    return run


@query
def e9_upserted(spark, folder):
    """The Problems table after a run that brought new items and changed metadata."""
    return _problem_columns(_upserted(spark, folder, "upsert").store.read("problems"))


@query
def e9_upserted_analytics(spark, folder):
    return _upserted(spark, folder, "upsert").store.read("analytics").drop("percentage")


@query
def e9_upserted_stats(spark, folder):
    return jobs.run_stats(_upserted(spark, folder, "upsert").store)


@query
def e8_changed_stats(spark, folder):
    """The counters of a full run over tables of the early items, with changed metadata."""
    run = _before_split(spark, folder, "changed")
    jobs.full_refresh(run, samples.submissions(spark, folder), samples.changed_items(spark, folder))
    return jobs.run_stats(run.store)


@query
def e10_cleanup_analytics(spark, folder):
    """The Analytics table of what a cleanup leaves."""
    run = _full(spark, folder, "cleanup")
    jobs.cleanup(run, samples.AS_OF, KEPT_DAYS)
    return run.store.read("analytics").drop("percentage")


@query
def t1_stream_ingest(spark, folder):
    """Three landings of ten days each, a scheduled run of the stream after each."""
    run = jobs.Run(_store(spark, "stream"), RUN_TS)
    landing, checkpoint, metadata = (shared_folder(spark, name) for name in ("landing", "stream-state", "landed-items"))
    landed, items = samples.submissions(spark, folder), samples.items(spark, folder)
    items.write.parquet(metadata)
    known = spark.read.schema(items.schema).parquet(metadata)
    day = F.floor(-F.col("seq") / F.lit(86_400_000_000))
    start = (samples.AS_OF - dt.timedelta(days=30) - dt.date(1970, 1, 1)).days
    part = F.least(F.greatest(F.floor((day - start) / 10), F.lit(0)), F.lit(2))
    for number in range(3):
        landed.filter(part == number).write.mode("append").parquet(landing)
        ingest(run, landed_rows(spark, landing), known, checkpoint)
    return run.store.records().select("user_id", "title", "date_solved")
