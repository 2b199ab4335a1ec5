"""Submissions, items, calendars and user records built from the test tables.

Texts and JSON are written the way a landing zone holds them, so that the
operators have to parse them again. Every view covers its whole table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvetrail.sources.mapping import STANDARD

AS_OF = dt.date(2024, 1, 31)
# List positions between the pages of two days.
PAGE = 1_000_000

# The mapping for the words of the test items.
MAPPING = (
    ("small", "Size"),
    ("large", "Size"),
    ("red", "Colour"),
    ("blue", "Colour"),
    ("hot", "Temperature"),
    ("old", "Age"),
    ("new", "Age"),
    ("widget", "Part"),
    ("gear", "Part"),
    ("economy class", "Tier"),
    ("mediu", "Tier"),
    ("cold front", "Weather"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as submissions. Newest first: `seq` is the negated event time."""
    return from_events(table(spark, folder, "events"))


def from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    return events.select(
        "user_id",
        (-_micros("ts")).alias("seq"),
        F.concat(F.lit("Item "), k).alias("title"),
        F.concat(F.lit("item-"), k).alias("title_slug"),
        F.when(F.col("value") >= 0.5, seconds).alias("timestamp"),
        F.when(F.col("event_type") == "error", "Wrong Answer").otherwise("Accepted").alias("status"),
        F.col("event_type").alias("language"),
        F.concat(F.floor("value").cast("string"), F.lit(" ms")).alias("runtime"),
        F.concat(F.col("value").cast("string"), F.lit(" MB")).alias("memory"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as landed list pages, one per user and day, newest first within the day.

    Days count back from AS_OF, and a day's page starts at its number times PAGE.
    """
    rows = submissions(spark, folder)
    day = F.floor(-F.col("seq") / F.lit(86_400_000_000))
    row = F.struct(
        "seq", "title", F.col("title_slug").alias("titleSlug"), "timestamp",
        F.col("status").alias("statusDisplay"), F.col("language").alias("lang"), "runtime", "memory",
    )
    days = rows.groupBy("user_id", day.alias("day")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    listed = F.transform("rows", lambda r: r.dropFields("seq"))
    last = (AS_OF - dt.date(1970, 1, 1)).days
    return days.select(
        "user_id",
        ((F.lit(last) - F.col("day")) * PAGE).alias("offset"),
        F.to_json(F.struct(listed.alias("recentSubmissionList"))).alias("body"),
    )


def item_bodies(spark: SparkSession, folder: str, cells: bool = False) -> DataFrame:
    """Items as landed bodies; with `cells`, every seventh item's stats are no JSON."""
    rows = items(spark, folder)
    stats = F.when(F.col("problem_id").cast("bigint") % 7 == 3, "none").otherwise(F.col("stats")) if cells else F.col("stats")
    question = F.struct(
        F.col("problem_id").alias("questionId"),
        "title",
        F.col("title_slug").alias("titleSlug"),
        "difficulty",
        F.col("topic_tags").alias("topicTags"),
        F.col("company_tags").alias("companyTagStats"),
        stats.alias("stats"),
        F.col("is_paid_only").alias("isPaidOnly"),
        F.col("category").alias("categoryTitle"),
    )
    return rows.select("title_slug", F.to_json(F.struct(question.alias("question"))).alias("body"))


def calendar_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Calendars as landed bodies; every ninth user's calendar is no JSON."""
    cell = F.when(F.col("user_id") % 9 == 4, "not a calendar").otherwise(F.col("calendar"))
    body = F.struct(F.struct(F.struct(cell.alias("submissionCalendar")).alias("userCalendar")).alias("matchedUser"))
    return calendars(spark, folder).select("user_id", F.to_json(body).alias("body"))


def damaged(bodies: DataFrame, *key: str) -> DataFrame:
    """Bodies of which one in ten, by the CRC-32 of its key, is cut off, no JSON, or absent."""
    drawn = F.crc32(F.concat_ws("/", *key))
    body = (
        F.when(drawn % 10 != 0, F.col("body"))
        .when(drawn % 30 == 0, F.substring("body", 1, 12))
        .when(drawn % 30 == 10, "<html>busy</html>")
    )
    return bodies.withColumn("body", body)


def changed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of which every fifth has another level, and every eleventh has lost all topics but the first."""
    number = F.col("problem_id").cast("bigint")
    level = F.when(number % 5 == 0, F.when(F.col("difficulty") == "Hard", "Easy").otherwise("Hard")).otherwise(F.col("difficulty"))
    first = F.to_json(F.slice(F.from_json("topic_tags", "array<struct<name:string, slug:string>>"), 1, 1))
    topics = F.when(number % 11 == 0, first).otherwise(F.col("topic_tags"))
    return items(spark, folder).withColumns({"difficulty": level, "topic_tags": topics})


def submissions_from_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as submissions, the larger set: supplier as user, part as item.

    `seq` packs (ship date newest first, order, line) into one number.
    """
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint")
    order = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    part = F.col("l_partkey").cast("string")
    seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string")
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("user_id"),
        (order - F.shiftleft(day, 47)).alias("seq"),
        F.concat(F.lit("Item "), part).alias("title"),
        F.concat(F.lit("item-"), part).alias("title_slug"),
        seconds.alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", "Wrong Answer").otherwise("Accepted").alias("status"),
        F.col("l_linestatus").alias("language"),
        F.concat(F.floor("l_quantity").cast("string"), F.lit(" ms")).alias("runtime"),
        F.concat(F.col("l_discount").cast("string"), F.lit(" MB")).alias("memory"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as items. Old easy ones are written ' easy ', the largest carry an unknown level."""
    size = F.col("p_size")
    level = (
        F.when((size <= 16) & F.col("p_name").startswith("old "), " easy ")
        .when(size <= 16, "Easy")
        .when(size <= 33, "Medium")
        .when(size <= 47, "Hard")
        .otherwise("Extreme")
    )
    words = F.concat(F.split("p_name", " "), F.array(F.initcap(F.lower("p_type"))))
    topic_tags = F.transform(words, lambda w: F.struct(w.alias("name"), F.lower(w).alias("slug")))
    company = F.array(F.struct(F.col("p_brand").alias("tagName")))
    key = F.col("p_partkey").cast("string")
    figures = F.struct(
        F.concat(size.cast("string"), F.lit(".5%")).alias("acRate"),
        (size * 10).alias("totalAccepted"),
        (size * 25).alias("totalSubmission"),
    )
    return table(spark, folder, "part").select(
        key.alias("problem_id"),
        F.concat("p_name", F.lit(" "), key).alias("title"),
        F.concat(F.lit("item-"), key).alias("title_slug"),
        level.alias("difficulty"),
        F.to_json(topic_tags).alias("topic_tags"),
        F.when(F.col("p_type") == "LARGE", F.to_json(company))
        .otherwise(F.to_json(F.struct(company.alias("stats"))))
        .alias("company_tags"),
        F.to_json(figures).alias("stats"),
        (F.col("p_type") == "PROMO").alias("is_paid_only"),
        F.col("p_type").alias("category"),
    )


def text_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as problem records whose cells are all text, some of them blank or not what they should be."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    pick = lambda *cells: F.element_at(F.array(*map(F.lit, cells)), (k % len(cells) + 1).cast("int"))
    return table(spark, folder, "events").select(
        "user_id",
        F.col("event_id").alias("seq"),
        F.when(k % 7 == 0, " \t").when(k % 7 == 1, F.concat(F.lit(" Item "), k.cast("string"), F.lit(" "))).otherwise("Item").alias("title"),
        F.when(k % 6 == 0, "2024-02-30").when(k % 6 == 1, "soon").when(k % 6 == 2, "").when(k % 6 == 3, "2024-1-5")
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).alias("date_solved"),
        pick("12.5", " 7 ", "abc", "", "1e2").alias("acceptance_rate"),
        pick("3", " 4 ", "x", "1.5").alias("attempts"),
        pick("true", "abc", "false", "", "1", "no").alias("is_paid_only"),
        pick(" easy", "HARD", "Extreme", "").alias("difficulty"),
    )


def topic_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct names made of the standard mapping's and the parts' words, each kind from a fifth of the parts."""
    names = F.array(*(F.lit(name) for name, _ in STANDARD))
    key, n = F.col("p_partkey"), len(STANDARD)
    one, other = (F.element_at(names, ((key + shift) % n + 1).cast("int")) for shift in (0, 7))
    made = (
        F.when(key % 5 == 0, one)
        .when(key % 5 == 1, F.concat(F.lit("basic "), F.upper(one)))
        .when(key % 5 == 2, F.substring(one, 2, 4))
        .when(key % 5 == 3, F.concat(one, F.lit(" and "), F.lower(other)))
        .otherwise(F.col("p_name"))
    )
    return table(spark, folder, "part").select(made.alias("topic")).distinct()


def calendars(spark: SparkSession, folder: str) -> DataFrame:
    """Per user one JSON map, in order of time, from the second a half day starts to its events.

    Half days are counted first, so a user's list holds at most two entries per day.
    """
    second = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 43_200) * 43_200
    halves = table(spark, folder, "events").groupBy("user_id", second.alias("second")).count()
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("second", "count"))),
        lambda e: F.struct(e["second"].cast("string").alias("key"), e["count"].alias("value")),
    )
    return halves.groupBy("user_id").agg(F.to_json(F.map_from_entries(entries)).alias("calendar"))


def user_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer one JSON body: orders by priority as counts by level, finished ones accepted."""
    priority = F.col("o_orderpriority")
    level = (
        F.when(priority == "5-LOW", "Easy")
        .when(priority == "3-MEDIUM", "Medium")
        .when(priority.isin("1-URGENT", "2-HIGH"), "Hard")
        .otherwise("All")
    )
    accepted = F.col("o_orderstatus") == "F"
    counts = (
        table(spark, folder, "orders")
        .groupBy("o_custkey", level.alias("difficulty"), "o_orderdate")
        .agg(F.count_if(accepted).alias("accepted"), F.count("*").alias("orders"))
        .groupBy("o_custkey", "difficulty")
        .agg(
            F.count_if(F.col("accepted") > 0).alias("solved"),
            F.sum("accepted").alias("accepted"),
            F.sum("orders").alias("orders"),
        )
    )
    # At most four levels per customer.
    listed = counts.groupBy("o_custkey").agg(
        F.collect_list(
            F.struct("difficulty", F.col("solved").alias("count"), F.col("accepted").alias("submissions"))
        ).alias("acSubmissionNum"),
        F.collect_list(
            F.struct("difficulty", F.col("orders").alias("count"), F.col("orders").alias("submissions"))
        ).alias("totalSubmissionNum"),
    )
    people = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    badge = F.struct(F.col("c_mktsegment").alias("displayName"))
    badges = F.when(F.col("c_nationkey") % 4 > 0, F.array_repeat(badge, F.col("c_nationkey") % 4))
    body = F.struct(
        F.struct(
            F.col("c_name").alias("username"),
            F.struct(
                F.col("c_mktsegment").alias("realName"),
                F.col("n_name").alias("countryName"),
                F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 2000) / 2).alias("starRating"),
                F.col("c_custkey").alias("ranking"),
                F.floor("c_acctbal").alias("reputation"),
            ).alias("profile"),
            F.struct("acSubmissionNum", "totalSubmissionNum").alias("submitStats"),
            badges.alias("badges"),
        ).alias("matchedUser"),
        # Every third customer has no contest standing.
        F.when(
            F.col("c_custkey") % 3 > 0,
            F.struct(
                (F.col("c_custkey") % 40).alias("attendedContestsCount"),
                (F.col("c_custkey") % 900 + 1500.5).alias("rating"),
                (F.col("c_custkey") * 2).alias("globalRanking"),
            ),
        ).alias("userContestRanking"),
    )
    return people.join(listed, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("user_id"), F.to_json(body).alias("body")
    )
