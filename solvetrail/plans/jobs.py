"""Batch jobs on the result tables: full and incremental refresh, retention, backup, restore."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from solvetrail.operators import changes, topics
from solvetrail.plans.analytics import analytics
from solvetrail.plans.solved import solved, validated
from solvetrail.sources import backup as backups
from solvetrail.sources.bodies import Opened
from solvetrail.sources.items import catalogue
from solvetrail.sources.mapping import Mapping
from solvetrail.sources.tables import Counters, Snapshot, Store, problem_records, problem_rows, progress_rows

RETENTION_DAYS = 365

# A user's item in the Problems table, its title, what makes it another version of the item, and what a new
# version takes over from the stored row: when and how it was solved.
KEY, TITLE = ["user_id", "name", "problem_id"], ["user_id", "name"]
COMPARED, KEPT = ["difficulty", "topics_text"], ["date_solved", "attempts", "status", "month"]

# Landed rows, or what was read of landed bodies together with what could not be.
Landed = DataFrame | Opened


@dataclass(frozen=True)
class Outcome:
    """How a job ended: written, nothing_fetched, nothing_valid, nothing_new or nothing_old."""

    status: str
    counters: Counters = Counters()

    @property
    def ok(self) -> bool:
        return self.status not in ("nothing_fetched", "nothing_valid")


@dataclass(frozen=True)
class Run:
    """What a job needs besides its input; nothing in a job asks for the current time."""

    store: Store
    run_ts: dt.datetime
    mapping: Mapping | None = None
    # By which rule the Progress table's streaks are counted; None leaves them at 0.
    streak_rule: str | None = None
    # Whether the Problems table's attempts are counted; else they are 1.
    count_attempts: bool = False

    @property
    def settings(self) -> str | None:
        """What the Analytics and Progress tables depend on besides Problems; None if nothing is set."""
        if not self.mapping and not self.streak_rule:
            return None
        chosen = [[list(m) for m in self.mapping or ()], self.streak_rule]
        return hashlib.sha256(json.dumps(chosen).encode()).hexdigest()

    def results(self, records: DataFrame) -> dict[str, DataFrame]:
        """The Analytics and Progress tables of records as the Problems table holds them."""
        found = analytics(records, self.run_ts.date(), self.mapping, streak_rule=self.streak_rule)
        return {"analytics": topics.analytics_rows(found.topics), "progress": progress_rows(found.progress, self.run_ts)}


def full_refresh(run: Run, submissions: Landed, items: Landed, limit: int | None = None) -> Outcome:
    """Rebuild the three tables from the landed rows.

    Items count as new or updated against the tables before. If no cell of Problems would change, nothing is
    written.
    """
    errors = _reject(run, "full", submissions, items)
    fetched = solved(_rows(submissions), catalogue(_rows(items)), limit, run.count_attempts)
    with run.store.staging() as stage:
        seen = Observation()
        rows = stage(problem_rows(validated(fetched), run.run_ts).observe(seen, F.count(F.lit(1)).alias("n")))
        total = seen.get.get("n", 0)
        if not total:
            return Outcome("nothing_fetched" if fetched.isEmpty() else "nothing_valid", Counters(errors=errors))
        base, counters = run.store.latest(), Counters(total, total, 0, errors)
        if base and base.counters.total_problems:
            cells = [c for c in rows.columns if c not in (*KEY, "last_updated")]
            found = changes.differences(base.read("problems"), rows, KEY, cells).first()
            counters = Counters(total, found["new"], found["updated"], errors)
            if base.last["settings"] == run.settings and not (found["new"] or found["updated"] or found["missing"]):
                return Outcome("nothing_new", counters)
        return _rebuild(run, base, "full", rows, counters)


def incremental_refresh(
    run: Run,
    submissions: Landed,
    items: Landed,
    limit: int | None = None,
    source: str | None = None,
    batch: int | None = None,
) -> Outcome:
    """Add the items whose titles are not in the Problems table yet, and replace those whose metadata changed.

    A changed item keeps the date and attempts it was stored with. What is read and written are the partitions
    that the fetched users and the changed items fall into: users with new or changed items are counted anew, and
    everyone when the mapping or the streak rule changed. Partitions of Problems come last: a run that dies before
    is made good by repeating it. A batch of a stream (`source`) that is recorded already changes nothing.
    """
    base = run.store.ensure(run.run_ts, source)
    if None not in (batch, base.batch) and base.batch >= batch:
        return Outcome("nothing_new", base.counters)
    errors = _reject(run, "incremental", submissions, items)
    with run.store.staging() as stage:
        fetched = problem_rows(validated(solved(_rows(submissions), catalogue(_rows(items)), limit, run.count_attempts)), run.run_ts)
        fetched = stage(run.store.place("problems", fetched, base))
        buckets = _buckets(fetched)
        if not buckets:
            return Outcome("nothing_fetched", Counters(errors=errors))
        changed = stage(changes.upserts(fetched, base.placed("problems", buckets), KEY, TITLE, COMPARED, KEPT, stage))
        # One row per kind of change and partition.
        found = changed.groupBy("change", "bucket", "month").count().collect()
        if not found:
            return Outcome("nothing_new", replace(base.counters, new_problems=0, updated_problems=0, errors=errors))
        new, updated = (sum(r["count"] for r in found if r["change"] == kind) for kind in ("new", "updated"))
        cells = {(r["bucket"], r["month"]) for r in found}
        if base.last["settings"] != run.settings and base.counters.total_problems:
            rows = base.placed("problems").join(changed.select(*KEY), KEY, "left_anti").unionByName(changed.drop("change"))
            return _rebuild(run, base, "incremental", stage(rows), Counters(base.counters.total_problems + new, new, updated, errors))
        _count_anew(run, base, stage, changed, cells, updated)
        run.store.write(base.last["version"], "problems", _merged(base, changed, cells, updated))
        counters = Counters(base.placed("problems").count(), new, updated, errors)
        run.store.record(base, "incremental", run.run_ts, run.settings, counters, source=source, batch=batch)
        return Outcome("written", counters)


def cleanup(run: Run, as_of: dt.date, days: int = RETENTION_DAYS) -> Outcome:
    """Drop items older than `days` days, and undated ones.

    Partitions of whole months are deleted unread, the month of the limit is rewritten, and the results of
    users in the buckets that lost rows are counted anew.
    """
    store, base = run.store, run.store.snapshot()
    first_day = as_of - dt.timedelta(days=days)
    first = first_day.strftime("%Y-%m")
    old = F.col("date_solved") < F.lit(first_day)
    placed = base.placed("problems")
    # Counting by partition reads no column; of the limit's month one column is read.
    cells = {(r["bucket"], r["month"]): r["count"] for r in placed.groupBy("bucket", "month").count().collect()}
    gone = {cell for cell in cells if cell[1] is None or cell[1] < first}
    edge = placed.filter(F.col("month") == first).groupBy("bucket").agg(F.count_if(old).alias("n")).filter("n > 0")
    edges = {(r["bucket"], first): r["n"] for r in edge.collect()}
    left = sum(cells.values()) - sum(cells[cell] for cell in gone) - sum(edges.values())
    if not gone and not edges:
        return Outcome("nothing_old", Counters(left))
    same = base.last["settings"] == run.settings
    buckets = {cell[0] for cell in (gone | edges.keys() if same else cells.keys())}
    with store.staging() as stage:
        kept = base.placed("problems", buckets).filter((F.col("month") >= first) & ~old)
        records = problem_records(kept)
        for name, rows in run.results(records).items():
            store.overwrite(base, name, stage(store.place(name, rows, base)), {(b,) for b in buckets})
        if edges:
            rows = kept.filter((F.col("month") == first) & F.col("bucket").isin(*(cell[0] for cell in edges)))
            store.overwrite(base, "problems", stage(rows), set(edges))
        store.drop(base, "problems", gone)
    counters = Counters(left)
    store.record(base, "cleanup", run.run_ts, run.settings, counters)
    return Outcome("written", counters)


def backup(run: Run, path: str) -> int:
    """Write the Problems table's records to a backup folder; returns how many."""
    base = run.store.snapshot()
    return backups.write_backup(base.records(), path, base.counters, run.run_ts)


def restore(run: Run, path: str) -> Outcome:
    """Rebuild the three tables from a backup folder."""
    with run.store.staging() as stage:
        rows = stage(problem_rows(validated(backups.read_backup(run.store.spark, path)), run.run_ts))
        return _rebuild(run, run.store.latest(), "restore", rows, Counters(rows.count()))


def run_stats(store: Store) -> DataFrame:
    """The counters of the latest run, one row."""
    columns = ("total_problems", "new_problems", "updated_problems", "errors")
    newest = F.max_by(F.struct(*columns), "run_id").alias("stats")
    return store.runs().agg(newest).select("stats.*")


def _rows(landed: Landed) -> DataFrame:
    return landed.rows if isinstance(landed, Opened) else landed


def _reject(run: Run, job: str, *landed: Landed) -> int:
    """Write what could not be read to the side table; returns how much."""
    found = [one.rejected for one in landed if isinstance(one, Opened)]
    return run.store.reject(functools.reduce(DataFrame.unionByName, found), job, run.run_ts) if found else 0


def _buckets(rows: DataFrame) -> list[int]:
    """The buckets that rows fall into, at most as many as there are."""
    return [r["bucket"] for r in rows.select("bucket").distinct().collect()]


def _merged(base: Snapshot, changed: DataFrame, cells: set[tuple], updated: int) -> DataFrame:
    """All rows of the partitions of Problems that changed items fall into."""
    by_month = {}
    for bucket, month in cells:
        by_month.setdefault(month, []).append(bucket)
    month, bucket = F.col("month"), F.col("bucket")
    within = [(month.isNull() if m is None else month == m) & bucket.isin(*buckets) for m, buckets in by_month.items()]
    rows = base.placed("problems").filter(functools.reduce(lambda a, b: a | b, within))
    if updated:
        rows = rows.join(changed.filter("change = 'updated'").select(*KEY), KEY, "left_anti")
    return rows.unionByName(changed.drop("change"))


def _count_anew(run: Run, base: Snapshot, stage, changed: DataFrame, cells: set[tuple], updated: int) -> None:
    """Bring Analytics and Progress of the changed users up to date; other users' rows are copied.

    A changed user's items are counted anew out of Problems as it will be, not added to what is there: so a
    run that died after this gives the same when it is repeated. Problems is written later, so its rows may be
    read once per table; only the join that updated rows take is written first.
    """
    store, buckets = run.store, {bucket for bucket, _ in cells}
    users = changed.select("user_id").distinct()
    stored = base.placed("problems", buckets).join(users, "user_id", "left_semi")
    if updated:  # a new row's key is not stored
        stored = stored.join(changed.select(*KEY), KEY, "left_anti")
    records = problem_records(stored.unionByName(changed.drop("change")).drop("bucket", "month"))
    records = stage(records) if updated else records
    for name, rows in run.results(records).items():
        others = base.placed(name, buckets).join(users, "user_id", "left_anti")
        rows = others.unionByName(store.place(name, rows, base))
        if updated:  # a bucket may have lost its last topic
            store.overwrite(base, name, stage(rows), {(b,) for b in buckets})
        else:
            store.write(base.last["version"], name, rows)


def _rebuild(run: Run, base: Snapshot | None, job: str, rows: DataFrame, counters: Counters) -> Outcome:
    """A new version out of rows of the Problems table, which were written before."""
    rows = rows.drop("bucket", "month")
    frames = {"problems": rows} | run.results(problem_records(rows))
    run.store.replace(base, job, run.run_ts, run.settings, frames, counters)
    return Outcome("written", counters)
