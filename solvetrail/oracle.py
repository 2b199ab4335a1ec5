"""The registered queries once more, as SQL over the base tables.

Written from the definitions, not from the Spark plans: rows instead of day counts,
row numbers instead of aggregates, columns instead of the JSON texts.
"""

from __future__ import annotations

from solvetrail.sources import samples
from solvetrail.sources.mapping import STANDARD, Mapping

# Building blocks -------------------------------------------------------------

_SUBS = """
subs AS (
  SELECT user_id, -epoch_us(ts) AS seq,
         'Item ' || json_extract_string(props, '$.k') AS title,
         'item-' || json_extract_string(props, '$.k') AS title_slug,
         CASE WHEN value >= 0.5 THEN ts END AS solved_at,
         event_type <> 'error' AS ok, event_type AS language,
         floor(value) AS runtime, value AS memory
  FROM events)"""

_LINE_SUBS = """
subs AS (
  SELECT l_suppkey AS user_id,
         l_orderkey * 8 + l_linenumber
           - date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 140737488355328 AS seq,
         'item-' || l_partkey AS title_slug, l_shipdate AS solved_at,
         l_returnflag <> 'R' AS ok, l_linestatus AS language,
         floor(l_quantity) AS runtime, l_discount AS memory
  FROM lineitem)"""

_ITEMS = """
items AS (
  SELECT 'item-' || p_partkey AS title_slug, CAST(p_partkey AS VARCHAR) AS problem_id,
         p_name || ' ' || p_partkey AS title,
         CASE WHEN p_size <= 16 AND p_name LIKE 'old %' THEN ' easy ' WHEN p_size <= 16 THEN 'Easy'
              WHEN p_size <= 33 THEN 'Medium' WHEN p_size <= 47 THEN 'Hard' ELSE 'Extreme' END AS difficulty,
         list_append(string_split(p_name, ' '),
                     upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))) AS topics,
         p_brand AS company, p_size, p_type = 'PROMO' AS is_paid_only, p_type AS category
  FROM part)"""

_FIRST = """
firsts AS (
  SELECT * FROM subs WHERE ok
  QUALIFY row_number() OVER (PARTITION BY user_id, title_slug ORDER BY seq) = 1)"""

_LIMITED = """
limited AS (
  SELECT * FROM subs
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq, title_slug) <= {limit}),
firsts AS (
  SELECT * FROM limited WHERE ok
  QUALIFY row_number() OVER (PARTITION BY user_id, title_slug ORDER BY seq) = 1)"""

_SOLVED = """
solved AS (
  SELECT f.user_id, f.seq, f.title_slug, f.language, f.runtime, f.memory, f.solved_at,
         CAST(f.solved_at AS DATE) AS date_solved,
         i.problem_id, i.title, i.difficulty, i.topics, i.company, i.is_paid_only, i.category,
         i.p_size + 0.5::DOUBLE AS acceptance_rate
  FROM firsts f JOIN items i ON f.title_slug = i.title_slug)"""

_CLEAN = """
clean AS (
  SELECT * REPLACE (CASE trim(difficulty) WHEN 'Easy' THEN 'Easy' WHEN 'easy' THEN 'Easy'
                    WHEN 'Medium' THEN 'Medium' WHEN 'Hard' THEN 'Hard' ELSE 'Unknown' END AS difficulty)
  FROM solved)"""

_DAYS = """
days AS (
  SELECT user_id, date_solved AS date, count(*) AS c FROM clean
  WHERE date_solved IS NOT NULL GROUP BY ALL)"""

_TOPIC_ROWS = """
topic_rows AS (SELECT user_id, title_slug, difficulty, date_solved, unnest(topics) AS topic FROM clean)"""



def _mapping(entries: Mapping, names: str = "SELECT DISTINCT unnest(topics) AS topic FROM items") -> str:
    """The mapping as a table, and the categories of the topics in `names` under it."""
    listed = ", ".join(f"({i}, '{name}', '{category}')" for i, (name, category) in enumerate(entries))
    return f"""
mapping(ord, name, category) AS (VALUES {listed}),
names AS ({names}),
hits AS (
  SELECT topic, arg_min(category, ord) AS category FROM names, mapping
  WHERE contains(lower(topic), lower(name)) OR contains(lower(name), lower(topic)) GROUP BY topic),
topic_map AS (
  SELECT n.topic, coalesce(m.category, h.category, n.topic) AS category,
         CASE WHEN m.category IS NOT NULL THEN 'exact' WHEN h.category IS NOT NULL THEN 'partial'
              ELSE 'none' END AS match_kind
  FROM names n LEFT JOIN mapping m ON m.name = n.topic LEFT JOIN hits h ON h.topic = n.topic)"""


_STANDARD_NAMES = f"""
SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN one WHEN 1 THEN 'basic ' || upper(one) WHEN 2 THEN substr(one, 2, 4)
       WHEN 3 THEN one || ' and ' || lower(other) ELSE p_name END AS topic
FROM (SELECT p_partkey, p_name, names[p_partkey % len(names) + 1] AS one, names[(p_partkey + 7) % len(names) + 1] AS other
      FROM part, (SELECT [{", ".join(f"'{name}'" for name, _ in STANDARD)}] AS names))"""

_MAPPING = _mapping(samples.MAPPING)

_MAPPED_ROWS = """
topic_rows AS (
  SELECT DISTINCT r.user_id, r.title_slug, r.difficulty, r.date_solved, m.category AS topic
  FROM (SELECT user_id, title_slug, difficulty, date_solved, unnest(topics) AS topic FROM clean) r
  JOIN topic_map m ON m.topic = r.topic)"""

# Row by row: a run breaks wherever the previous row is not exactly one day earlier.
_ROW_RUNS = """
steps AS (
  SELECT user_id, date_solved AS d,
         row_number() OVER (PARTITION BY user_id ORDER BY date_solved, seq, title_slug) AS rn,
         lag(date_solved) OVER (PARTITION BY user_id ORDER BY date_solved, seq, title_slug) AS prev
  FROM clean WHERE date_solved IS NOT NULL),
breaks AS (
  SELECT *, CASE WHEN date_diff('day', prev, d) = 1 THEN 0 ELSE 1 END AS brk FROM steps),
groups AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY rn) AS g FROM breaks),
runs AS (SELECT *, count(*) OVER (PARTITION BY user_id, g ORDER BY rn) AS len FROM groups)"""

_HALVES = """
numbered AS (
  SELECT user_id, title_slug, date_solved,
         CASE difficulty WHEN 'Easy' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Hard' THEN 3 ELSE 0 END AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY date_solved, seq, title_slug) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM clean WHERE date_solved IS NOT NULL),
halved AS (SELECT *, CASE WHEN rn <= n // 2 THEN 1 ELSE 2 END AS half FROM numbered)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _with_crc(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def _base(first: str = _FIRST, subs: str = _SUBS) -> tuple[str, ...]:
    return (subs, _ITEMS, first, _SOLVED, _CLEAN)


_EVENTS = _base()
_LINES = _base(subs=_LINE_SUBS)

# Statements that are used for more than one input ----------------------------


def _solved_sql(source: str, *parts: str) -> str:
    return f"""{_with(*parts)}
SELECT user_id, title_slug, problem_id, title, difficulty, date_solved, language, runtime, memory,
       is_paid_only, category, acceptance_rate, CAST(1 AS BIGINT) AS attempts, 'Solved' AS status,
       array_to_string(topics, ', ') AS topics_text, company AS companies_text
FROM {source}"""


_TOTALS = """
SELECT user_id, topic, count(*) AS total, count(*) AS solved,
       count(*) FILTER (difficulty = 'Easy') AS easy, count(*) FILTER (difficulty = 'Medium') AS medium,
       count(*) FILTER (difficulty = 'Hard') AS hard, max(date_solved) AS last_solved
FROM topic_rows GROUP BY user_id, topic"""

_PROGRESS = """
SELECT a.user_id, a.date, a.c AS daily_count,
       (SELECT CAST(sum(b.c) AS BIGINT) FROM days b WHERE b.user_id = a.user_id
          AND date_trunc('week', b.date) = date_trunc('week', a.date)) AS weekly_count,
       (SELECT CAST(sum(b.c) AS BIGINT) FROM days b WHERE b.user_id = a.user_id
          AND date_trunc('month', b.date) = date_trunc('month', a.date)) AS monthly_count,
       CAST(sum(a.c) OVER (PARTITION BY a.user_id ORDER BY a.date) AS BIGINT) AS total_solved,
       CAST(0 AS BIGINT) AS streak
FROM days a"""


def _streak_sql(as_of: str) -> str:
    return f"""
streak AS (
  SELECT user_id,
         CASE WHEN max(d) >= DATE '{as_of}' - INTERVAL 1 DAY THEN arg_max(len, rn) ELSE 0 END AS current_streak,
         max(len) AS longest_streak
  FROM runs GROUP BY user_id)"""


_STREAKS = """
SELECT u.user_id, coalesce(s.current_streak, 0) AS current_streak,
       coalesce(s.longest_streak, 0) AS longest_streak
FROM (SELECT DISTINCT user_id FROM clean) u LEFT JOIN streak s ON s.user_id = u.user_id"""

_SUMMARY = """
SELECT c.user_id, count(*) AS total_problems, count(date_solved) AS total_solved,
       coalesce(any_value(s.current_streak), 0) AS current_streak,
       coalesce(any_value(s.longest_streak), 0) AS longest_streak
FROM clean c LEFT JOIN streak s ON s.user_id = c.user_id GROUP BY c.user_id"""

_TREND = """
SELECT user_id, round(first_avg, 6) AS first_avg, round(second_avg, 6) AS second_avg,
       CASE WHEN first_avg IS NULL THEN 'Insufficient data'
            WHEN second_avg > first_avg + 0.2 THEN 'Improving - solving harder problems'
            WHEN second_avg < first_avg - 0.2 THEN 'Focusing on easier problems'
            ELSE 'Consistent difficulty level' END AS trend
FROM (SELECT user_id,
             CASE WHEN count(*) >= 10 THEN avg(score) FILTER (half = 1) END AS first_avg,
             CASE WHEN count(*) >= 10 THEN avg(score) FILTER (half = 2) END AS second_avg
      FROM halved GROUP BY user_id)"""

_PROBLEMS = """
SELECT user_id, title AS name, difficulty, array_to_string(topics, ', ') AS topics_text, date_solved,
       CAST(1 AS BIGINT) AS attempts, 'Solved' AS status, problem_id
FROM clean"""

# Of a day's two halves the last one with events is what the calendar says.
_CALENDAR = """
calendar AS (
  SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events
  GROUP BY user_id, date, hour(ts) >= 12
  QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY hour(min(ts)) >= 12 DESC) = 1)"""

_LEVEL = """
orders_by_level AS (
  SELECT o_custkey AS user_id,
         CASE o_orderpriority WHEN '5-LOW' THEN 'easy' WHEN '3-MEDIUM' THEN 'medium'
              WHEN '1-URGENT' THEN 'hard' WHEN '2-HIGH' THEN 'hard' ELSE 'all' END AS level,
         o_orderstatus = 'F' AS ok, o_orderdate
  FROM orders)"""

_STORED_THEN_NEW = """
early AS (
  SELECT * FROM subs WHERE ok AND solved_at < TIMESTAMP '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY user_id, title_slug ORDER BY seq) = 1),
stored AS (SELECT e.user_id, e.seq, e.title_slug, CAST(e.solved_at AS DATE) AS date_solved,
                  i.title, i.difficulty, i.topics
           FROM early e JOIN items i ON i.title_slug = e.title_slug),
merged AS (
  SELECT user_id, seq, title_slug, date_solved, title, difficulty, topics FROM stored
  UNION ALL
  SELECT c.user_id, c.seq, c.title_slug, c.date_solved, c.title, c.difficulty, c.topics FROM solved c
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = c.user_id AND s.title = c.title)),
clean AS (
  SELECT * REPLACE (CASE trim(difficulty) WHEN 'Easy' THEN 'Easy' WHEN 'easy' THEN 'Easy'
                    WHEN 'Medium' THEN 'Medium' WHEN 'Hard' THEN 'Hard' ELSE 'Unknown' END AS difficulty)
  FROM merged)"""

_MERGED = (_SUBS, _ITEMS, _FIRST, _SOLVED, _STORED_THEN_NEW)


# CRC-32 of a text, for the fixtures that break bodies by it. The text has no more than ASCII.
_CRC = """
bits AS (
  SELECT i AS byte, i::UBIGINT AS c, 0 AS k FROM range(256) AS t(i)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS steps FROM bits WHERE k = 8)"""


def _drawn(key: str) -> str:
    """The CRC-32 of a text, where `crc` is joined."""
    return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT,
         list_transform(string_split({key}, ''), lambda x: ord(x)::UBIGINT)),
         lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"""


def _keyed(name: str, source: str, key: str) -> str:
    """A table of the keys in `source`, with the number that says whether the key's body is broken."""
    return f"""
{name} AS (SELECT k.*, {_drawn(key)} AS d FROM ({source}) k, crc)"""


def _faults(name: str, source: str, key: str, start: str) -> str:
    """The side table's rows for the broken bodies, whose whole texts begin with `start`."""
    return f"""
SELECT '{source}' AS source, {key} AS key, CASE WHEN d % 30 = 20 THEN 'missing' ELSE 'unreadable' END AS reason,
       CASE d % 30 WHEN 0 THEN '{start}' WHEN 10 THEN '<html>busy</html>' END AS body
FROM {name} WHERE d % 10 = 0"""


_PAGES = """
paged AS (
  SELECT *, date_diff('day', CAST(make_timestamp(-seq) AS DATE), DATE '2024-01-31') * 1000000 AS page FROM subs),
listed AS (
  SELECT *, page + row_number() OVER (PARTITION BY user_id, page ORDER BY paged.seq, title, title_slug,
         CAST(CAST(floor(epoch(solved_at)) AS BIGINT) AS VARCHAR) NULLS FIRST, CASE WHEN ok THEN 'A' ELSE 'W' END,
         language, CAST(CAST(runtime AS BIGINT) AS VARCHAR), CAST(memory AS VARCHAR)) - 1 AS place FROM paged)"""
_PAGE_KEYS = _keyed("page_keys", "SELECT DISTINCT user_id, page FROM paged", "user_id || '/' || page")
_ITEM_KEYS = _keyed("item_keys", "SELECT title_slug, problem_id FROM items", "title_slug")
_READABLE = (_CRC, _SUBS, _PAGES, _PAGE_KEYS)
_BAD_CELLS = """
SELECT 'items' AS source, title_slug AS key, 'stats' AS reason, 'none' AS body FROM item_keys
WHERE d % 10 <> 0 AND CAST(problem_id AS BIGINT) % 7 = 3"""
_CALENDAR_KEYS = _keyed("calendar_keys", "SELECT DISTINCT user_id FROM calendar", "CAST(user_id AS VARCHAR)")
_CHANGED_ITEMS = _ITEMS.replace("items AS (", "changed_items AS (").replace(
    "CASE WHEN p_size <= 16 AND", "CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size > 33 AND p_size <= 47 THEN 'Easy' ELSE 'Hard' END WHEN p_size <= 16 AND"
).replace("list_append(string_split(p_name, ' '),", "CASE WHEN p_partkey % 11 = 0 THEN string_split(p_name, ' ')[1:1] ELSE list_append(string_split(p_name, ' '),").replace(
    "lower(substr(p_type, 2))) AS topics", "lower(substr(p_type, 2))) END AS topics"
)
# Stored items under the changed metadata, then the new ones.
_UPSERTED = """
renewed AS (
  SELECT s.user_id, s.seq, s.title_slug, s.date_solved, i.problem_id, i.title, i.difficulty, i.topics
  FROM (SELECT user_id, seq, title_slug, date_solved FROM merged) s JOIN changed_items i ON i.title_slug = s.title_slug),
upserted AS (
  SELECT * REPLACE (CASE trim(difficulty) WHEN 'Easy' THEN 'Easy' WHEN 'easy' THEN 'Easy'
                    WHEN 'Medium' THEN 'Medium' WHEN 'Hard' THEN 'Hard' ELSE 'Unknown' END AS difficulty)
  FROM renewed)"""


def statements() -> dict[str, str]:
    ev, ln = _with(*_EVENTS), _with(*_LINES)
    shorts = _base(_LIMITED.format(limit=20))
    return {
        "s1_submissions": f"""{_with(_SUBS, _PAGES)}
SELECT user_id, place AS seq, title, title_slug, CAST(CAST(floor(epoch(solved_at)) AS BIGINT) AS VARCHAR) AS timestamp,
       CASE WHEN ok THEN 'Accepted' ELSE 'Wrong Answer' END AS status, language,
       CAST(CAST(runtime AS BIGINT) AS VARCHAR) || ' ms' AS runtime, CAST(memory AS VARCHAR) || ' MB' AS memory
FROM listed""",
        "s1_readable_pages": f"""{_with_crc(*_READABLE)}
SELECT user_id, place AS seq, title_slug FROM listed JOIN page_keys USING (user_id, page) WHERE d % 10 <> 0""",
        "s1_rejected_pages": _with_crc(*_READABLE) + _faults("page_keys", "submissions", "user_id || '/' || page", '{"recentSubm'),
        "s2_rejected_items": _with_crc(_CRC, _ITEMS, _ITEM_KEYS) + _faults("item_keys", "items", "title_slug", '{"question":')
        + " UNION ALL " + _BAD_CELLS,
        "s3_rejected_profiles": _with_crc(_CRC, _keyed("people", "SELECT c_custkey FROM customer", "CAST(c_custkey AS VARCHAR)"))
        + _faults("people", "profiles", "CAST(c_custkey AS VARCHAR)", '{"matchedUse'),
        "a12_rejected_calendars": _with_crc(_CRC, _CALENDAR, _CALENDAR_KEYS)
        + _faults("calendar_keys", "calendars", "CAST(user_id AS VARCHAR)", '{"matchedUse')
        + """ UNION ALL SELECT 'calendars', CAST(user_id AS VARCHAR), 'calendar',
       '{"matchedUser":{"userCalendar":{"submissionCalendar":"not a calendar"}}}' FROM calendar_keys WHERE d % 10 <> 0 AND user_id % 9 = 4""",
        "a12_readable_calendars": f"""{_with_crc(_CRC, _CALENDAR, _CALENDAR_KEYS)}
SELECT user_id, date, n FROM calendar JOIN calendar_keys USING (user_id) WHERE d % 10 <> 0 AND user_id % 9 <> 4""",
        "a10_errors": f"""{_with_crc(*_READABLE, _ITEMS, _ITEM_KEYS)},
lost AS (
  SELECT (SELECT count(*) FROM page_keys WHERE d % 10 = 0) + (SELECT count(*) FROM item_keys WHERE d % 10 = 0)
         + (SELECT count(*) FROM ({_BAD_CELLS})) AS n),
found AS (
  SELECT count(*) AS n FROM (SELECT DISTINCT user_id, title_slug FROM listed JOIN page_keys USING (user_id, page) WHERE d % 10 <> 0 AND ok)
  JOIN item_keys USING (title_slug) WHERE d % 10 <> 0)
SELECT found.n AS total_problems, found.n AS new_problems, 0::BIGINT AS updated_problems, lost.n AS errors, lost.n AS rejected
FROM found, lost""",
        "s2_details": f"""{_with(_ITEMS)}
SELECT title_slug, problem_id, title, difficulty, category, is_paid_only,
       array_to_string(topics, ', ') AS topics_text, company AS companies_text,
       p_size || '.5%' AS acceptance_rate, CAST(p_size * 10 AS VARCHAR) AS total_accepted,
       CAST(p_size * 25 AS VARCHAR) AS total_submissions
FROM items""",
        "s3_user_profiles": """
SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS real_name,
       coalesce(n_name, '') AS country,
       CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 2000) / 2 ELSE 0 END::DOUBLE AS star_rating, c_custkey AS ranking,
       CAST(floor(c_acctbal) AS BIGINT) AS reputation,
       CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 900 + 1500.5 ELSE 0 END::DOUBLE AS contest_rating,
       CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 2 ELSE 0 END AS contest_rank,
       CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 40 ELSE 0 END AS contests_attended,
       CAST(coalesce(c_nationkey % 4, 0) AS BIGINT) AS n_badges
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
        "a9_user_stats": f"""{_with(_LEVEL)},
f AS (
  SELECT c_custkey AS user_id,
         count(DISTINCT o_orderdate) FILTER (ok AND level = 'easy') AS easy_solved,
         count(DISTINCT o_orderdate) FILTER (ok AND level = 'medium') AS medium_solved,
         count(DISTINCT o_orderdate) FILTER (ok AND level = 'hard') AS hard_solved,
         count(*) FILTER (ok AND level <> 'all') AS total_submissions,
         count(*) FILTER (level = 'easy') AS easy_total,
         count(*) FILTER (level = 'medium') AS medium_total,
         count(*) FILTER (level = 'hard') AS hard_total
  FROM customer LEFT JOIN orders_by_level o ON o.user_id = c_custkey GROUP BY c_custkey)
SELECT *, easy_solved + medium_solved + hard_solved AS total_solved,
       round(CASE WHEN total_submissions > 0
             THEN (easy_solved + medium_solved + hard_solved) / total_submissions * 100 ELSE 0 END, 6) AS acceptance_rate
FROM f""",
        "a12_calendar_days": f"{_with(_CALENDAR)} SELECT user_id, date, n FROM calendar",
        "f2_numbers": f"{_with(_SUBS)} SELECT user_id, seq, runtime, memory FROM subs",
        "f3_f7_calendar_keys": f"""{_with(_SUBS)}
SELECT user_id, seq, CAST(solved_at AS DATE) AS date, CAST(date_trunc('week', solved_at) AS DATE) AS week_start,
       CAST(date_trunc('month', solved_at) AS DATE) AS month_start, strftime(solved_at, '%Y-%m') AS month_key,
       dayname(solved_at) AS day_name
FROM subs""",
        "f11_scores": """
SELECT 'item-' || p_partkey AS title_slug,
       CASE WHEN p_size <= 16 THEN 'Easy' WHEN p_size <= 33 THEN 'Medium' WHEN p_size <= 47 THEN 'Hard'
            ELSE 'Unknown' END AS difficulty,
       CAST(CASE WHEN p_size <= 16 THEN 1 WHEN p_size <= 33 THEN 2 WHEN p_size <= 47 THEN 3 ELSE 0 END AS BIGINT) AS score
FROM part""",
        "p1_accepted": f"{_with(_SUBS)} SELECT user_id, seq, title_slug FROM subs WHERE ok",
        "o3_limited": f"{_with(*shorts)} SELECT user_id, seq, title_slug FROM limited WHERE ok",
        "u3_first_per_item": f"{_with(_SUBS, _FIRST)} SELECT user_id, seq, title_slug FROM firsts",
        "j1_with_items": f"{ln} SELECT user_id, seq, title_slug, problem_id, category FROM solved",
        "j2_calendar": f"""{_with(_SUBS, _CALENDAR)}
SELECT s.user_id, s.seq, CAST(s.solved_at AS DATE) AS date_solved, coalesce(d.n, 0) AS daily_count
FROM subs s LEFT JOIN calendar d
  ON d.user_id = s.user_id AND d.date = CAST(s.solved_at AS DATE)
WHERE s.ok""",
        "j3_j4_topic_map": f"{_with(_ITEMS, _MAPPING)} SELECT topic, category, match_kind FROM topic_map",
        "s10_standard_mapping": f"""{_with(_mapping(STANDARD, _STANDARD_NAMES))}
SELECT topic, category, match_kind FROM topic_map""",
        "u2_item_categories": f"""{_with(_ITEMS, _MAPPING)}
SELECT DISTINCT i.title_slug, m.category
FROM (SELECT title_slug, unnest(topics) AS topic FROM items) i JOIN topic_map m ON m.topic = i.topic""",
        "e1_solved": _solved_sql("solved", *_EVENTS),
        "e1_solved_short": _solved_sql("solved", *shorts),
        "e1_solved_lines": _solved_sql("solved", *_LINES),
        "e2_validated": _solved_sql("clean", *_EVENTS),
        "e2_text_records": """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, event_id AS seq, CASE WHEN k % 7 = 1 THEN 'Item ' || k ELSE 'Item' END AS title,
       CASE WHEN k % 6 = 3 THEN DATE '2024-01-05' WHEN k % 6 > 3 THEN CAST(ts AS DATE) END AS date_solved,
       [12.5, 7, 0, 0, 100][k % 5 + 1]::DOUBLE AS acceptance_rate, [3, 4, 1, 1][k % 4 + 1]::BIGINT AS attempts,
       [true, false, false, false, true, false][k % 6 + 1] AS is_paid_only,
       ['Easy', 'Hard', 'Unknown', 'Unknown'][k % 4 + 1] AS difficulty
FROM e WHERE k % 7 <> 0""",
        "p13_with_slug": f"{_with(_SUBS)} SELECT user_id, seq, title_slug FROM subs WHERE title_slug NOT LIKE '%9'",
        "a1_topics": _with(*_EVENTS, _TOPIC_ROWS) + _TOTALS,
        "a1_topics_mapped": _with(*_EVENTS, _MAPPING, _MAPPED_ROWS) + _TOTALS,
        "a1_topics_lines": _with(*_LINES, _TOPIC_ROWS) + _TOTALS,
        "p9_analytics_table": f"{_with(*_EVENTS, _TOPIC_ROWS)} SELECT *, 1.0::DOUBLE AS percentage FROM ({_TOTALS})",
        "x5_topic_difficulty": f"""{_with(*_EVENTS, _TOPIC_ROWS)}
SELECT user_id, topic, CAST(date_trunc('month', date_solved) AS DATE) AS month,
       round(avg(CASE difficulty WHEN 'Easy' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Hard' THEN 3 ELSE 0 END), 6) AS avg_score
FROM topic_rows WHERE date_solved IS NOT NULL GROUP BY ALL""",
        "x5_topic_difficulty_lines": f"""{_with(*_LINES, _TOPIC_ROWS)}
SELECT user_id, topic, CAST(date_trunc('month', date_solved) AS DATE) AS month,
       round(avg(CASE difficulty WHEN 'Easy' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Hard' THEN 3 ELSE 0 END), 6) AS avg_score
FROM topic_rows WHERE date_solved IS NOT NULL GROUP BY ALL""",
        "x8_monthly_lines": f"""{ln} SELECT user_id, CAST(date_trunc('month', date_solved) AS DATE) AS period_start, count(*) AS n
FROM clean WHERE date_solved IS NOT NULL GROUP BY ALL""",
        "a3_monthly_difficulty_lines": f"""{ln}
SELECT user_id, strftime(date_solved, '%Y-%m') AS month, count(*) FILTER (difficulty = 'Easy') AS easy,
       count(*) FILTER (difficulty = 'Medium') AS medium, count(*) FILTER (difficulty = 'Hard') AS hard
FROM clean WHERE date_solved IS NOT NULL AND difficulty <> 'Unknown' GROUP BY ALL""",
        "x7_completion": f"""{_with(*_EVENTS, _TOPIC_ROWS)},
available AS (
  SELECT topic, count(DISTINCT title_slug) AS available
  FROM (SELECT title_slug, unnest(topics) AS topic FROM items) GROUP BY topic)
SELECT r.user_id, r.topic, any_value(a.available) AS available, count(DISTINCT r.title_slug) AS solved,
       round(count(DISTINCT r.title_slug) / any_value(a.available), 6) AS percentage
FROM topic_rows r LEFT JOIN available a ON a.topic = r.topic GROUP BY r.user_id, r.topic""",
        "a2_daily": f"{_with(*_EVENTS, _DAYS)} SELECT user_id, date, c AS daily_count FROM days",
        "e3_daily_progress": _with(*_EVENTS, _DAYS) + _PROGRESS,
        "e3_daily_progress_lines": _with(*_LINES, _DAYS) + _PROGRESS,
        "w4a_streaks": _with(*_EVENTS, _ROW_RUNS, _streak_sql("2024-01-31")) + _STREAKS,
        "w4a_streaks_lines": _with(*_LINES, _ROW_RUNS, _streak_sql("2001-11-05")) + _STREAKS,
        "w4b_streaks": f"""{_with(*_EVENTS, _DAYS)},
islands AS (
  SELECT user_id, date,
         date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS island FROM days),
lengths AS (SELECT user_id, island, max(date) AS last, count(*) AS len FROM islands GROUP BY ALL),
streak AS (
  SELECT user_id, CASE WHEN max(last) >= DATE '2024-01-30' THEN arg_max(len, last) ELSE 0 END AS current_streak,
         max(len) AS longest_streak
  FROM lengths GROUP BY user_id){_STREAKS}""",
        "x1_running_streak": f"""{_with(*_EVENTS, _ROW_RUNS)}
SELECT user_id, d AS date, arg_min(len, rn) AS streak FROM runs GROUP BY user_id, d""",
        "a4_weekdays": f"""{ev} SELECT user_id, dayname(date_solved) AS day_name, count(*) AS n
FROM clean WHERE date_solved IS NOT NULL GROUP BY ALL""",
        "a5_best_weekday": f"""{ev}, w AS (
  SELECT user_id, dayname(date_solved) AS day_name, count(*) AS n, min(date_solved) AS first
  FROM clean WHERE date_solved IS NOT NULL GROUP BY ALL)
SELECT user_id, day_name FROM w
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""",
        "x8_weekly": f"""{ev} SELECT user_id, CAST(date_trunc('week', date_solved) AS DATE) AS period_start, count(*) AS n
FROM clean WHERE date_solved IS NOT NULL GROUP BY ALL""",
        "x8_monthly": f"""{ev} SELECT user_id, CAST(date_trunc('month', date_solved) AS DATE) AS period_start, count(*) AS n
FROM clean WHERE date_solved IS NOT NULL GROUP BY ALL""",
        "a3_monthly_difficulty": f"""{ev}
SELECT user_id, strftime(date_solved, '%Y-%m') AS month, count(*) FILTER (difficulty = 'Easy') AS easy,
       count(*) FILTER (difficulty = 'Medium') AS medium, count(*) FILTER (difficulty = 'Hard') AS hard
FROM clean WHERE date_solved IS NOT NULL AND difficulty <> 'Unknown' GROUP BY ALL""",
        "a6_difficulty_ratio": f"""{ev}
SELECT user_id, round(count(*) FILTER (difficulty = 'Easy') / count(*), 6) AS easy,
       round(count(*) FILTER (difficulty = 'Medium') / count(*), 6) AS medium,
       round(count(*) FILTER (difficulty = 'Hard') / count(*), 6) AS hard
FROM clean WHERE date_solved IS NOT NULL GROUP BY user_id""",
        "w5_halves": f"""{_with(*_EVENTS, _HALVES)}
SELECT user_id, title_slug, date_solved, CAST(half AS BIGINT) AS half FROM halved""",
        "a7_complexity_trend": _with(*_EVENTS, _HALVES) + _TREND,
        "a7_complexity_trend_lines": _with(*_LINES, _HALVES) + _TREND,
        "o4_difficulty_trend": f"""{ev} SELECT user_id, seq, date_solved AS date, lower(difficulty) AS difficulty
FROM clean WHERE date_solved IS NOT NULL""",
        "a8_summary": _with(*_EVENTS, _ROW_RUNS, _streak_sql("2024-01-31")) + _SUMMARY,
        "a8_summary_lines": _with(*_LINES, _ROW_RUNS, _streak_sql("2001-11-05")) + _SUMMARY,
        "x2_attempts": f"{_with(_SUBS)} SELECT user_id, title_slug, count(*) AS attempts FROM subs GROUP BY ALL",
        "x3_changes": f"""{_with(_SUBS, _ITEMS)},
a AS (SELECT s.user_id, s.title_slug, CAST(solved_at AS DATE) AS d, language, difficulty
      FROM subs s JOIN items i ON i.title_slug = s.title_slug WHERE ok AND -seq < epoch_us(TIMESTAMP '2024-01-20')
      QUALIFY row_number() OVER (PARTITION BY s.user_id, s.title_slug ORDER BY s.seq) = 1),
b AS (SELECT s.user_id, s.title_slug, CAST(solved_at AS DATE) AS d, language, difficulty
      FROM subs s JOIN items i ON i.title_slug = s.title_slug WHERE ok AND -seq >= epoch_us(TIMESTAMP '2024-01-06')
      QUALIFY row_number() OVER (PARTITION BY s.user_id, s.title_slug ORDER BY s.seq) = 1)
SELECT CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'missing'
            WHEN a.d IS NOT DISTINCT FROM b.d AND a.language = b.language AND a.difficulty = b.difficulty THEN 'unchanged'
            ELSE 'updated' END AS change, count(*) AS n
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.title_slug = b.title_slug GROUP BY 1""",
        "x1_progress_streaks": f"""{_with(*_EVENTS, _DAYS, _ROW_RUNS)}
SELECT p.* REPLACE (s.streak AS streak) FROM ({_PROGRESS}) p
JOIN (SELECT user_id, d AS date, arg_min(len, rn) AS streak FROM runs GROUP BY user_id, d) s USING (user_id, date)""",
        "x2_solved_attempts": f"""{_with(*_EVENTS)}
SELECT s.user_id, s.title_slug, s.date_solved, a.attempts
FROM solved s JOIN (SELECT user_id, title_slug, count(*) AS attempts FROM subs GROUP BY ALL) a USING (user_id, title_slug)""",
        "e6_metrics": f"""{_with(*_EVENTS, _ROW_RUNS, _streak_sql("2024-01-31"), _HALVES)},
best AS (
  SELECT user_id, dayname(date_solved) AS best_day FROM clean WHERE date_solved IS NOT NULL GROUP BY user_id, best_day
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(date_solved)) = 1),
figures AS (
  SELECT user_id, round(count(*) FILTER (difficulty = 'Hard') / count(*), 6) AS hard, count(*) AS n_history,
         count(DISTINCT date_trunc('month', date_solved)) FILTER (difficulty <> 'Unknown') AS n_months
  FROM clean WHERE date_solved IS NOT NULL GROUP BY user_id)
SELECT s.*, b.best_day, f.hard, f.n_history, nullif(f.n_months, 0) AS n_months, t.trend
FROM ({_SUMMARY}) s LEFT JOIN best b USING (user_id) LEFT JOIN figures f USING (user_id)
LEFT JOIN (SELECT user_id, trend FROM ({_TREND})) t USING (user_id)""",
        "e7_analytics_bundle": f"""{_with(*_EVENTS, _ROW_RUNS, _streak_sql("2024-01-31"), _MAPPING, _MAPPED_ROWS)}
SELECT s.*, t.n_topics, t.topic_rows, d.n_days, d.last_total
FROM ({_SUMMARY}) s
LEFT JOIN (SELECT user_id, count(DISTINCT topic) AS n_topics, count(*) AS topic_rows FROM topic_rows GROUP BY user_id) t
  USING (user_id)
LEFT JOIN (SELECT user_id, count(DISTINCT date_solved) AS n_days, count(*) AS last_total
           FROM clean WHERE date_solved IS NOT NULL GROUP BY user_id) d USING (user_id)""",
        "s11_created_empty": f"""{_with(*_EVENTS, _TOPIC_ROWS, _DAYS)}
SELECT 'problems' AS name, 0::BIGINT AS created, count(*) AS filled FROM clean
UNION ALL SELECT 'analytics', 0, count(*) FROM (SELECT DISTINCT user_id, topic FROM topic_rows)
UNION ALL SELECT 'progress', 0, count(*) FROM days""",
        "a11_backup_manifest": f"""{ev}
SELECT count(*) AS problems_count, count(*) AS total_problems, count(*) AS new_problems FROM clean""",
        "x4_hours": f"""{_with(_SUBS, _FIRST)}
SELECT user_id, CAST(hour(solved_at) AS INTEGER) AS hour, count(*) AS n
FROM firsts WHERE solved_at IS NOT NULL GROUP BY ALL""",
        "x6_paid_share": f"{ev} SELECT user_id, is_paid_only, count(*) AS n FROM clean GROUP BY ALL",
        "p7_retained": f"{ev} SELECT user_id, title_slug, date_solved FROM clean WHERE date_solved >= DATE '2024-01-21'",
        "p8_problems_table": ev + _PROBLEMS,
        "s5_problems_headed": f"""{ev}
SELECT user_id, title AS "Problem Name", difficulty AS "Difficulty", array_to_string(topics, ', ') AS "Topics",
       coalesce(CAST(date_solved AS VARCHAR), '') AS "Date Solved", CAST(1 AS BIGINT) AS "Attempts",
       'Solved' AS "Status", problem_id AS "Problem ID", '2024-01-31 06:00:00' AS "Last Updated"
FROM clean""",
        "s4_problems_roundtrip": f"""{ev}
SELECT user_id, title, difficulty, CAST(len(topics) AS BIGINT) AS n_topics, date_solved,
       CAST(1 AS BIGINT) AS attempts, 'Solved' AS status, problem_id FROM clean""",
        "j5_new_items": f"""{ev} SELECT user_id, title, date_solved FROM clean
WHERE date_solved IS NULL OR date_solved >= DATE '2024-01-20'""",
        "u1_appended": f"""{ev}
SELECT user_id, title, CASE WHEN date_solved < DATE '2024-01-20' THEN NULL ELSE title_slug END AS title_slug,
       CASE WHEN date_solved < DATE '2024-01-20' THEN NULL ELSE language END AS language, date_solved FROM clean""",
        "e8_full_refresh": _with(*_EVENTS) + _PROBLEMS,
        "s6_analytics_written": f"""{_with(*_EVENTS, _MAPPING, _MAPPED_ROWS)}
SELECT *, 1.0::DOUBLE AS percentage FROM ({_TOTALS})""",
        "s7_progress_written": _with(*_EVENTS, _DAYS) + _PROGRESS,
        "e9_incremental": f"{_with(*_MERGED)} SELECT user_id, title, date_solved FROM clean",
        "e9_incremental_analytics": _with(*_MERGED, _TOPIC_ROWS) + _TOTALS,
        "e9_incremental_progress": _with(*_MERGED, _DAYS) + _PROGRESS,
        "e10_cleanup": f"""{_with(*_EVENTS)}
SELECT user_id, title, date_solved FROM clean WHERE date_solved >= DATE '2024-01-21'""",
        "e10_cleanup_analytics": f"""{_with(*_EVENTS)},
topic_rows AS (
  SELECT user_id, title_slug, difficulty, date_solved, unnest(topics) AS topic FROM clean WHERE date_solved >= DATE '2024-01-21')
{_TOTALS}""",
        "e9_upserted": _with(*_MERGED, _CHANGED_ITEMS, _UPSERTED) + _PROBLEMS.replace("FROM clean", "FROM upserted"),
        "e9_upserted_analytics": f"""{_with(*_MERGED, _CHANGED_ITEMS, _UPSERTED)},
topic_rows AS (SELECT user_id, title_slug, difficulty, date_solved, unnest(topics) AS topic FROM upserted){_TOTALS}""",
        "e9_upserted_stats": f"""{_with(*_MERGED, _CHANGED_ITEMS, _UPSERTED)}
SELECT (SELECT count(*) FROM merged) AS total_problems,
       (SELECT count(*) FROM merged) - (SELECT count(*) FROM stored) AS new_problems,
       (SELECT count(*) FROM stored JOIN clean USING (user_id, title_slug) JOIN upserted u USING (user_id, title_slug)
        WHERE clean.difficulty <> u.difficulty OR clean.topics <> u.topics) AS updated_problems,
       CAST(0 AS BIGINT) AS errors""",
        "e8_changed_stats": f"""{_with(*_MERGED, _CHANGED_ITEMS, _UPSERTED)},
before AS (
  SELECT s.user_id, s.title_slug, s.date_solved, c.difficulty, c.topics
  FROM stored s JOIN clean c USING (user_id, title_slug)),
now AS (SELECT s.user_id, s.title_slug, s.date_solved, u.difficulty, u.topics FROM solved s JOIN upserted u USING (user_id, title_slug))
SELECT count(*) AS total_problems, count(*) FILTER (b.user_id IS NULL) AS new_problems,
       count(*) FILTER (b.user_id IS NOT NULL AND (b.date_solved IS DISTINCT FROM n.date_solved
                        OR b.difficulty <> n.difficulty OR b.topics <> n.topics)) AS updated_problems,
       CAST(0 AS BIGINT) AS errors
FROM now n LEFT JOIN before b USING (user_id, title_slug)""",
        "e11_e12_backup_restore": f"{_with(*_EVENTS)} SELECT user_id, title, date_solved, problem_id FROM clean",
        "a10_run_stats": f"""{_with(*_MERGED)}
SELECT (SELECT count(*) FROM merged) AS total_problems,
       (SELECT count(*) FROM merged) - (SELECT count(*) FROM stored) AS new_problems,
       CAST(0 AS BIGINT) AS updated_problems, CAST(0 AS BIGINT) AS errors""",
        "t1_stream_ingest": f"""{_with(_SUBS, _ITEMS)},
landed AS (
  SELECT *, CASE WHEN -seq < epoch_us(TIMESTAMP '2024-01-11') THEN 1
                 WHEN -seq < epoch_us(TIMESTAMP '2024-01-21') THEN 2 ELSE 3 END AS landing
  FROM subs),
known AS (
  SELECT * FROM landed WHERE ok
  QUALIFY row_number() OVER (PARTITION BY user_id, title_slug ORDER BY landing, seq) = 1)
SELECT k.user_id, i.title, CAST(k.solved_at AS DATE) AS date_solved
FROM known k JOIN items i ON i.title_slug = k.title_slug""",
    }
