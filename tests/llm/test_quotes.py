"""Quotation linking against a walk over each conversation."""

import random
import re

import pytest

from solvetrail.llm import quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, thread string"


def squeezed(text):
    return " ".join(re.split("[ \t\n\x0b\x0c\r]+", text.strip(" \t\n\x0b\x0c\r")))


def plain(rows):
    """(conv, turn, content, n_quotes, n_linked, reply_to, thread) with one row per turn."""
    said, reply, out = {}, {}, []
    for conv, turn, text in sorted(rows):
        own, passages, last = [], [], None
        for line in (text or "").split("\n"):
            marks = re.match(r"((?:[ \t]*>)+)[ \t]?", line)
            level = marks[0].count(">") if marks else 0
            words = squeezed(line[marks.end() :] if marks else line)
            if not level:
                own.append(line)
            elif words and last == level:
                passages[-1][1].append(words)
            elif words:
                passages.append([level, [words]])
            last = level if words else None
        body = "\n".join(own).strip(" \t\n\x0b\x0c\r")
        found = []
        for place, (level, words) in enumerate(passages):
            before, whole = said.get(conv, {}), " ".join(words)
            turns = [t for t, (parts, _) in before.items() if whole in parts]
            if not turns and len(words) > 1:
                same = lambda lines: any(lines[i] == words[0] and " ".join(lines[i : i + len(words)]) == whole for i in range(len(lines) - len(words) + 1))  # noqa: B023, E731
                turns = [t for t, (_, lines) in before.items() if same(lines)]
            if turns:
                found.append((level, place, max(turns)))
        reply[conv, turn] = min(found)[2] if found else None
        end = turn
        while reply[conv, end] is not None:
            end = reply[conv, end]
        out.append((conv, turn, body, len(passages), len(found), reply[conv, turn], end))
        parts = {squeezed(p) for p in [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]} - {""}
        lines = [x for x in map(squeezed, body.split("\n")) if x]
        said.setdefault(conv, {})[turn] = parts, lines
    return sorted(out)


@pytest.mark.parametrize("seed,turns", [(0, 1024), (1, 3)])
def test_random_threads(spark, seed, turns, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", turns)
    rng = random.Random(seed)
    rows = []
    for conv in range(6):
        lines = []
        for turn in range(rng.randrange(1, 25)):
            text = []
            for _ in range(rng.randrange(5)):
                if rows and rng.random() < 0.4:
                    earlier = rng.choice(rows)[2].split("\n")
                    start = rng.randrange(len(earlier))
                    text += ["> " + x.lstrip("> ") for x in earlier[start : start + rng.randrange(1, 4)] if x.strip()]
                elif lines and rng.random() < 0.6:
                    text += ["> " * rng.randrange(1, 4) + x for x in rng.sample(lines, min(len(lines), rng.randrange(1, 3)))]
                else:
                    text.append(rng.choice(["", "ok", f"line {rng.randrange(12)}", "two  words", f"  é {turn}"]))
            lines += [x.lstrip("> ") for x in text if x]
            rows.append((conv, turn, "\n".join(text)))
    frame = spark.createDataFrame([(c, t, "user", x, "clash") for c, t, x in rows], SCHEMA).repartition(3)
    found = quotes.linked_messages(frame)
    assert found.columns == ["conv_id", "turn", "role", "content", "n_quotes", "n_linked", "reply_to", "thread", "chat"]
    assert sorted((r.conv_id, r.turn, r.content, r.n_quotes, r.n_linked, r.reply_to, r.thread) for r in found.collect()) == plain(rows)


def test_nested_quotes_and_odd_rows(spark):
    rows = [
        (1, 0, "user", "How are you?\nFine weather.", ""), (1, 1, None, "> How are\n>  you?\nWell.", ""),
        (1, 2, "user", ">> How are you?\n> Well.\nGood.", ""), (1, 3, "user", None, ""), (1, 4, "a", "> never said", ""),
        (None, 0, "a", "> Well.", ""), (1, None, "a", "> Well.\nx", ""), (1, 4, "a", "> never said", ""), (2, 1, "a", "> Well.", ""),
        (3, 0, "u", "long " * 100_000, ""), (3, 1, "u", "> " + "long " * 100_000 + "\nyes", ""),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted(((r.conv_id, r.turn, r.content[:9], r.n_quotes, r.n_linked, r.reply_to, r.thread) for r in quotes.linked_messages(frame).collect()), key=str)
    assert found == sorted([
        (1, 0, "How are y", 0, 0, None, 0), (1, 1, "Well.", 1, 1, 0, 0), (1, 2, "Good.", 2, 2, 1, 0), (1, 3, "", 0, 0, None, 3),
        (1, 4, "", 1, 0, None, 4), (None, 0, "", 0, 0, None, 0), (1, None, "x", 0, 0, None, None), (1, 4, "", 1, 0, None, 4),
        (2, 1, "", 1, 0, None, 1), (3, 0, "long long", 0, 0, None, 0), (3, 1, "yes", 1, 1, 0, 0),
    ], key=str)
    assert quotes.linked_messages(frame.limit(0)).collect() == []


QUOTING = [
    (1, 0, "First line.\nSecond  line.\nThird line.\n\nNew paragraph.\nLast line."),
    (1, 1, "> First line.\n> Second line.\nTwo of three."),
    (1, 2, "> Second line.\n> Third line.\n> New paragraph.\nOver the break."),
    (1, 3, "> First line.\n> Third line.\nNot one after the other."),
    (1, 4, "First line.\nSecond line.\nthen more"),
    (1, 5, "> First line.\n> Second line.\nThe last turn that has them."),
    (1, 6, ">> First line.\n>> Second line.\n> Two of three.\nNested."),
    (1, 7, "> Last line.\n> Second line.\nBackwards."),
    (1, 8, "> Two of three.\n> Over the break.\nFrom two messages."),
    (2, 0, "> First line.\n> Second line.\nAnother conversation."),
]


def test_lines_out_of_a_paragraph(spark):
    """Trimmed quotes: the usual reply quotes some consecutive lines of a longer message."""
    frame = spark.createDataFrame([(c, t, "user", x, "") for c, t, x in QUOTING], SCHEMA)
    found = sorted((r.conv_id, r.turn, r.content, r.n_quotes, r.n_linked, r.reply_to, r.thread) for r in quotes.linked_messages(frame).collect())
    assert found == plain(QUOTING)
    assert [r[4:6] for r in found] == [(0, None), (1, 0), (1, 0), (0, None), (0, None), (1, 4), (2, 1), (0, None), (0, None), (0, None)]


def test_sql_on_messages_that_quote(spark):
    import duckdb
    from helpers import ordered

    from solvetrail.llm import registry

    rng, rows = random.Random(3), [*QUOTING]
    for conv in range(10, 30):
        for turn in range(12):
            own = [rng.choice(["ok", "", f"line {rng.randrange(9)}", "some  more"]) for _ in range(rng.randrange(1, 6))]
            lines = [x for c, _, t in rows if c == conv for x in t.split("\n")]
            start = rng.randrange(len(lines) + 1)
            rows.append((conv, turn, "\n".join([">" * rng.randrange(1, 3) + " " + x for x in lines[start : start + rng.randrange(4)]] + own)))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, 'user', ?)", rows)
    frame = quotes.linked_messages(spark.createDataFrame([(c, t, "user", x, "") for c, t, x in rows], SCHEMA))
    columns = frame.columns
    cursor = con.execute(registry.oracle_sql()["op8_quotation_linking"])
    names = [d[0] for d in cursor.description]
    expected = ordered(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    found = ordered(tuple(r) for r in frame.collect())
    assert found == expected
    assert sum(r[columns.index("n_linked")] for r in found) > 100
