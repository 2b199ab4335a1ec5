"""The registered queries: each operator over its whole table, and the SQL that some are checked with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from solvetrail.llm import automaton, bpe, codes, decontaminate, exact, language, mixing, pii, quotes, runs, secrets, simhash, substrings

Query = Callable[[SparkSession, str], DataFrame]

BPE_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
WORD_FILE = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark, folder):
    """Language of every document, learnt from the labelled rows that are not held out."""
    return language.predictions(table(spark, folder, "documents"))


def op2_decontamination(spark, folder):
    """What of every document occurs in the benchmark."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_mixing(spark, folder):
    """How many words of every document the mix takes."""
    return mixing.mix(table(spark, folder, "documents"))


def op3_exact_dedup(spark, folder):
    """Groups of equal texts and which row of each stays."""
    return exact.exact_groups(table(spark, folder, "documents"))


def op5_secrets(spark, folder):
    """Secrets in every document."""
    return secrets.secret_spans(table(spark, folder, "documents"))


def op6_personal_data(spark, folder):
    """Personal data in every document."""
    return pii.personal_spans(table(spark, folder, "documents"))


def op8_quotation_linking(spark, folder):
    """Every message without quotes, tied to the message it answers."""
    return quotes.linked_messages(table(spark, folder, "conversations"))


def op9_substring_dedup(spark, folder):
    """What stays of every document when passages that occur elsewhere go."""
    return substrings.deduplicated_digests(table(spark, folder, "documents"))


def op7_simhash_near_dedup(spark, folder):
    """Fingerprint and group of every document."""
    return simhash.near_groups(table(spark, folder, "documents"))


def op10_token_counts(spark, folder):
    """Bytes and tokens of every document."""
    return bpe.token_counts(table(spark, folder, "documents"), public_tokenizers.path(BPE_FILE), TOKEN_LIMIT)


def op11_periodic_runs(spark, folder):
    """Periodic stretches of words in every document, some of which get such a stretch first."""
    return runs.run_digests(table(spark, folder, "documents"))


def op12_vector_codes(spark, folder):
    """Every vector as a code of four entries, with what the code loses."""
    return codes.compressed(table(spark, folder, "embeddings"))


def op13_bpe_automaton(spark, folder):
    """Ids of every document in the word vocabulary, and what they decode to."""
    return automaton.token_digests(table(spark, folder, "documents"), public_tokenizers.path(WORD_FILE))


OP2_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
    FROM item_words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), starts AS (
    SELECT doc_id, w, i FROM words, unnest(range(1, len(w) + 1)) AS t(i)
), matches AS (
    SELECT s.doc_id, s.i, x.n, x.item
    FROM (SELECT DISTINCT n FROM windows) AS sizes, starts AS s, windows AS x
    WHERE x.n = sizes.n AND s.i + sizes.n - 1 <= len(s.w) AND x.phrase = array_to_string(s.w[s.i:s.i + sizes.n - 1], ' ')
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM matches, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256
    FROM matches GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE split AS (
    SELECT conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS l FROM conversations
), lines AS (
    SELECT conv_id, turn, i AS place, l[i] AS line,
        length(regexp_replace(regexp_extract(l[i], '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
        trim(regexp_replace(regexp_replace(l[i], '^((?:[ \t]*>)+)[ \t]?', ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS words
    FROM split, unnest(range(1, len(l) + 1)) AS t(i)
), bodies AS (
    SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (level = 0), ''),
        '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
    FROM lines GROUP BY conv_id, turn
), steps AS (
    SELECT *, CASE WHEN words <> '' AND lag(words) OVER w <> '' AND lag(level) OVER w = level THEN 0 ELSE 1 END AS new
    FROM lines WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place)
), runs AS (
    SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY place) AS run FROM steps
), quotes AS (
    SELECT conv_id, turn, level, min(place) AS place, string_agg(words, ' ' ORDER BY place) AS words,
        arg_min(words, place) AS first, count(*) AS size
    FROM runs WHERE level > 0 AND words <> '' GROUP BY conv_id, turn, level, run
), originals AS (
    SELECT DISTINCT conv_id, turn, trim(regexp_replace(part, '[\x20\x09-\x0D]+', ' ', 'g')) AS words
    FROM (SELECT conv_id, turn, unnest(list_concat([body], list_concat(regexp_split_to_array(body, '\n[ \t]*\n'),
        string_split(body, chr(10))))) AS part FROM bodies)
), whole AS (
    SELECT q.conv_id, q.turn, q.level, q.place, any_value(q.words) AS words, any_value(q.first) AS first, any_value(q.size) AS size,
        max(o.turn) AS source
    FROM quotes q LEFT JOIN originals o ON o.conv_id = q.conv_id AND o.words = q.words AND o.turn < q.turn AND o.words <> ''
    GROUP BY q.conv_id, q.turn, q.level, q.place
), said AS (
    SELECT conv_id, turn, list_filter(list_transform(string_split(body, chr(10)),
        lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS l
    FROM bodies
), stretches AS (
    SELECT DISTINCT s.conv_id, s.turn, w.first, w.size, array_to_string(l[i:i + w.size - 1], ' ') AS words
    FROM (SELECT DISTINCT conv_id, first, size FROM whole WHERE source IS NULL AND size > 1) w JOIN said s USING (conv_id),
        unnest(range(1, len(l) - w.size + 2)) AS t(i)
    WHERE l[i] = w.first
), found AS (
    SELECT q.conv_id, q.turn, q.level, q.place, coalesce(any_value(q.source), max(s.turn)) AS source
    FROM whole q LEFT JOIN stretches s ON q.source IS NULL AND s.conv_id = q.conv_id AND s.first = q.first AND s.size = q.size
        AND s.words = q.words AND s.turn < q.turn
    GROUP BY q.conv_id, q.turn, q.level, q.place
), ties AS (
    SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked,
        arg_min(source, level * 1000000 + place) FILTER (source IS NOT NULL) AS reply_to
    FROM found GROUP BY conv_id, turn
), walk AS (
    SELECT conv_id, turn, turn AS thread FROM conversations
    UNION ALL
    SELECT w.conv_id, w.turn, t.reply_to FROM walk w JOIN ties t ON t.conv_id = w.conv_id AND t.turn = w.thread
    WHERE t.reply_to IS NOT NULL
)
SELECT c.conv_id, c.turn, c.role, b.body AS content, coalesce(t.n_quotes, 0) AS n_quotes,
    coalesce(t.n_linked, 0) AS n_linked, t.reply_to, w.thread,
    '<|' || coalesce(c.role, 'user') || '|>' || chr(10) || b.body AS chat
FROM conversations c JOIN bodies b USING (conv_id, turn) LEFT JOIN ties t USING (conv_id, turn)
JOIN (SELECT conv_id, turn, min(thread) AS thread FROM walk GROUP BY ALL) w USING (conv_id, turn)
"""

OP9_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i)
), shared AS (
    SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS (
    SELECT doc_id, list(DISTINCT p) AS places FROM shared, unnest(range(i, i + 35)) AS t(p) GROUP BY doc_id
), kept AS (
    SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
        list_filter(range(1, len(w) + 1), lambda p: places IS NULL OR NOT list_contains(places, p)) AS stay, w
    FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(list_select(w, stay), ' ')) AS kept_sha256 FROM kept
"""

OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS size,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
), g AS (
    SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
        row_number() OVER w AS place
    FROM d WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


OP11_SQL = r"""
WITH RECURSIVE bits AS (
    SELECT i AS byte, i::UBIGINT AS c, 0 AS k FROM range(256) AS t(i)
    UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8
), hashed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h
    FROM documents, crc
), sized AS (
    SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS plant, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS times
    FROM hashed
), texts AS (
    SELECT row_number() OVER () AS id, doc_id, n, CASE WHEN plant THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i
        ELSE a + (i - a) % (1 + (n - a) // times) END]) ELSE w END AS w
    FROM sized
), windows AS (
    SELECT id, i, hash(array_to_string(w[i + 1:i + 6], ' ')) AS h FROM texts, unnest(range(n - 5)) AS t(i)
), pairs AS (
    SELECT x.id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.id = y.id AND x.h = y.h AND x.i < y.i
), islands AS (
    SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM pairs
), stretches AS (
    SELECT id, q, min(i) AS start, max(i) + 6 + q - min(i) AS length FROM islands GROUP BY id, q, island
), runs AS (
    SELECT id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY id, start, length
), gone AS (
    SELECT id, list(DISTINCT i) AS places FROM runs, unnest(range(start + period, start + length)) AS t(i) GROUP BY id
), found AS (
    SELECT id, count(*) AS n_runs, arg_min(struct_pack(s := start, n := length, p := period), (-length, start, period)) AS best,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.p AS period,
    1000 * best.n // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(array_to_string(list_select(w, list_filter(range(1, n + 1), lambda p: places IS NULL OR NOT list_contains(places, p - 1))), ' ')) AS collapsed_sha256
FROM texts LEFT JOIN found USING (id) LEFT JOIN gone USING (id)
"""

# One assignment and one update per round, four of each, and a last assignment.
_OP12_START = """
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS v FROM kept, unnest(range(4)) AS t(part)
), book0 AS MATERIALIZED (
    SELECT part, id - 1 AS entry, v FROM parts WHERE id <= 256
)"""
_OP12_ASSIGN = """, near{k} AS MATERIALIZED (
    SELECT id, part, min((list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry)) AS hit
    FROM parts p JOIN book{k} b USING (part) GROUP BY id, part
)"""
_OP12_UPDATE = """, sums{k} AS (
    SELECT part, hit[2] AS entry, place, sum(v[place + 1])::BIGINT AS s, count(*) AS c
    FROM near{k} JOIN parts USING (id, part), unnest(range(len(v))) AS t(place) GROUP BY ALL
), book{next} AS MATERIALIZED (
    SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN
        (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY place) AS v FROM sums{k} GROUP BY part, entry) m USING (part, entry)
)"""
_OP12_END = """, coded AS (
    SELECT id, string_agg(printf('%02x', hit[2]), '' ORDER BY part) AS code, sum(hit[1])::BIGINT AS error FROM near4 GROUP BY id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book4) AS codebooks_sha256
FROM kept JOIN coded USING (id)
"""
OP12_SQL = (
    _OP12_START
    + "".join(_OP12_ASSIGN.format(k=k) + _OP12_UPDATE.format(k=k, next=k + 1) for k in range(4))
    + _OP12_ASSIGN.format(k=4)
    + _OP12_END
)


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontamination": op2_decontamination,
        "op4_mixing": op4_mixing,
        "op3_exact_dedup": op3_exact_dedup,
        "op5_secrets": op5_secrets,
        "op6_personal_data": op6_personal_data,
        "op8_quotation_linking": op8_quotation_linking,
        "op9_substring_dedup": op9_substring_dedup,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op10_token_counts": op10_token_counts,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_vector_codes": op12_vector_codes,
        "op13_bpe_automaton": op13_bpe_automaton,
    }


def oracle_sql() -> dict[str, str]:
    """None for the others: SQL has no trained models, sampling, tokenizers or XXH64."""
    return {
        "op2_decontamination": OP2_SQL,
        "op3_exact_dedup": OP3_SQL,
        "op8_quotation_linking": OP8_SQL,
        "op9_substring_dedup": OP9_SQL,
        "op11_periodic_runs": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
    }
