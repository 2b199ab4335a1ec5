"""The pipeline's stages against plain versions of them, and odd rows through all of it."""

import pytest
from test_decontaminate import plain as contamination
from test_exact import plain as groups
from test_simhash import least_reachable, plain_print

import corpus_pipeline
from solvetrail.llm import language

OPERATORS = {1: "language", 3: "exact", 7: "simhash", 2: "decontaminate", 4: "mixing"}


def plain_stages(rows, items, recognised):
    """Ids that stages 1, 3, 7 and 2 keep. `rows`: (doc_id, text)."""
    rows = [r for r in rows if r[0] in recognised]
    stays = {r[0] for r in groups(rows) if r[3]}
    rows = [r for r in rows if r[0] in stays]
    ids = [r[0] for r in rows]
    stays = set(least_reachable(ids, [plain_print(t) for _, t in rows]))
    rows = [r for r in rows if r[0] in stays]
    return {r[0] for r in contamination(rows, items, 13) if not r[5]}


def test_stages():
    assert len(corpus_pipeline.STAGES) == len(OPERATORS)
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def mixed(spark, folder):
    return corpus_pipeline.run(spark, folder).collect()


def test_documents(spark, folder, mixed):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = docs.collect()
    stays = language.train(docs).recognised([r.text for r in rows])
    recognised = {r.doc_id for r, s in zip(rows, stays, strict=True) if s}
    assert len(recognised) > 0.98 * docs.count()
    rows = {r.doc_id: r for r in docs.collect()}
    clean = plain_stages([(i, r.text) for i, r in rows.items()], items, recognised)
    assert {r.doc_id for r in mixed} <= clean
    assert all(tuple(r)[: len(docs.columns)] == tuple(rows[r.doc_id]) for r in mixed)
    sizes, taken = {}, {}
    for i in clean:
        source = rows[i].source
        sizes[source] = sizes.get(source, 0) + len(rows[i].text.encode().split())
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + r.mix_size * r.mix_times
        assert r.mix_times in (1, 2) and r.mix_target <= 2 * sizes[r.source] + 1e-6
    largest = {s: max(r.mix_size for r in mixed if r.source == s) for s in taken}
    targets = {r.source: r.mix_target for r in mixed}
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in taken)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_odd_rows_and_empty_tables(spark, folder, tmp_path):
    english, german = "the house and the garden are green ", "das haus und der garten sind grau "
    rows = [(i, (english if i % 2 else german) * 3 + f"{i} w{i} x{i * 7}", "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(None, english + "nowhere", None, None), (100, None, "en", "s"), (101, "", "en", None), (102, "12", None, "s"), (1, rows[1][1], "en", "s")]
    rows += [(103, english * 20_000, "en", "s")]
    rows += [(104, "ξένο κείμενο " * 30, None, "s"), (105, "zqxw vvkj qqpt " * 30, None, "s")]
    names = ("mix_size", "Mix_Times", "mix_times_", "row", "docs", "found", "kept", "size", "copies")
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *("x" + n for n in names)) for r in rows], schema)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert found.columns == [*docs.columns, "mix_size_", "mix_target", "mix_times__"]
    ids = [r.doc_id for r in found.collect()]
    assert len(ids) == len(set(ids)) and not {100, 101, 102, 104, 105} & set(ids)
    assert {tuple(r)[4:-3] for r in found.collect()} == {tuple("x" + n for n in names)}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
