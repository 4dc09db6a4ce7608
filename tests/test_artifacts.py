import json

import pytest
from pyspark.sql import functions as F

from quern import config, plugins
from quern.operators import features as X
from quern.plans import catalog
from quern.sinks import artifacts as A
from quern.sources import release


def test_runs_are_published_whole_and_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "compiler", 64, "a"), (1, "fixed", 64, "b"), (2, "compiler", 64, "c")], "query_id long, system string, budget long, text string")
    path = f"{tmp_path}/run"
    A.publish(spark, path, {"contexts": items}, {"seed": 0}, A.markdown(items, "Items", ["query_id", "system"]))
    assert json.loads(A.read_text(spark, f"{path}/manifest.json")) == {"seed": 0}
    assert "| 1 | fixed | 64 | b |" in A.read_text(spark, f"{path}/report.md")
    schema = "query_id long, system string, budget long, text string"
    assert A.packets(spark, path, schema, "compiler", [64], 2).count() == 2
    with pytest.raises(ValueError):
        A.packets(spark, path, schema, "compiler", [64], 3)
    with pytest.raises(FileExistsError):
        A.publish(spark, path, {"contexts": items}, {})


def test_index_is_read_again_only_for_the_same_chunks(spark, tmp_path):
    made = []

    def embed(c):
        made.append(1)
        return plugins.get("embedder", "hash-64")(c, "chunk_id", "text")

    c = spark.createDataFrame([("a", "one two"), ("b", "three")], "chunk_id string, text string")
    for chunks, n in ((c, 1), (c.orderBy(F.desc("chunk_id")), 1), (c.limit(1), 2)):
        assert A.index(spark, f"{tmp_path}/index", chunks, {"model": "hash-64"}, embed).count() > 0 and len(made) == n
    assert A.digest(c) != A.digest(c.withColumn("text", F.upper("text"))) and A.digest(c) != A.digest(c.unionByName(c))


def test_bundles_know_when_a_part_was_changed(spark):
    nodes = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a"), ("e", 0, "c")], "document_id string, ordinal long, text string")
    features = spark.createDataFrame([("d", 0, "outline", "a", 0.45)], "document_id string, ordinal long, kind string, text string, importance double")
    html = spark.createDataFrame([("d", "<p>a</p>")], "document_id string, html string")
    b = A.bundles(nodes, features, html)
    assert json.loads(b.where("document_id = 'd'").first().content)["nodes"] == [{"ordinal": 0, "text": "a"}, {"ordinal": 1, "text": "b"}]
    assert A.tampered(b).count() == 0 and [r[0] for r in A.tampered(b.withColumn("html", F.lit("x"))).orderBy("document_id").collect()] == ["d", "e"]


def test_cell_log(spark, tmp_path):
    cells = spark.range(5).withColumnRenamed("id", "cell")
    log = A.CellLog(spark, f"{tmp_path}/log", {"model": "stub"})
    log.append(cells.where("cell < 2"))
    log.append(cells.where("cell < 3"))
    again = A.CellLog(spark, f"{tmp_path}/log", {"model": "stub"})
    assert sorted(r.cell for r in again.left(cells).collect()) == [3, 4] and again.done().count() == 3
    with pytest.raises(ValueError):
        A.CellLog(spark, f"{tmp_path}/log", {"model": "other"})


def test_release(spark, tmp_path):
    ev = {"document_id": "d1", "url": "u1", "evidence_pages": [2], "evidence_items": [{"pages": [3], "quote": "q"}]}
    docs = [{"document_id": "d1", "url": "u1", "title": " ", "page_count": 4}, {"document_id": "d2", "url": "u2", "title": "T"}]
    asked = [
        {"question_id": "q1", "task_type": "single_doc", "question": "?", "document": ev, "answer": {"format": "Int", "value": 7}},
        {"question_id": "q2", "task_type": "cross_doc", "question": "?", "documents": [ev, {"document_id": "d2", "url": "elsewhere"}], "metadata": {"is_unanswerable": True}},
        {"question_id": "q3", "task_type": "single_doc", "question": "?", "document": {"document_id": "d9", "url": "u9"}},
    ]
    for name, rows in (("docs", docs), ("asked", asked)):
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    d = release.documents(release.read(spark, f"{tmp_path}/docs.jsonl", release.DOCUMENTS))
    q = release.questions(release.read(spark, f"{tmp_path}/asked.jsonl", release.QUESTIONS))
    assert {r.document_id: r.title for r in d.collect()} == {"d1": None, "d2": "T"}
    rows = {r.question_id: r for r in q.collect()}
    assert rows["q1"].gold == "7" and rows["q1"].answerable and not rows["q2"].answerable and rows["q2"].document_ids == ["d1", "d2"] and len(rows["q2"].evidence) == 1
    assert sorted(tuple(r) for r in release.gold_pages(q).collect()) == [("q1", "d1", 2), ("q1", "d1", 3), ("q2", "d1", 2), ("q2", "d1", 3)]
    assert sorted(tuple(r) for r in release.problems(q, d).collect()) == [("other address", "q2"), ("unknown document", "q3")]
    assert [r.question_id for r in release.subset(q, ["q3", "q1"]).collect()] == ["q3", "q1"]
    with pytest.raises(ValueError):
        release.subset(q, ["q1", "nowhere"])
    digest = __import__("hashlib").sha256((tmp_path / "docs.jsonl").read_bytes()).hexdigest()
    assert release.changed_files(spark, str(tmp_path), {"docs.jsonl": digest, "asked.jsonl": "0", "gone.jsonl": digest}) == ["asked.jsonl", "gone.jsonl"]
    (tmp_path / "bad.jsonl").write_text('{"document_id": "x"\n')
    with pytest.raises(Exception):  # noqa: B017 Spark's own error
        release.read(spark, f"{tmp_path}/bad.jsonl", release.DOCUMENTS).collect()


def test_settings_hold_together():
    assert set(config.ablations()) == {"SHIPPED", "D1", "D2", "D3", "D4"} and not config.ablations()["D4"].headings
    for make in (lambda: config.RetrievalConfig(overlap_tokens=512), lambda: config.MergeConfig(small=200), lambda: config.CompilerConfig(strategy="x"), lambda: config.BenchmarkConfig(baseline=config.RetrievalConfig(hits=7))):
        with pytest.raises(ValueError):
            make()


def test_parts_by_name(spark):
    p = spark.createDataFrame([("q", "<evidence id=\"E1\">\nsix words are in this item\n</evidence>"), ("q", "")], "prompt string, evidence string")
    got = [json.loads(r.response) for r in plugins.get("provider", "stub-v1")(p).collect()]
    assert got == [{"answer": "six words are in this", "citations": ["E1"]}, {"answer": "INSUFFICIENT_EVIDENCE", "citations": []}]
    for call in (lambda: plugins.get("reranker", "none"), lambda: plugins.register("counter", "words-v1", len)):
        with pytest.raises(ValueError):
            call()


def test_feature_choice_against_a_slow_model(spark, sf):
    found = catalog.features(spark, sf)
    asked = catalog.sections(spark, sf).orderBy("query_id").limit(6)
    matched = F.array_sort(F.array_intersect(X.feature_terms(F.col("query")), X.feature_terms(F.col("text"))))
    c = asked.join(found, "document_id").select("query_id", "feature_id", matched.alias("matched"), F.col("importance").alias("weight"), F.expr("size(split(trim(text), '\\\\s+'))").alias("token_count"), "page").cache()
    got = {}
    for r in X.select(c, 6, 60).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.feature_id)
    want = {}
    for q in {r.query_id for r in c.collect()}:
        rows, left, covered, out = [r for r in c.collect() if r.query_id == q and r.token_count <= 60], 60, set(), []
        while rows and len(out) < 6:
            rows.sort(key=lambda r: (-len(set(r.matched) - covered), -len(r.matched), -r.weight, r.token_count, r.page, r.feature_id))
            r = rows.pop(0)
            if r.token_count <= left and (r.matched or not out):
                out.append(r.feature_id)
                left -= r.token_count
                covered |= set(r.matched)
        want[q] = out
    assert got == want
