from pyspark.sql import functions as F

from quern.operators import enrich as E
from quern.operators import structure as S
from quern.sources import trees

LINES = [
    "Revenue rose to $1,200.50 million in March 2024. See Table 2 and appendix B.3! It must not exceed 5 percent, or 3 hours.",
    "The World Health Organization (WHO) was named. A widget is defined as a small part.",
    "12 apples weigh 3kg; 7 of them 40 EUR.",
]


def sentences(spark):
    docs = spark.createDataFrame([(1, "\n".join(LINES))], "doc_id long, text string")
    return E.sentences(trees.document_nodes(docs)), trees.document_nodes(docs)


def test_sentences_and_facts(spark):
    s, _ = sentences(spark)
    assert s.count() == 6
    facts = E.key_facts(s).orderBy("place").collect()
    assert [(r.defines, r.counts, r.binds) for r in facts] == [(False, True, False), (False, True, False), (False, True, True), (True, False, False), (False, True, False)]
    assert [r.importance for r in facts] == [0.78, 0.78, 0.9, 0.9, 0.78]
    assert E.key_facts(s, 2).count() == 2


def test_quantities(spark):
    s, _ = sentences(spark)
    got = sorted((r.value, r.unit, r.scale) for r in E.quantities(s).collect())
    assert got == [("1200.50", "USD", "million"), ("3", "hours", None), ("3", "kg", None), ("40", "EUR", None), ("5", "%", None)]


def test_references_aliases_dates(spark):
    _, n = sentences(spark)
    assert sorted((r.kind, r.reference) for r in E.references(n).collect()) == [("appendix", "Appendix B.3"), ("table", "Table 2")]
    assert [(r.name, r.alias) for r in E.aliases(n).collect()] == [("The World Health Organization", "WHO")]
    assert sorted(r.mention for r in E.dates(n).collect()) == ["2024", "March"]


def test_neighbours(spark):
    rows = [("d", k, kind, "body", head) for k, (kind, head) in enumerate([("paragraph", "a"), ("paragraph", "a"), ("list_item", "a"), ("list_item", "a"), ("paragraph", "a"), ("paragraph", "b")])]
    n = spark.createDataFrame(rows, "document_id string, ordinal long, kind string, content_layer string, h string").withColumn("heading_path", F.array("h"))
    assert sorted((r.anchor, r.neighbour) for r in S.neighbours(n, "paragraph", 1, S.SIBLING, True).collect()) == [(0, 1), (1, 0)]
    assert sorted((r.anchor, r.neighbour, r.penalty) for r in S.neighbours(n, "list_item", 2, S.LIST, False).collect()) == [(2, 3, 0.9), (3, 2, 0.9)]


def test_keys_and_kinds(spark):
    rows = [("d", "A", 0, ["Model no.", "Date", "Dataset Name", "x"], ["AB-12_x. and 77", "2024/01/02", " Big  Set ", "AB-99"]), ("d", "A", 1, ["SKU"], ["plain"])]
    got = sorted(r.key for r in E.row_keys(spark.createDataFrame(rows, "document_id string, label string, row_index int, headers array<string>, values array<string>")).collect())
    assert got == ["dataset:big set", "date:2024-01-02", "identifier:ab-12_x"]


def test_heading_scopes(spark):
    kinds = ["paragraph", "title", "paragraph", "heading", "list_item", "heading", "paragraph", "title", "paragraph"]
    rows = [("d", k, kind, "body", f"t{k}") for k, kind in enumerate(kinds)]
    n = spark.createDataFrame(rows, "document_id string, ordinal long, kind string, content_layer string, text string")
    got = {r.ordinal: r.heading_path for r in trees.heading_paths(n).collect()}
    assert got == {0: [], 1: ["t1"], 2: ["t1"], 3: ["t1", "t3"], 4: ["t1", "t3"], 5: ["t1", "t5"], 6: ["t1", "t5"], 7: ["t7"], 8: ["t7"]}
