
from quern.operators import chunks as C
from quern.operators import enrich as E
from quern.operators import retrieval as R


def test_grid_spans(spark):
    cells = [("t", 0, 2, 0, 1, "a"), ("t", 0, 1, 1, 3, "b"), ("t", 1, 2, 1, 2, "c"), ("t", 1, 2, 2, 3, "d")]
    df = spark.createDataFrame(cells, "table_id string, row_start long, row_end long, col_start int, col_end int, text string")
    assert sorted((r["row"], r["values"]) for r in E.grid(df).collect()) == [(0, ["a", "b", "b"]), (1, ["a", "c", "d"])]


def test_windows_reach_the_end_once(spark):
    for n, want in ((5, [5]), (10, [10]), (11, [10, 4]), (17, [10, 10]), (18, [10, 10, 4])):
        rows = [("d", 0, "paragraph", "body", " ".join(f"w{k}" for k in range(n)), 1, n, "x")]
        nodes = spark.createDataFrame(rows, "document_id string, ordinal long, kind string, content_layer string, text string, page long, token_count long, node_id string")
        assert [r.token_count for r in C.fixed_chunks(nodes, 10, 3).orderBy("ordinal").collect()] == want


def test_trim_counts_the_row_that_reaches(spark):
    df = spark.createDataFrame([(1, k + 1, 10) for k in range(8)], "query_id long, rank long, token_count long")
    assert R.trim(df, 1, 25).count() == 3 and R.trim(df, 5, 25).count() == 5 and R.trim(df, 1, 1000, 4).count() == 4


def test_no_match_is_no_rows(spark):
    chunks = spark.createDataFrame([("c", "alpha beta")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "zeta"), (2, "")], "query_id long, query string")
    assert R.bm25(chunks, queries, 5).count() == 0


def test_facets(spark):
    q = [(1, "What is the total revenue of Acme, and which office opened first in Paris while nothing else happened there?"), (2, "one clause only here"), (3, "a b c; A B C, a b c")]
    got = {(r.query_id, r.facet_no): r.facet for r in R.query_facets(spark.createDataFrame(q, "query_id long, query string")).collect()}
    assert got == {(1, 1): "is the total revenue of Acme", (1, 2): "office opened first in Paris", (1, 3): "nothing else happened there", (3, 1): "a b c"}


def test_search_text(spark):
    df = spark.createDataFrame([(["A", "B"], "text"), (["A", "Text"], "text"), ([], "text"), (["Text"], "TEXT")], "heading_path array<string>, text string")
    assert [r.search_text for r in C.search_text(df).collect()] == ["A\nB\ntext", "A\ntext", "text", "TEXT"]
