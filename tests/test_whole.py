"""Queries against their SQL on tables that hold what the small ones lack: places in lists that are also digits, many facts, long numbers, deep graphs."""

import datetime

import duckdb
import pytest

from quern.operators import enrich as E
from quern.plans import registry
from quern.sources import graph, trees
from tests.test_oracles import TABLES, rows


@pytest.fixture
def same(spark, sf, tmp_path):
    """same(name, documents=..., part=...): whether a query gives its SQL's rows where some tables are replaced."""

    def check(name, **tables):
        for t in TABLES:
            if t in tables:
                tables[t].write.parquet(f"{tmp_path}/{t}.parquet")
            else:
                (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        with duckdb.connect() as c:
            for t in TABLES:
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t in tables else ''}'")
            cursor = c.execute(registry.oracle_sql()[name])
            want = rows([d[0] for d in cursor.description], cursor.fetchall())
        df = registry.queries()[name](spark, str(tmp_path))
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
        assert want

    return check


def documents(spark, *texts):
    return spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


DIGITS = "0 apples are here. 1 pear is 1. 2 plums are 2. 34 figs are 33. 44 nuts cost 4"


@pytest.mark.parametrize("name", ["sentences", "section_summary", "key_facts"])
def test_sentences_keep_digits_at_their_ends(same, spark, name):
    same(name, documents=documents(spark, DIGITS, " It is 5  \n a.  b is 1 . 1"))


def test_sentences_are_whole(spark):
    found = E.sentences(trees.document_nodes(documents(spark, DIGITS))).orderBy("sentence_no")
    assert " ".join(r.sentence for r in found.collect()) == DIGITS


@pytest.mark.parametrize("name", ["feature_counts", "jsonld"])
def test_facts_beyond_the_limit_of_inline_ones(same, spark, name):
    same(name, documents=documents(spark, "\n".join(f"Item {k} is {k}." for k in range(2100)), "One is 1. It costs 2 EUR"))


@pytest.mark.parametrize("name", ["table_keys", "keyed_table_join"])
def test_parts_of_more_than_five_digits(same, spark, name):
    day = datetime.datetime(2020, 1, 2)
    keys = [7, 12345, 123450, 123451, 1234567]
    lines = [(k, p, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", day) for k, p in enumerate(keys)]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    part = spark.createDataFrame([(p, "x", "b", "t", 1, 1.0) for p in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    same(name, lineitem=lineitem, part=part)


def test_reachable_nodes_of_large_and_deep_graphs(spark):
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    chain = [("deep", k, k - 1 if k else None) for k in range(12)]
    cycle = [("cycle", 0, None), ("cycle", 1, 2), ("cycle", 2, 1)]
    n = spark.createDataFrame(chain + cycle, "document_id string, ordinal long, parent long")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        got = {(r.document_id, r.ordinal) for r in graph.reachable(n).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert got == {("deep", k) for k in range(12)} | {("cycle", 0)}


@pytest.mark.parametrize("name", ["table_join_candidates", "compile_context"])
def test_customers_whose_keys_are_the_same_in_five_places(same, spark, name):
    rows = [(k, f"Customer {k}", k % 2, -5.5 if k % 3 else 7.5, ("BUILDING", "MACHINERY")[k % 4 // 2]) for k in range(300000, 300060)]
    same(name, customer=spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"))
