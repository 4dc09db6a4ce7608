import duckdb
import pytest
from fixtures import ODD, documents

from quern.llm import mixing as M


def filled(sizes, weights, epochs, total):
    """Clamping round by round."""
    open_, target = set(sizes), {}
    left = total
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > epochs * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, "d": 3, None: 70}, {"a": 5}, {"a": 0, "b": 7}, {"a": 0}, {"é": 9, "z": 9, "Z": 1}])
def test_targets(spark, sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = filled(sizes, weights, 3, sum(sizes.values()))
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_query_and_sql_on_odd_texts(spark, tmp_path):
    texts = ODD + [f"word{k} " * (k % 40) for k in range(300)]
    sources = [None if k % 11 == 0 else f"s{k % 7}" if k % 3 else "hot" for k in range(len(texts))]
    documents(spark, texts, sources).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(M.op6_mix_sources(spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert rows == sorted(c.execute(M.OP6_SQL).fetchall())
    by = {}
    for r, s in zip(rows, sources, strict=True):
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((s, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1


def test_repeated_rows_hold_the_taken_words(spark):
    texts = ODD + [f" w{k}\n" * (k % 20) for k in range(60)]
    docs = documents(spark, texts)
    taken = {r.doc_id: r.mix_taken for r in M.mix(docs).collect()}
    got = {}
    out = M.repeated(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        n = len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r.text))
        got[r.doc_id] = got.get(r.doc_id, 0) + n
        assert texts[r.doc_id].startswith(r.text)
    assert got == {k: v for k, v in taken.items() if v}


def test_repeated_ids_and_empty_tables(spark):
    docs = documents(spark, ["a b c", "a b c", "d e"]).withColumn("doc_id", __import__("pyspark").sql.functions.lit(1))
    rows = M.mix(docs).collect()
    assert sum(r.mix_taken for r in rows) == 8
    assert M.mix(docs.where("false")).count() == 0 and M.repeated(docs.where("false")).count() == 0
