"""Tables by their labels: which table a label names, joins of labelled tables' rows for a question, fragments of large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import enrich as E
from quern.operators import features as X
from quern.operators import retrieval as R

# Fixed value: how tables are referred to.
REFERENCE = r"(?i)\bTable\s+[A-Z0-9]+(?:[.\-][A-Z0-9]+)+"
LIMIT, PRELIMIT = 16, 8
EMPTY = "[blank]"


def references(text: Column) -> Column:
    """Labels that a text names, in order, each spelling once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))


def compact(text: Column) -> Column:
    return F.regexp_replace(T.fold(text), "[^a-z0-9]", "")


def header_terms(header: Column) -> Column:
    return F.array_except(F.array_distinct(T.terms(header)), F.array(*map(F.lit, T.HEADER_STOPWORDS)))


def labels(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, ordinal, label): the labels of each table node.

    A table has those of its own caption, else those of the caption that came last before it and after the table before it, else those of
    the last table with the same headers. Windows in place of a scan: what is pending is found between tables, what goes on by headers.
    """
    n = nodes.join(tables.select("document_id", "ordinal", "caption", "headers"), ["document_id", "ordinal"], "left")
    before = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    lead = F.ltrim(T.fold(F.col("text")))
    captions = (F.col("kind") == "caption") | F.startswith(lead, F.lit("table ")) | F.startswith(lead, F.lit("[start table "))
    n = n.withColumn("since", F.count_if(F.col("headers").isNotNull()).over(before))
    so_far = W.partitionBy("document_id", "since").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    n = n.withColumn("pending", F.last(F.when(captions, references(F.col("text"))), ignorenulls=True).over(so_far)).where("headers IS NOT NULL")
    some = lambda c: F.when(F.size(c) > 0, c)
    base = F.coalesce(some(references(F.coalesce("caption", F.lit("")))), some(F.col("pending")))
    sign = F.to_json(F.struct(F.transform("headers", T.normal).alias("h")))
    kept = W.partitionBy("document_id", "sign").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    n = n.select("document_id", "ordinal", base.alias("base"), F.when(F.size("headers") > 0, sign).alias("sign"))
    found = n.withColumn("labels", F.coalesce("base", F.when(F.col("sign").isNotNull(), F.last("base", ignorenulls=True).over(kept))))
    return found.select("document_id", "ordinal", F.explode("labels").alias("label"))


def labelled_rows(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, label, ordinal, row_index, headers, values, key): one row for each key of a labelled table's data row."""
    rows = X.data_rows(tables).join(labels(nodes, tables), ["document_id", "ordinal"])
    at = F.struct("ordinal", "row_index")
    keyed = E.row_keys(rows.select("document_id", "label", at.alias("row_index"), "headers", "values"))
    return rows.join(keyed.select("document_id", "label", F.col("row_index.ordinal").alias("ordinal"), F.col("row_index.row_index").alias("row_index"), "key"), ["document_id", "label", "ordinal", "row_index"]).select("document_id", "label", "ordinal", "row_index", "headers", "values", "key")


def _cells(headers: Column, values: Column) -> Column:
    return F.arrays_zip(headers.alias("h"), values.alias("v"))


def _selected(headers: Column, values: Column, query: Column) -> Column:
    """Cells that a question asks for: key columns, and those whose header it names."""
    asked, flat = F.array_distinct(T.terms(query)), compact(query)
    named = lambda h: ((F.size(header_terms(h)) > 1) & F.contains(flat, compact(h))) | F.arrays_overlap(header_terms(h), asked)
    return F.filter(_cells(headers, values), lambda c: E.key_kind(c["h"]).isNotNull() | named(c["h"]))


def _constrained(headers: Column, values: Column, query: Column) -> Column:
    asked = F.array_distinct(T.terms(query))
    covered = lambda h: (F.size(header_terms(h)) > 0) & (F.size(F.array_except(header_terms(h), asked)) == 0)
    return F.filter(_cells(headers, values), lambda c: F.array_contains(asked, compact(c["h"])) | covered(c["h"]))


def satisfies(query: Column, left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """A question for blank or empty cells wants one: among the columns it names whole, else among those it asks for."""
    asked = T.terms(query)
    blank = lambda c: F.trim(c["v"]) == ""
    named = F.concat(_constrained(*left, query), _constrained(*right, query))
    others = F.filter(F.concat(_selected(*left, query), _selected(*right, query)), lambda c: E.key_kind(c["h"]).isNull())
    wanted = F.when(F.size(named) > 0, F.exists(named, blank)).otherwise(F.exists(others, blank))
    return ~(F.array_contains(asked, "blank") | F.array_contains(asked, "empty")) | wanted


def rendered(query: Column, key: Column, left: tuple[Column, Column, Column], right: tuple[Column, Column, Column], empty: str = EMPTY) -> Column:
    """A joined row as text: its key, then each table's label and cells."""

    def side(label: Column, headers: Column, values: Column) -> list[Column]:
        value = lambda c: F.when(F.trim(c["v"]) == "", F.lit(empty)).otherwise(F.trim(c["v"]))
        cell = lambda c: F.when(F.trim(c["h"]) == "", value(c)).otherwise(F.concat(F.trim(c["h"]), F.lit(": "), value(c)))
        return [label, F.array_join(F.transform(_selected(headers, values, query), cell), " | ")]

    return F.concat_ws("\n", F.concat(F.lit("Joined table key: "), F.regexp_replace(key, "^[^:]*:", "")), *side(*left), *side(*right))


def join_candidates(questions: DataFrame, rows: DataFrame, limit: int = LIMIT, once: bool = True) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, ordinal, text, score): joined rows of tables that a question (query_id, document_id, query) names; ordinal is the first table's.

    An equi-join by document, label and key. Each pair of rows is one candidate by its smallest shared key; the best by score before `limit` times
    PRELIMIT, then the best of each key and pair of tables; all pairs of rows of a key, unless `once`.
    """
    refs = questions.select("query_id", "document_id", "query", F.posexplode(references(F.col("query"))).alias("pos", "ref"))
    refs = refs.withColumn("label_key", T.normal(F.col("ref"))).withColumn("n", F.row_number().over(W.partitionBy("query_id", "document_id", "label_key").orderBy("pos"))).where("n = 1")
    own = rows.withColumn("label_key", T.normal(F.col("label")))
    named = refs.join(own, ["document_id", "label_key"]).select("query_id", "document_id", "query", "pos", "label_key", "label", "ordinal", "row_index", "headers", "values", "key")
    a, b = named.alias("a"), named.drop("query").alias("b")
    met = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.pos") < F.col("b.pos")))
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("pos", "label_key", "label", "ordinal", "row_index", "headers", "values")]
    met = met.select(F.col("a.query_id").alias("query_id"), F.col("a.document_id").alias("document_id"), "query", F.col("a.key").alias("key"), *sides)
    pair = W.partitionBy("query_id", "document_id", "a_ordinal", "a_row_index", "b_ordinal", "b_row_index").orderBy("a_pos", "b_pos", "key")
    met = met.withColumn("n", F.row_number().over(pair)).where("n = 1").where(satisfies(F.col("query"), (F.col("a_headers"), F.col("a_values")), (F.col("b_headers"), F.col("b_values"))))
    text = rendered(F.col("query"), F.col("key"), *((F.col(f"{s}_label"), F.col(f"{s}_headers"), F.col(f"{s}_values")) for s in "ab"))
    met = met.withColumn("text", text)
    ident = T.identity(F.lit("quern.chunk.join.v1"), *(F.col(c) for c in ("document_id", "a_ordinal", "a_row_index", "b_ordinal", "b_row_index", "text")))
    met = met.withColumn("chunk_id", F.concat(F.lit("chunk_"), ident)).withColumn("score", F.round(R.lexical(F.col("query"), F.col("text")), R.DIGITS))
    near = R.ranked(met, F.desc("score"), F.col("chunk_id"), name="first").where(F.col("first") <= limit * PRELIMIT) if once else met
    best = W.partitionBy("query_id", "document_id", "a_label_key", "b_label_key", "key").orderBy(F.desc("score"), "chunk_id")
    near = near.withColumn("n", F.row_number().over(best)).where("n = 1") if once else near
    return R.ranked(near, F.desc("score"), F.col("chunk_id")).where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "document_id", F.col("a_ordinal").alias("ordinal"), "text", "score")


def fragments(tables: DataFrame, tokens: int) -> DataFrame:
    """(document_id, ordinal, fragment, n_rows, text): data rows in order, filled up to `tokens` with caption and headers repeated; a longer row stands alone."""
    rows = X.data_rows(tables).withColumn("line", F.concat_ws(" | ", "values"))
    head = F.concat_ws("\n", "caption", F.when(F.size("headers") > 0, F.concat_ws(" | ", "headers")))
    rows = rows.select("document_id", "ordinal", "row_index", "line", head.alias("head"), T.word_count(F.col("line")).alias("w"))
    g = rows.groupBy("document_id", "ordinal", "head").agg(F.sort_array(F.collect_list(F.struct("row_index", "w"))).alias("n")).withColumn("room", F.lit(tokens) - T.word_count(F.col("head")))
    starts = g.select("document_id", "ordinal", F.expr("""aggregate(n, named_struct('out', cast(array() AS array<bigint>), 'left', -1L),
        (s, x) -> CASE WHEN x.w <= s.left THEN named_struct('out', s.out, 'left', s.left - x.w) ELSE named_struct('out', concat(s.out, array(x.row_index)), 'left', room - x.w) END, s -> s.out)""").alias("starts"))
    cut = rows.join(starts, ["document_id", "ordinal"]).withColumn("fragment", F.size(F.filter("starts", lambda s: s <= F.col("row_index"))).cast("long"))
    out = cut.groupBy("document_id", "ordinal", "fragment", "head").agg(F.sort_array(F.collect_list(F.struct("row_index", "line"))).alias("x"))
    lines = F.concat_ws("\n", F.transform("x", lambda r: r["line"]))
    return out.select("document_id", "ordinal", "fragment", F.size("x").cast("long").alias("n_rows"), F.concat_ws("\n", F.nullif(F.col("head"), F.lit("")), lines).alias("text"))
