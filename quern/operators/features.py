"""Features of documents: a union of kinds with provenance, their choice for a question, and their counts."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import enrich as E

# Importance by kind, and limits.
OUTLINE, SUMMARY, QUANTITY, DEFINED_AS, REFERENCES, ENTITY, ALIAS_OF, HAS_COLUMNS, SCHEMA, ROW = 0.45, 0.65, 0.82, 0.88, 0.76, 0.84, 0.82, 0.86, 0.92, 0.88
SUMMARY_SENTENCES, ROWS, INLINE = 2, 2000, 128
SUMMARY_KINDS = ("paragraph", "list_item", "code", "other")
# Fixed value: how a sentence names what it defines.
DEFINITION_PARTS = r"(?i)^(.{1,80}?)\s+(?:means|refers to|is defined as)\s+(.{1,240}?)[.]?$"
FEATURES, TOKENS = 32, 2048


def body(nodes: DataFrame) -> DataFrame:
    return nodes.where("content_layer = 'body' AND trim(text) <> ''")


def summarised(nodes: DataFrame) -> DataFrame:
    return body(nodes).where(F.col("kind").isin(*SUMMARY_KINDS))


def sentences(nodes: DataFrame) -> DataFrame:
    """(document_id, ordinal, sentence_no, sentence): line by line, cut after . ! ? and white space."""
    lines = F.flatten(F.transform(F.split("text", r"\r\n|\n|\r"), lambda line: F.split(T.trimmed(line), E.SENTENCE_END)))
    parts = F.filter(F.transform(lines, T.trimmed), lambda s: s != "")
    return nodes.select("document_id", "ordinal", F.posexplode(parts).alias("sentence_no", "sentence")).withColumn("sentence_no", F.col("sentence_no").cast("long"))


def section_summaries(nodes: DataFrame, paths: DataFrame, limit: int = SUMMARY_SENTENCES) -> DataFrame:
    """(document_id, ordinal, heading_path, summary): the first sentences under each heading path, at the first node that gave one."""
    s = sentences(summarised(nodes)).join(paths, ["document_id", "ordinal"])
    first = s.withColumn("n", F.row_number().over(W.partitionBy("document_id", "heading_path").orderBy("ordinal", "sentence_no"))).where(F.col("n") <= limit)
    joined = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]))
    return first.groupBy("document_id", "heading_path").agg(F.min("ordinal").alias("ordinal"), joined.alias("summary"))


def definitions(found: DataFrame) -> DataFrame:
    """(document_id, ordinal, sentence_no, subject, object) of sentences that define, by their whole form."""
    part = lambda k: F.trim(F.regexp_extract(F.trim("sentence"), DEFINITION_PARTS, k))
    named = found.where("defines").select("document_id", "ordinal", "sentence_no", part(1).alias("subject"), part(2).alias("object"))
    return named.where("subject <> ''")


def entities(nodes: DataFrame) -> DataFrame:
    """(document_id, ordinal, name, alias): each pair once in a document whatever its case, at its first node."""
    found = E._each(F.col("text"), E.ALIAS, 1, 2)
    x = summarised(nodes).select("document_id", "ordinal", F.posexplode(found).alias("at", "a"))
    x = x.select("document_id", "ordinal", "at", F.trim("a.g1").alias("name"), F.col("a.g2").alias("alias"))
    first = W.partitionBy("document_id", T.fold(F.col("name")), T.fold(F.col("alias"))).orderBy("ordinal", "at")
    return x.withColumn("n", F.row_number().over(first)).where("n = 1").select("document_id", "ordinal", "name", "alias")


def data_rows(tables: DataFrame) -> DataFrame:
    """tables (document_id, ordinal, caption, headers, rows) -> (…, row_index from 1, values): the header row left out where the table repeats it."""
    rows = F.when((F.size("headers") > 0) & (F.col("rows")[0] == F.col("headers")), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))
    cut = tables.select("document_id", "ordinal", "caption", "headers", F.posexplode(rows).alias("row_index", "values"))
    return cut.withColumn("row_index", (F.col("row_index") + 1).cast("long"))


def table_rows(tables: DataFrame, limit: int = ROWS) -> DataFrame:
    """Data rows with their text and values by label; the first `limit` of a document."""
    found = data_rows(tables).withColumn("n", F.row_number().over(W.partitionBy("document_id").orderBy("ordinal", "row_index"))).where(F.col("n") <= limit)
    cells = F.concat_ws(" | ", F.transform("values", lambda v: F.when(v == "", "[blank]").otherwise(v)))
    labels = F.transform("values", lambda v, k: F.coalesce(F.get("headers", k), F.concat(F.lit("column_"), (k + 1).cast("string"))))
    return found.select("document_id", "ordinal", "row_index", F.concat(F.lit("Row "), F.col("row_index").cast("string"), F.lit(": "), cells).alias("text"), F.map_from_arrays(labels, "values").alias("by_label"))


def enriched(nodes: DataFrame, paths: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, ordinal, kind, text, importance, page): features of all kinds, each at the node that it comes from."""
    n = body(nodes)
    kinds = lambda df, kind, text, importance: df.select("document_id", "ordinal", F.lit(kind).alias("kind"), text.alias("text"), F.lit(importance).alias("importance"))
    facts = E.key_facts(sentences(summarised(nodes)))
    schema = tables.withColumn("n", F.size("rows"))
    parts = [
        kinds(n.where("kind IN ('title', 'heading')"), "outline", F.trim("text"), OUTLINE),
        kinds(section_summaries(nodes, paths), "section_summary", F.col("summary"), SUMMARY),
        facts.select("document_id", "ordinal", F.when(F.col("defines"), "definition").otherwise("key_fact").alias("kind"), F.col("sentence").alias("text"), "importance"),
        kinds(E.quantities(facts).select("document_id", "ordinal", "value", "unit", "scale").distinct(), "quantity", F.concat_ws(" ", "value", F.when(F.col("scale") != "", F.col("scale")), "unit"), QUANTITY),
        kinds(definitions(facts), "relationship", F.concat(F.col("subject"), F.lit(" defined as "), F.col("object"), F.lit(".")), DEFINED_AS),
        kinds(E.references(n), "relationship", F.concat(F.lit("Source passage references "), F.col("reference"), F.lit(".")), REFERENCES),
        kinds(entities(nodes), "entity", F.concat(F.col("name"), F.lit(" ("), F.col("alias"), F.lit(")")), ENTITY),
        kinds(entities(nodes), "relationship", F.concat(F.col("alias"), F.lit(" is an alias of "), F.col("name"), F.lit(".")), ALIAS_OF),
        kinds(schema, "table_schema", E.schema_text(F.col("caption"), F.col("headers"), F.col("n")), SCHEMA),
        kinds(schema, "relationship", F.concat(F.coalesce(F.when(F.col("caption") != "", F.col("caption")), F.lit("Table")), F.lit(" has columns: "), F.when(F.size("headers") == 0, "[unlabeled]").otherwise(F.array_join("headers", ", ")), F.lit(".")), HAS_COLUMNS),
        kinds(table_rows(tables), "table_row", F.col("text"), ROW),
    ]
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.join(nodes.select("document_id", "ordinal", F.coalesce("page_start", F.lit(0)).alias("page"), "node_id"), ["document_id", "ordinal"])


def identified(features: DataFrame) -> DataFrame:
    return features.withColumn("feature_id", F.concat(F.lit("feature_"), T.identity(F.lit("quern.feature.v1"), F.col("document_id"), F.col("kind"), F.col("node_id"), F.col("text"))))


def authorised(features: DataFrame, allowed: DataFrame) -> DataFrame:
    """Features whose source nodes are among the allowed (document_id, ordinal)."""
    return features.join(allowed.select("document_id", "ordinal").distinct(), ["document_id", "ordinal"], "left_semi")


def inline(features: DataFrame, limit: int = INLINE) -> DataFrame:
    """The first `limit` features of each document by importance, page and id, with their place."""
    order = W.partitionBy("document_id").orderBy(F.desc("importance"), "page", "feature_id")
    return features.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def feature_terms(text: Column) -> Column:
    """Terms of a feature or question, without what carries no meaning."""
    return T.coverage_terms(text, T.FEATURE_STOPWORDS)


def select(candidates: DataFrame, most: int = FEATURES, budget: int = TOKENS) -> DataFrame:
    """(query_id, place, feature_id, score): greedy choice by what a feature adds to the question's matched terms.

    candidates: query_id, feature_id, matched (terms of the question that the feature has), weight (importance times confidence), token_count, page.
    Features that don't fit the rest of the budget are passed over; one without matched terms may only come first. A question's pool is one group.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        # among features with the same matched terms the order never changes: only the first one left of each such group is looked at
        groups: dict[frozenset, list] = {}
        for matched, weight, tokens, page, feature in zip(*(frame[c] for c in ("matched", "weight", "token_count", "page", "feature_id")), strict=True):
            if tokens <= budget:
                groups.setdefault(frozenset(matched), []).append((-weight, int(tokens), int(page), feature))
        for rows in groups.values():
            rows.sort(reverse=True)
        left, covered, out = budget, set(), []
        while groups and len(out) < most:
            matched = min(groups, key=lambda g: (-len(g - covered), -len(g), groups[g][-1]))
            if not matched and out:  # no group with matched terms is left
                break
            weight, tokens, _, feature = groups[matched].pop()
            if not groups[matched]:
                del groups[matched]
            if tokens > left:
                continue
            out.append((frame["query_id"].iloc[0], len(out) + 1, feature, round(10.0 * len(matched - covered) + 2.0 * len(matched) - weight, 6)))
            left -= tokens
            covered |= matched
        return pd.DataFrame(out, columns=["query_id", "place", "feature_id", "score"])

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, place long, feature_id string, score double")
