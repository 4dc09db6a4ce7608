"""Typed nodes in reading order from documents, web pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.graph import heading_paths  # noqa: F401 part of this module's face

#: Lines of a plain document on one synthetic page.
LINES_PER_PAGE = 8


def _finished(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "document_id",
        F.concat(F.lit("node_"), T.identity(F.lit("quern.node.v1"), F.col("document_id"), F.col("ordinal"), F.col("text"))).alias("node_id"),
        "ordinal",
        "kind",
        "content_layer",
        "text",
        "page",
        T.word_count(F.col("text")).alias("token_count"),
        *(["level"] if "level" in nodes.columns else []),
    )


def document_nodes(documents: DataFrame) -> DataFrame:
    """One node for each line; rows of cells between bars are tables, dashes open list items."""
    lines = documents.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ordinal", "text"))
    kind = F.when(F.col("text").rlike(r"\|.*\|"), "table").when(F.col("text").rlike(r"^\s*[-*] "), "list_item").otherwise("paragraph")
    lines = lines.withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("kind", kind).withColumn("content_layer", F.lit("body"))
    return _finished(lines.withColumn("page", F.floor(F.col("ordinal") / LINES_PER_PAGE).cast("long") + 1))


def page_nodes(pages: DataFrame) -> DataFrame:
    """Titles, headings, paragraphs, list items and furniture of HTML: the text that directly follows each opening tag."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(script|style)[^>]*>[^<]*</(script|style)>", ""), r"(?s)<!--[^>]*-->", "")
    base = pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("document_id"), body.alias("body"))
    tag, after = (F.regexp_extract_all("body", F.lit(r"<(title|h1|h2|h3|p|li|footer|nav|div|td|th)\b[^>]*>([^<]*)"), F.lit(k)) for k in (1, 2))
    found = base.select("document_id", F.posexplode(F.arrays_zip(tag.alias("tag"), after.alias("raw"))).alias("at", "x"))
    found = found.select("document_id", "at", F.col("x.tag").alias("tag"), T.collapsed(T.unescape_html(F.col("x.raw"))).alias("text")).where("text <> ''")
    kind = F.expr("CASE tag WHEN 'title' THEN 'title' WHEN 'h1' THEN 'title' WHEN 'h2' THEN 'heading' WHEN 'h3' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list_item' ELSE 'other' END")
    layer = F.when(F.col("tag").isin("footer", "nav", "div", "title"), "furniture").otherwise("body")
    order = W.partitionBy("document_id").orderBy("at")
    nodes = found.withColumn("kind", kind).withColumn("content_layer", layer).withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    level = F.expr("CASE tag WHEN 'title' THEN 0 WHEN 'h1' THEN 0 WHEN 'h2' THEN 1 WHEN 'h3' THEN 2 END").cast("long")
    return _finished(nodes.withColumn("page", F.lit(1).cast("long")).withColumn("level", level))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """One paragraph for each turn."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select(
        F.concat(F.lit("conversations/"), F.col("conv_id").cast("string")).alias("document_id"),
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        F.lit("paragraph").alias("kind"),
        F.lit("body").alias("content_layer"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(1).cast("long").alias("page"),
    )
    return _finished(turns)
