"""Content units: node chunks, sliding windows, merged and long-context units, search text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T

SIZE, OVERLAP = 512, 64
#: Merging: units below SMALL tokens join up to MOST, and close at TARGET.
SMALL, TARGET, MOST = 64, 128, 256


def node_chunks(nodes: DataFrame) -> DataFrame:
    """Body nodes with text, lists aside, each as one unit."""
    found = nodes.where("content_layer = 'body' AND kind <> 'list' AND trim(text) <> ''")
    return found.select(
        F.concat(F.lit("chunk_"), T.identity(F.lit("quern.chunk.node.v1"), F.col("document_id"), F.col("node_id"), F.col("text"))).alias("chunk_id"),
        "document_id", "ordinal", "node_id", "kind", "text", "token_count", "page",
    )


def fixed_chunks(nodes: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of size tokens over a document's body, each overlapping the one before; the last is the first to reach the end.

    A document's tokens are one array, sliced by window: no shuffle beyond bringing its nodes together.
    """
    step = size - overlap
    body = nodes.where("content_layer = 'body' AND trim(text) <> ''")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])
    docs = body.groupBy("document_id").agg(F.concat_ws("\n", lines).alias("text"))
    docs = docs.select("document_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("t"))
    last = F.greatest(F.lit(0), F.ceil((F.size("t") - size) / step)).cast("int")
    windows = docs.select("document_id", "t", F.explode(F.sequence(F.lit(0), last)).alias("w"))
    out = windows.select("document_id", F.col("w").cast("long").alias("ordinal"), F.expr(f"slice(t, w * {step} + 1, {size})").alias("s"))
    out = out.select("document_id", "ordinal", F.concat_ws(" ", "s").alias("text"), F.size("s").cast("long").alias("token_count"))
    return out.select(F.concat(F.lit("chunk_"), T.identity(F.lit("quern.chunk.fixed.v1"), F.col("document_id"), F.col("ordinal"), F.col("text"))).alias("chunk_id"), "*")


def long_context_chunks(nodes: DataFrame) -> DataFrame:
    """Body nodes with text in source order, with their place in it."""
    found = nodes.where("content_layer = 'body' AND kind <> 'list' AND trim(text) <> ''")
    place = F.row_number().over(W.partitionBy("document_id").orderBy("ordinal")).cast("long")
    return found.select("document_id", "ordinal", place.alias("place"), F.trim("text").alias("text"), "token_count")


def merged_chunks(nodes: DataFrame) -> DataFrame:
    """Runs of small paragraphs or list items of one page, joined left to right: a fold over each document's nodes.

    A unit takes the next node while both are small, kinds may be merged, the page is the same, the joined text has at most
    MOST tokens and the unit has less than TARGET.
    """
    found = nodes.where("content_layer = 'body' AND kind <> 'list' AND trim(text) <> ''")
    items = found.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "kind", "page", "token_count"))).alias("n"))
    folded = items.select(
        "document_id",
        F.expr(f"""
          aggregate(n, named_struct('out', cast(array() AS array<struct<ordinal: bigint, unit: bigint>>), 'unit', -1L, 'tokens', 0L, 'page', -1L, 'open', false),
            (s, x) -> CASE WHEN s.open AND x.kind IN ('paragraph', 'list_item') AND x.token_count < {SMALL} AND s.page = x.page AND s.tokens < {TARGET} AND s.tokens + x.token_count <= {MOST}
              THEN named_struct('out', concat(s.out, array(named_struct('ordinal', x.ordinal, 'unit', s.unit))), 'unit', s.unit, 'tokens', s.tokens + x.token_count, 'page', s.page, 'open', true)
              ELSE named_struct('out', concat(s.out, array(named_struct('ordinal', x.ordinal, 'unit', x.ordinal))), 'unit', x.ordinal, 'tokens', x.token_count, 'page', x.page,
                                'open', x.kind IN ('paragraph', 'list_item') AND x.token_count < {SMALL}) END,
            s -> s.out)"""),
    ).toDF("document_id", "u")
    units = folded.select("document_id", F.explode("u").alias("u")).select("document_id", "u.ordinal", "u.unit")
    grouped = found.join(units, ["document_id", "ordinal"]).groupBy("document_id", "unit")
    return grouped.agg(
        F.count("*").alias("n_nodes"),
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])).alias("text"),
        F.sum("token_count").alias("token_count"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
    )


def merged_units(nodes: DataFrame, pages: int = 1) -> DataFrame:
    """(document_id, unit, n_nodes, text, token_count, page_start, page_end, heading_path, members): as merged_chunks(), by headings and page spans.

    A unit takes the next node while both are small, kinds may be merged, heading paths are equal, all of it spans at most `pages` page breaks,
    the joined text has at most MOST tokens and the unit has less than TARGET. The fold runs over small rows; its output is one number for each node.
    """
    found = nodes.where("content_layer = 'body' AND kind <> 'list' AND trim(text) <> ''")
    row = F.struct("ordinal", "kind", "page_start", "page_end", "token_count", F.xxhash64(F.to_json(F.struct("heading_path"))).alias("path"))
    items = found.groupBy("document_id").agg(F.sort_array(F.collect_list(row)).alias("n"))
    small = f"x.kind IN ('paragraph', 'list_item') AND x.token_count < {SMALL}"
    joins = f"s.open AND {small} AND s.path = x.path AND s.tokens < {TARGET} AND s.tokens + x.token_count <= {MOST} AND greatest(s.high, x.page_end) - least(s.low, x.page_start) <= {pages}"
    folded = items.select("document_id", F.expr(f"""
      aggregate(n, named_struct('out', cast(array() AS array<bigint>), 'tokens', 0L, 'low', cast(NULL AS bigint), 'high', cast(NULL AS bigint), 'path', 0L, 'open', false),
        (s, x) -> CASE WHEN {joins}
          THEN named_struct('out', s.out, 'tokens', s.tokens + x.token_count, 'low', least(s.low, x.page_start), 'high', greatest(s.high, x.page_end), 'path', x.path, 'open', true)
          ELSE named_struct('out', concat(s.out, array(x.ordinal)), 'tokens', x.token_count, 'low', x.page_start, 'high', x.page_end, 'path', x.path, 'open', {small}) END, s -> s.out)""").alias("starts"))
    starts = folded.select("document_id", F.explode("starts").alias("ordinal"), F.lit(True).alias("begins"))
    order = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    placed = found.join(starts, ["document_id", "ordinal"], "left").withColumn("unit", F.last(F.when(F.col("begins"), F.col("ordinal")), ignorenulls=True).over(order))
    return placed.groupBy("document_id", "unit").agg(
        F.count("*").alias("n_nodes"),
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])).alias("text"),
        F.sum("token_count").alias("token_count"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.first("heading_path").alias("heading_path"),
        F.sort_array(F.collect_list("ordinal")).alias("members"),
    )


def search_text(chunks: DataFrame) -> DataFrame:
    """Heading trail above the text; the last heading is left out if it is the text itself."""
    path, text = F.col("heading_path"), F.col("text")
    trail = F.when((F.size(path) > 0) & (T.fold(F.element_at(F.concat(F.array(F.lit("")), path), -1)) == T.fold(text)), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    return chunks.withColumn("search_text", F.when(F.size(trail) > 0, F.concat_ws("\n", trail, F.array(text))).otherwise(text))
