"""Node graphs: reading order, parents and children, page ranges, heading paths by level, and what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.runtime import stored

#: Heading levels that are told apart; deeper ones count as the last.
LEVELS = 6
KINDS = ("title", "heading", "paragraph", "list", "list_item", "table", "table_chunk", "caption", "figure", "code", "other")


def project(items: DataFrame) -> DataFrame:
    """Items (document_id, pos, parent_pos, kind, level, content_layer, text, pages) as nodes.

    pos is anything that sorts in reading order; it becomes an ordinal from 0 on. parent_pos is the parent's pos or null. pages are those of
    an item's boxes, and give its page range, null without any. Other columns pass through.
    """
    order = W.partitionBy("document_id").orderBy("pos")
    numbered = items.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    places = numbered.select("document_id", F.col("pos").alias("parent_pos"), F.col("ordinal").alias("parent"))
    rest = [c for c in items.columns if c not in ("pos", "parent_pos", "pages")]
    found = numbered.join(places, ["document_id", "parent_pos"], "left")
    family = W.partitionBy("document_id", F.coalesce("parent", F.lit(-1))).orderBy("ordinal")
    return found.select(
        *rest, "ordinal", "parent", F.row_number().over(family).cast("long").alias("place"),
        F.array_min("pages").cast("long").alias("page_start"), F.array_max("pages").cast("long").alias("page_end"), T.word_count(F.col("text")).alias("token_count"),
        F.concat(F.lit("node_"), T.identity(F.lit("quern.node.v1"), F.col("document_id"), F.col("ordinal"), F.col("text"))).alias("node_id"),
    )


def children(nodes: DataFrame) -> DataFrame:
    """(document_id, ordinal, children): ordinals of each parent's children in reading order."""
    own = nodes.where("parent IS NOT NULL").groupBy("document_id", F.col("parent").alias("ordinal"))
    return own.agg(F.sort_array(F.collect_list(nodes["ordinal"])).alias("children"))


def level_of(nodes: DataFrame) -> Column:
    given = F.col("level") if "level" in nodes.columns else F.lit(None)
    return F.when(F.col("kind") == "title", 0).when(F.col("kind") == "heading", F.least(F.greatest(F.coalesce(given, F.lit(1)), F.lit(1)), F.lit(LEVELS)))


def heading_paths(nodes: DataFrame) -> DataFrame:
    """(document_id, ordinal, heading_path): titles reset the path, and a heading ends those of its level and below.

    In place of a stack: for each level the last heading so far holds unless one of a smaller level came after it. One window, no join.
    Furniture has an empty path and opens none; a blank title clears the path, a blank heading counts for nothing.
    """
    text = F.trim("text")
    level = F.when((F.col("content_layer") == "body") & ((F.col("kind") == "title") | (text != "")), level_of(nodes))
    w = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    marked = nodes.select("document_id", "ordinal", "content_layer", level.alias("_level"), text.alias("_head"))
    last = [F.last(F.when(F.col("_level") == k, F.struct(F.col("ordinal").alias("at"), F.col("_head").alias("head"))), ignorenulls=True).over(w).alias(f"_h{k}") for k in range(LEVELS + 1)]
    lower = [F.max(F.when(F.col("_level") < k, F.col("ordinal"))).over(w).alias(f"_l{k}") for k in range(1, LEVELS + 1)]
    seen = marked.select("document_id", "ordinal", "content_layer", *last, *lower)
    held = [F.col("_h0.head"), *(F.when(F.col(f"_l{k}").isNull() | (F.col(f"_h{k}.at") > F.col(f"_l{k}")), F.col(f"_h{k}.head")) for k in range(1, LEVELS + 1))]
    path = F.filter(F.array(*held), lambda x: x.isNotNull() & (x != ""))
    return seen.select("document_id", "ordinal", F.when(F.col("content_layer") == "body", path).otherwise(F.array().cast("array<string>")).alias("heading_path"))


def reachable(nodes: DataFrame) -> DataFrame:
    """(document_id, ordinal) of nodes that a root's children, and theirs, lead to; a cycle is never reached.

    One level at a time, each stored: neither the rows nor the depth of a graph are bounded, as a recursive query's are. What was met is not followed again.
    """
    below = nodes.where("parent IS NOT NULL").select("document_id", "parent", F.col("ordinal").alias("child"))
    level = stored(nodes.where("parent IS NULL").select("document_id", "ordinal").distinct(), "reached")
    paths = [level._quern_path]
    while True:
        found = nodes.sparkSession.read.schema(level.schema).parquet(*paths)
        under = level.withColumnRenamed("ordinal", "parent").join(below, ["document_id", "parent"]).select("document_id", F.col("child").alias("ordinal")).distinct()
        level = stored(under.join(found, ["document_id", "ordinal"], "left_anti"), "reached")
        if level.isEmpty():
            return found
        paths.append(level._quern_path)


def violations(nodes: DataFrame) -> DataFrame:
    """(document_id, and one count for each invariant that is broken): one row for each document."""
    known = nodes.select("document_id", F.col("ordinal").alias("parent"), F.lit(True).alias("_known")).distinct()
    met = reachable(nodes).withColumn("_met", F.lit(True))
    seen = nodes.join(known, ["document_id", "parent"], "left").join(met, ["document_id", "ordinal"], "left")
    rooted = F.col("parent").isNull()
    return seen.groupBy("document_id").agg(
        F.count("*").alias("n_nodes"),
        (F.count("*") - F.countDistinct("node_id")).alias("repeated_ids"),
        ((F.min("ordinal") != 0) | (F.max("ordinal") != F.count("*") - 1) | (F.countDistinct("ordinal") != F.count("*"))).alias("gaps"),
        F.count_if(~F.col("kind").isin(*KINDS)).alias("unknown_kinds"),
        F.count_if(F.col("page_start").isNull() != F.col("page_end").isNull()).alias("half_ranges"),
        F.count_if((F.col("page_start") > F.col("page_end")) | (F.col("page_start") < 1)).alias("bad_ranges"),
        F.count_if(~rooted & F.col("_known").isNull()).alias("unknown_parents"),
        F.count_if(F.col("parent") == F.col("ordinal")).alias("own_parents"),
        F.count_if(F.col("_met").isNull()).alias("unreachable"),
    )
