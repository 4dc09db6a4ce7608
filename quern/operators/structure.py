"""Structural expansion: siblings, list neighbours, page neighbours, capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.retrieval import DIGITS

SIBLING, LIST, PAGE = 0.85, 0.9, 0.8
PAGE_DISTANCE, PAGE_LIMIT = 3, 64


def penalised(score, penalty):
    """A related row's score: lower than its anchor's whatever the sign."""
    return F.when(score > 0, score * penalty).when(score < 0, score / penalty).otherwise(penalty - 1.0)


def neighbours(nodes: DataFrame, kind: str, limit: int, penalty: float, same_heading: bool) -> DataFrame:
    """(document_id, anchor, neighbour, distance, penalty): nodes of one kind near each body node of that kind among all its siblings.

    An equi-join on document and place: each anchor meets 2 x limit places at most.
    """
    keys = ["document_id", "ordinal", "kind", *(["heading_path"] if same_heading else [])]
    body = nodes.where("content_layer = 'body'").select(*keys).withColumn("place", F.row_number().over(W.partitionBy("document_id").orderBy("ordinal")))
    steps = F.array(*[F.lit(d) for d in range(-limit, limit + 1) if d])
    anchors = body.where(F.col("kind") == kind).select("document_id", F.col("ordinal").alias("anchor"), *([F.col("heading_path").alias("own")] if same_heading else []), F.col("place").alias("from"), F.explode(steps).alias("d"))
    anchors = anchors.withColumn("place", F.col("from") + F.col("d"))
    both = anchors.join(body.where(F.col("kind") == kind), ["document_id", "place"])
    if same_heading:
        both = both.where("own = heading_path")
    return both.select("document_id", "anchor", F.col("ordinal").alias("neighbour"), F.abs("d").cast("long").alias("distance"), F.round(F.pow(F.lit(penalty), F.abs("d")), DIGITS).alias("penalty"))


def page_neighbours(anchors: DataFrame, units: DataFrame, distance: int = PAGE_DISTANCE, limit: int = PAGE_LIMIT) -> DataFrame:
    """(query_id, rank, chunk_id, distance, score): units on pages near an anchor's, each by its nearest, then best ranked anchor.

    The range join goes by document and exact page: anchors are spread over the pages they reach.
    """
    reach = anchors.select("query_id", F.col("rank").alias("anchor_rank"), F.col("score").alias("anchor_score"), "document_id", F.explode(F.sequence(F.col("page") - distance, F.col("page") + distance)).alias("near"), F.col("page").alias("anchor_page"))
    both = reach.join(units.select("document_id", F.col("page").alias("near"), "chunk_id"), ["document_id", "near"]).withColumn("distance", F.abs(F.col("near") - F.col("anchor_page")))
    own = anchors.select("query_id", "chunk_id")
    both = both.join(own, ["query_id", "chunk_id"], "left_anti")
    best = both.withColumn("n", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("distance", "anchor_rank"))).where("n = 1")
    score = F.round(F.col("anchor_score") * F.pow(F.lit(PAGE), F.greatest(F.col("distance"), F.lit(1))), DIGITS)
    out = best.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("long"))
    return out.where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "distance", "score")


def relatives(nodes: DataFrame, kind: str, limit: int, penalty: float, same_heading: bool) -> DataFrame:
    """As neighbours(), among the children of one parent (or the roots): nodes with parent, place and heading_path."""
    keys = ["document_id", F.coalesce("parent", F.lit(-1)).alias("family"), "place"]
    steps = F.explode(F.array(*[F.lit(d) for d in range(-limit, limit + 1) if d])).alias("d")
    of = nodes.where(F.col("kind") == kind)
    a = of.select(*keys, F.col("ordinal").alias("anchor"), F.col("heading_path").alias("own"), steps).withColumn("place", F.col("place") + F.col("d"))
    both = a.join(of.select(*keys, F.col("ordinal").alias("neighbour"), "heading_path"), ["document_id", "family", "place"])
    both = both.where("own = heading_path") if same_heading else both
    return both.select("document_id", "anchor", "neighbour", F.abs("d").cast("long").alias("distance"), F.round(F.pow(F.lit(penalty), F.abs("d")), DIGITS).alias("penalty"))


def outward(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(document_id, unit, neighbour, kind, penalty): next to the first and last node of a unit of several, away from it."""
    several = units.where("n_nodes > 1")
    edges = several.select("document_id", "unit", F.explode(F.array(F.struct(F.array_min("members").alias("edge"), F.lit(-1).alias("way")), F.struct(F.array_max("members").alias("edge"), F.lit(1).alias("way")))).alias("e")).select("document_id", "unit", F.col("e.edge").alias("edge"), F.col("e.way").alias("way"))
    near = relatives(nodes, "paragraph", 1, SIBLING, True).withColumn("kind", F.lit("paragraph")).unionByName(relatives(nodes, "list_item", 1, LIST, False).withColumn("kind", F.lit("list_item")))
    met = edges.join(near.withColumnRenamed("anchor", "edge"), ["document_id", "edge"]).where("(neighbour - edge) * way > 0")
    return met.select("document_id", "unit", "neighbour", "kind", "penalty")


def semantic_html(nodes: DataFrame) -> DataFrame:
    """(document_id, html, n_nodes): an outline of links, then body nodes in tags by kind, headings by the depth of their path."""
    n = nodes.where("content_layer = 'body' AND kind <> 'list'")
    depth = F.concat(F.lit("h"), F.least(F.lit(6), F.size("heading_path") + 1).cast("string"))
    tag = F.when(F.col("kind") == "title", "h1").when(F.col("kind") == "heading", depth).when(F.col("kind") == "list_item", "li").when(F.col("kind") == "caption", "figcaption").when(F.col("kind").isin("code", "table"), "pre").otherwise("p")
    body = T.escape_html(F.col("text"))
    link = F.when(F.col("kind").isin("title", "heading"), F.concat(F.lit('<a href="#'), "node_id", F.lit('">'), body, F.lit("</a>")))
    whole = F.concat(F.lit("<"), tag, F.lit(' id="'), F.col("node_id"), F.lit('">'), body, F.lit("</"), tag, F.lit(">"))
    rows = n.select("document_id", "ordinal", link.alias("link"), whole.alias("whole")).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "link", "whole"))).alias("x"))
    nav = F.concat_ws("", F.transform("x", lambda r: r["link"]))
    html = F.concat(F.lit("<nav>"), nav, F.lit("</nav>\n"), F.concat_ws("\n", F.transform("x", lambda r: r["whole"])))
    return rows.select("document_id", html.alias("html"), F.size("x").cast("long").alias("n_nodes"))
