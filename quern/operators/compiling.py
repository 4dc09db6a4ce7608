"""From a ranking to a packet: candidates of several classes in one order, without repeats, packed under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import packing as P
from quern.operators import retrieval as R
from quern.operators import structure as S

#: Places in the order of emission: a ranking's rows take ten each, then joins, then page neighbours.
JOINS, PAGES = 1_000_000, 2_000_000
#: Budgets from which pages nearby are offered, and only where what is there doesn't fill the budget.
PAGES_FROM = 16384


def trail(path: Column, text: Column, depth: int | None = None) -> Column:
    """Text under its headings: the first one bare, the others after '> ', a blank line, the text; the last heading is left out if it is the text itself."""
    same = (F.size(path) > 0) & (T.fold(F.trim(F.element_at(F.concat(F.array(F.lit("")), path), -1))) == T.fold(F.trim(text)))
    kept = F.when(same, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    kept = F.slice(kept, F.greatest(F.size(kept) - depth + 1, F.lit(1)), depth) if depth else kept
    lines = F.transform(kept, lambda h, k: F.when(k == 0, h).otherwise(F.concat(F.lit("> "), h)))
    return F.when(F.size(kept) == 0, text).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), text))


def expanded_id(base: Column, relation: Column, value: Column) -> Column:
    return F.concat(F.lit("chunk_"), T.identity(F.lit("quern.chunk.expanded.v1"), base, relation, value))


def expand(ranked: DataFrame, nodes: DataFrame, joins: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, ordinal, text, token_count, reranked, tier, origin_rank, expansion_order, operator, shared): candidates in one order.

    ranked: query_id, rank, chunk_id, document_id, ordinal, reranked. nodes: with parent, place, heading_path, node_id. Each hit stands under its headings;
    its paragraph siblings and list neighbours follow with its score less a penalty, and are never scored themselves. joins
    (query_id, rank, chunk_id, document_id, ordinal, text, score) are primary evidence, and may share their sources.
    """
    hits = ranked.select("query_id", F.col("rank").alias("origin_rank"), F.col("chunk_id").alias("base"), "document_id", F.col("ordinal").alias("anchor"), "reranked")
    steps = [hits.withColumns({"ordinal": F.col("anchor"), "distance": F.lit(0).cast("long"), "penalty": F.lit(1.0), "operator": F.lit("direct")})]
    for kind, penalty, heading, operator in (("paragraph", S.SIBLING, True, "sibling"), ("list_item", S.LIST, False, "list_neighbor")):
        near = S.relatives(nodes, kind, 1, penalty, heading).withColumnRenamed("neighbour", "ordinal")
        steps.append(hits.join(near, ["document_id", "anchor"]).withColumn("operator", F.lit(operator)))
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    own = nodes.select("document_id", "ordinal", "node_id", trail(F.col("heading_path"), F.col("text")).alias("text"))
    every = every.join(own, ["document_id", "ordinal"])
    relation, value = F.when(F.col("operator") == "direct", "direct").otherwise(F.col("operator")), F.when(F.col("operator") == "direct", F.col("text")).otherwise(F.col("node_id"))
    score = F.when(F.col("operator") == "direct", F.col("reranked")).otherwise(F.round(S.penalised(F.col("reranked"), F.col("penalty")), R.DIGITS))
    offset = F.when(F.col("operator") == "direct", 0).when(F.col("ordinal") < F.col("anchor"), 1).otherwise(2)
    found = every.select(
        "query_id", expanded_id(F.col("base"), relation, value).alias("chunk_id"), "document_id", "ordinal", "text", T.word_count(F.col("text")).alias("token_count"), score.alias("reranked"),
        F.lit(0).alias("tier"), "origin_rank", (F.col("origin_rank") * 10 + offset).alias("expansion_order"), "operator", F.lit(False).alias("shared"),
    )
    if joins is not None:
        found = found.unionByName(joins.select(
            "query_id", "chunk_id", "document_id", "ordinal", "text", T.word_count(F.col("text")).alias("token_count"), F.col("score").alias("reranked"),
            F.lit(0).alias("tier"), F.col("rank").alias("origin_rank"), (F.lit(JOINS) + F.col("rank")).alias("expansion_order"), F.lit("keyed_join").alias("operator"), F.lit(True).alias("shared"),
        ))
    return ordered(found)


def ordered(candidates: DataFrame) -> DataFrame:
    """rank by tier, score, origin, place of emission and id: the only order across classes."""
    return R.ranked(candidates.drop("rank"), F.col("tier"), F.desc("reranked"), F.col("origin_rank"), F.col("expansion_order"), F.col("chunk_id"))


def deduplicated(candidates: DataFrame) -> DataFrame:
    """The first of the candidates with one normal text, then of those with one source; candidates that may share sources are asked for their text only."""
    one = W.partitionBy("query_id", T.normal(F.col("text"))).orderBy("rank")
    first = candidates.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    source = F.when(F.col("shared"), F.col("chunk_id")).otherwise(F.concat_ws("#", "document_id", F.col("ordinal").cast("string")))
    return first.withColumn("source", source).withColumn("_n", F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))).where("_n = 1").drop("_n")


def capacity(candidates: DataFrame) -> DataFrame:
    """(query_id, budget, capacity): tokens of the first candidate of each source that fits a budget; candidates have a budget."""
    fits = candidates.where("token_count <= budget").withColumn("_n", F.row_number().over(W.partitionBy("query_id", "budget", "document_id", "ordinal").orderBy("rank"))).where("_n = 1")
    return fits.groupBy("query_id", "budget").agg(F.sum("token_count").alias("capacity"))


def compiled(candidates: DataFrame, budgets: tuple[int, ...] = P.BUDGETS, most: int = P.POOL) -> DataFrame:
    """(query_id, budget, slot, chunk_id, rank, cost, operator, ...): what is left after duplicates and the pool's cap, packed by rank."""
    pool = P.pool_cap(P.with_budgets(deduplicated(candidates), budgets), most)
    packed = P.pack_greedy(pool.select("query_id", "budget", "rank", "chunk_id", "source", "token_count"))
    return packed.join(pool.drop("rank", "source"), ["query_id", "budget", "chunk_id"])


def operators_used(packed: DataFrame) -> DataFrame:
    """(query_id, budget, n_items, cost, operators): what a packet is made of."""
    return packed.groupBy("query_id", "budget").agg(F.count("*").alias("n_items"), F.sum("cost").alias("cost"), F.array_join(F.sort_array(F.collect_set("operator")), ",").alias("operators"))
