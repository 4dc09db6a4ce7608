"""Ranking: BM25, hashed and given vectors, rank fusion, trims, lexical reranking, facets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import scoring

K1, B = 1.5, 0.75
RRF = 60
#: Places of hashed vectors.
DIMENSIONS = 256
#: Rows that every sort key's score is rounded to, so that the order of additions can't change a rank.
DIGITS = 6
#: A query side of at most so many rows is broadcast.
QUERY_ROWS = 200_000
# Clause boundaries and openings that facets leave out.
CLAUSE = r"(?i)\s*(?:[,;]|\b(?:and|versus|vs\.?|while|whereas)\b)\s*"
SCAFFOLD = r"(?i)^(?:(?:across|using|within|from|in|according to|based on)\s+|(?:which|what|where|when|how|does|do|is|are)\s+)"


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most QUERY_ROWS rows; as it is beyond."""
    return F.broadcast(df) if df.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS else df


def ranked(df: DataFrame, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long"))


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, length)."""
    t = chunks.select("chunk_id", T.terms(F.col("text")).alias("t"))
    return t.select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("chunk_id", "term", "length").agg(F.count("*").alias("tf"))


def bm25_stats(chunks: DataFrame) -> DataFrame:
    """(term, df, idf) over all chunks."""
    n = chunks.agg(F.count("*").alias("n"))
    df = chunks.select(F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def few(queries: DataFrame) -> bool:
    """Whether so few queries are asked that their words can be gathered: then a task ranks all of its chunks, and pairs never move."""
    return queries.limit(QUERY_ROWS // 100 + 1).count() <= QUERY_ROWS // 100


def rankings(chunks: DataFrame, queries: DataFrame, limit: int, which: tuple[str, ...] = ("bm25", "dense")) -> list[DataFrame]:
    """bm25() and dense() of the same chunks: one pass over texts for both."""
    if not few(queries):
        return [{"bm25": bm25, "dense": dense}[w](chunks, queries, limit) for w in which]
    out = []
    for w, scored in zip(which, scoring.rankings(chunks, queries, limit, DIMENSIONS, K1, B, which), strict=True):
        name = {"bm25": "sparse", "dense": "dense"}[w]
        out.append(ranked(scored.withColumnRenamed("score", name), F.desc(name), F.col("chunk_id")).where(F.col("rank") <= limit))
    return out


def bm25(chunks: DataFrame, queries: DataFrame, limit: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, sparse): statistics over all chunks; repeated query terms count repeatedly; positive scores only.

    With scope (query_id, document_id), a query's chunks are those of its documents; statistics stay those of all. Few queries are ranked inside tasks (scoring); else chunks' terms meet the query's terms before any shuffle, so that postings of other terms never move.
    """
    if scope is None and few(queries):
        return rankings(chunks, queries, limit, ("bm25",))[0]
    asked = scoring.asked(queries)
    vocabulary = asked.select("term").distinct()
    own = ["document_id"] if scope is not None else []
    sized = chunks.select("chunk_id", *own, T.terms(F.col("text")).alias("t"))
    whole = sized.agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("t")), F.lit(1.0)).alias("average"))
    near = F.broadcast if few(queries) else (lambda df: df)
    posted = sized.select("chunk_id", *own, F.size("t").alias("length"), F.explode("t").alias("term")).join(near(vocabulary), "term", "left_semi").groupBy("chunk_id", *own, "term", "length").agg(F.count("*").alias("tf"))
    # a term's weight in a chunk doesn't depend on the query, so it is worked out once
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    weighed = posted.join(near(df), "term").join(F.broadcast(whole)).select("chunk_id", *own, "term", weight.alias("w"))
    if scope is not None:  # terms of a query meet those of its documents only
        asked = asked.join(scope.select("query_id", "document_id").distinct(), "query_id")
    scored = weighed.join(near(asked) if scope is None else asked, ["term", *own]).groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), DIGITS).alias("sparse")).where("sparse > 0")
    return ranked(scored, F.desc("sparse"), F.col("chunk_id")).where(F.col("rank") <= limit)


def hash_vectors(texts: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, bucket, weight): each term adds or takes one at a bucket of its SHA-256; rows of length one. Sparse."""
    h = texts.select(key, F.explode(T.terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c")).withColumn("h", F.sha2("term", 256))
    bucket = (F.conv(F.substring("h", 9, 8), 16, 10).cast("long") % dimensions).alias("bucket")
    sign = F.when(F.conv(F.substring("h", 17, 2), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    summed = h.select(key, bucket, (sign * F.col("c")).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(key)).cast("double"))
    return summed.select(key, "bucket", (F.col("v") / norm).alias("weight"))


def dense(chunks: DataFrame, queries: DataFrame, limit: int, dimensions: int = DIMENSIONS) -> DataFrame:
    """(query_id, rank, chunk_id, dense) by cosine of hashed vectors, positive only."""
    if dimensions == DIMENSIONS and few(queries):
        return rankings(chunks, queries, limit, ("dense",))[0]
    q = small(hash_vectors(queries, "query_id", "query", dimensions).withColumnRenamed("weight", "qw"))
    c = hash_vectors(chunks, "chunk_id", "text", dimensions)
    scored = c.join(q, "bucket").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), DIGITS).alias("dense")).where("dense > 0")
    return ranked(scored, F.desc("dense"), F.col("chunk_id")).where(F.col("rank") <= limit)


def fused(rankings: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, fused) by reciprocal ranks over the rankings in which a chunk is."""
    weights = weights or [1.0] * len(rankings)
    parts = [r.select("query_id", "chunk_id", (F.lit(w) / (RRF + F.col("rank"))).alias("s")) for r, w in zip(rankings, weights, strict=True)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    summed = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 9).alias("fused"))
    return ranked(summed, F.desc("fused"), F.col("chunk_id"))


def trim(hits: DataFrame, least: int, target: float, most: int | None = None) -> DataFrame:
    """The prefix by rank until it has `least` rows and `target` tokens, counting the row that gets there; at most `most` rows."""
    before = F.coalesce(F.sum("token_count").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = hits.withColumn("_before", before).where((F.col("rank") - 1 < least) | (F.col("_before") < target))
    return (kept.where(F.col("rank") <= most) if most else kept).drop("_before")


def unique_text(hits: DataFrame) -> DataFrame:
    """The best ranked of the hits of a query whose texts are the same but for case and white space."""
    order = W.partitionBy("query_id", T.normal(F.col("text"))).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def lexical(query: Column, text: Column) -> Column:
    """Share of a query's different terms that a text has."""
    q = F.array_distinct(T.terms(query))
    return F.size(F.array_intersect(q, T.terms(text))) / F.greatest(F.size(q), F.lit(1))


def reranked(hits: DataFrame) -> DataFrame:
    """hits (query_id, query, chunk_id, text, fused) by lexical score, then fused score, then id."""
    return ranked(hits.withColumn("reranked", F.round(lexical(F.col("query"), F.col("text")), DIGITS)), F.desc("reranked"), F.desc("fused"), F.col("chunk_id"))


def query_facets(queries: DataFrame, limit: int = 3, min_terms: int = 3) -> DataFrame:
    """(query_id, facet_no, facet): bounded clauses of a query in source order, without repeats or the whole query."""
    q = queries.select("query_id", T.collapsed(F.col("query")).alias("q"))
    parts = q.select("query_id", "q", F.posexplode(F.split("q", CLAUSE)).alias("pos", "raw"))
    parts = parts.withColumn("facet", F.btrim(F.regexp_replace("raw", SCAFFOLD, ""), F.lit(" .?!,:;-"))).withColumn("key", T.fold(F.col("facet")))
    long = F.size(F.regexp_extract_all("facet", F.lit(r"(?U)\w[\w.-]*"), F.lit(0))) >= min_terms
    fresh = parts.where(long & (F.col("key") != F.rtrim(T.fold(F.col("q")), F.lit("?.!"))))
    first = fresh.withColumn("n", F.row_number().over(W.partitionBy("query_id", "key").orderBy("pos"))).where("n = 1")
    out = first.withColumn("facet_no", F.row_number().over(W.partitionBy("query_id").orderBy("pos")).cast("long"))
    return out.where(F.col("facet_no") <= limit).select("query_id", "facet_no", "facet")


def cosine_pairs(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, vec_id, score): brute force of a stated query set against all rows, positive only.

    Every pair is scored, as products of blocks of both sides; only a task's best of each query leave it. Queries go in blocks of scoring.BLOCK,
    each of which meets all vectors: memory doesn't grow with either side, and work with their product.
    """
    scored = scoring.cosines(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), queries.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), limit)
    return ranked(scored, F.desc("score"), F.col("vec_id")).where(F.col("rank") <= limit)


def python_round(x: float) -> int:
    """Half to even, as token targets are."""
    return int(round(x)) if math.isfinite(x) else 0
