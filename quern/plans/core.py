"""Queries over nodes, chunks and rankings, each with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunks as C
from quern.operators import retrieval as R
from quern.runtime import stored, table
from quern.sources import trees

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# What oracles share: the same definitions in DuckDB's terms.
FOLD = "replace(lower({0}), 'ß', 'ss')"
TERMS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"
DOTTED = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}\\p{{M}}_][\\p{{L}}\\p{{N}}\\p{{M}}_.-]*')"
WORDS = "len(regexp_extract_all(coalesce({0}, ''), '\\S+'))"
NORMAL = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
STOPWORDS = "[" + ", ".join(f"'{w}'" for w in T.COVERAGE_STOPWORDS) + "]"
COVERAGE = "list_filter(list_distinct(" + DOTTED + "), lambda x: NOT list_contains(" + STOPWORDS.replace("{", "{{").replace("}", "}}") + ", x))"

NODES = f"""
lines AS (SELECT 'documents/' || doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ordinal FROM documents),
nodes AS (SELECT document_id, 'node_' || sha256(concat_ws(chr(0), 'quern.node.v1', document_id, ordinal, text)) AS node_id, ordinal::BIGINT AS ordinal,
                 CASE WHEN regexp_matches(text, '\\|.*\\|') THEN 'table' WHEN regexp_matches(text, '^\\s*[-*] ') THEN 'list_item' ELSE 'paragraph' END AS kind,
                 'body' AS content_layer, text, (ordinal // {trees.LINES_PER_PAGE} + 1)::BIGINT AS page, {WORDS.format('text')}::BIGINT AS token_count FROM lines)"""

PAGE_NODES = """
bodies AS (SELECT 'pages/' || page_id AS document_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<(script|style)[^>]*>[^<]*</(script|style)>', '', 'g'), '(?s)<!--[^>]*-->', '', 'g') AS body FROM pages),
tags AS (SELECT document_id, regexp_extract_all(body, '<(title|h1|h2|h3|p|li|footer|nav|div|td|th)\\b[^>]*>([^<]*)', 1) AS t, regexp_extract_all(body, '<(title|h1|h2|h3|p|li|footer|nav|div|td|th)\\b[^>]*>([^<]*)', 2) AS r FROM bodies),
raws AS (SELECT document_id, unnest(t) AS tag, unnest(r) AS raw, generate_subscripts(t, 1) AS spot FROM tags),
found AS (SELECT document_id, spot, tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM raws),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY spot) - 1 AS ordinal FROM found WHERE text <> ''),
page_nodes AS (SELECT document_id, 'node_' || sha256(concat_ws(chr(0), 'quern.node.v1', document_id, ordinal, text)) AS node_id, ordinal::BIGINT AS ordinal,
  CASE tag WHEN 'title' THEN 'title' WHEN 'h1' THEN 'title' WHEN 'h2' THEN 'heading' WHEN 'h3' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list_item' ELSE 'other' END AS kind,
  CASE WHEN tag IN ('footer', 'nav', 'div', 'title') THEN 'furniture' ELSE 'body' END AS content_layer, text, 1::BIGINT AS page, len(regexp_extract_all(text, '\\S+'))::BIGINT AS token_count, CASE tag WHEN 'title' THEN 0 WHEN 'h1' THEN 0 WHEN 'h2' THEN 1 WHEN 'h3' THEN 2 END::BIGINT AS level FROM numbered)"""

CHUNKS = f"""{NODES},
bodies_ AS (SELECT document_id, regexp_extract_all(string_agg(text, chr(10) ORDER BY ordinal), '\\S+') AS t FROM nodes WHERE trim(text) <> '' GROUP BY 1),
chunks AS (SELECT 'chunk_' || sha256(concat_ws(chr(0), 'quern.chunk.fixed.v1', document_id, ordinal, text)) AS chunk_id, document_id, ordinal, text, token_count FROM (
  SELECT document_id, w::BIGINT AS ordinal, array_to_string(t[w * 448 + 1 : w * 448 + 512], ' ') AS text, len(t[w * 448 + 1 : w * 448 + 512])::BIGINT AS token_count
  FROM (SELECT document_id, t, unnest(generate_series(0, greatest(0, ceil((len(t) - 512) / 448.0))::BIGINT)) AS w FROM bodies_)))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.document_nodes(table(spark, sf_dir, "documents"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_chunks(nodes(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


QUESTIONS = "questions AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark)"


# nodes


@query(f"WITH {NODES} SELECT document_id, node_id, ordinal, kind, content_layer, text, page, token_count FROM nodes")
def nodes_documents(spark, sf_dir):
    """Lines of documents as typed nodes."""
    return nodes(spark, sf_dir)


@query(f"WITH {PAGE_NODES} SELECT document_id, node_id, ordinal, kind, content_layer, text, page, token_count, level FROM page_nodes")
def nodes_pages(spark, sf_dir):
    """Text of HTML pages as typed nodes, furniture apart."""
    return trees.page_nodes(table(spark, sf_dir, "pages"))


@query(f"""WITH t AS (SELECT 'conversations/' || conv_id AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ordinal, coalesce(text, '') AS text FROM conversations)
SELECT document_id, 'node_' || sha256(concat_ws(chr(0), 'quern.node.v1', document_id, ordinal, text)) AS node_id, ordinal::BIGINT AS ordinal, 'paragraph' AS kind, 'body' AS content_layer, text, 1::BIGINT AS page, {WORDS.format('text')}::BIGINT AS token_count FROM t""")
def nodes_conversations(spark, sf_dir):
    """Turns of conversations as nodes."""
    return trees.conversation_nodes(table(spark, sf_dir, "conversations"))


@query(f"WITH {NODES}, {PAGE_NODES}, every AS (SELECT * FROM nodes UNION ALL BY NAME SELECT * FROM page_nodes) SELECT document_id, count(*) AS n_nodes, count(*) FILTER (WHERE kind IN ('title', 'heading')) AS n_headings, count(*) FILTER (WHERE kind = 'table') AS n_tables, count(DISTINCT page) AS n_pages, sum(token_count)::BIGINT AS n_tokens FROM every GROUP BY 1")
def node_kind_counts(spark, sf_dir):
    """Counts of nodes, headings, tables, pages and tokens of each document."""
    every = nodes(spark, sf_dir).unionByName(trees.page_nodes(table(spark, sf_dir, "pages")), allowMissingColumns=True)
    return every.groupBy("document_id").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("kind").isin("title", "heading")).alias("n_headings"), F.count_if(F.col("kind") == "table").alias("n_tables"),
        F.countDistinct("page").alias("n_pages"), F.sum("token_count").alias("n_tokens"),
    )


PATHS = f"""{PAGE_NODES},
heads AS (SELECT document_id, ordinal AS start, CASE kind WHEN 'title' THEN 0 ELSE level END AS level, trim(text) AS head FROM page_nodes WHERE content_layer = 'body' AND (kind = 'title' OR (kind = 'heading' AND trim(text) <> ''))),
scopes AS (SELECT a.*, coalesce((SELECT min(b.start) FROM heads b WHERE b.document_id = a.document_id AND b.start > a.start AND b.level <= a.level), 1099511627776) AS stop FROM heads a),
paths AS (SELECT n.document_id, n.ordinal, coalesce(list(s.head ORDER BY s.level, s.start) FILTER (WHERE s.head <> ''), []) AS heading_path
  FROM page_nodes n LEFT JOIN scopes s ON n.content_layer = 'body' AND s.document_id = n.document_id AND n.ordinal >= s.start AND n.ordinal < s.stop GROUP BY 1, 2)"""


@query(f"WITH {PATHS} SELECT document_id, ordinal, array_to_string(heading_path, ' > ') AS heading_path, len(heading_path)::BIGINT AS depth FROM paths")
def heading_paths(spark, sf_dir):
    """Headings above each node of a page, by scopes joined on ranges."""
    found = trees.heading_paths(trees.page_nodes(table(spark, sf_dir, "pages")))
    return found.select("document_id", "ordinal", F.concat_ws(" > ", "heading_path").alias("heading_path"), F.size("heading_path").cast("long").alias("depth"))


@query(f"""WITH {NODES}, f AS (SELECT document_id, count(*) AS n, count(DISTINCT node_id) AS ids, min(ordinal) AS low, max(ordinal) AS high, count(*) FILTER (WHERE token_count < 0 OR page < 1) AS bad FROM nodes GROUP BY 1)
SELECT document_id, n AS n_nodes, (n <> ids) AS repeated_ids, (low <> 0 OR high <> n - 1) AS gaps, (bad > 0) AS bad_values FROM f""")
def graph_violations(spark, sf_dir):
    """What breaks a document's graph: repeated ids, gaps in ordinals, impossible values."""
    f = nodes(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n_nodes"), F.countDistinct("node_id").alias("ids"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count_if(F.expr("token_count < 0 OR page < 1")).alias("bad"))
    return f.select("document_id", "n_nodes", (F.col("n_nodes") != F.col("ids")).alias("repeated_ids"), ((F.col("low") != 0) | (F.col("high") != F.col("n_nodes") - 1)).alias("gaps"), (F.col("bad") > 0).alias("bad_values"))


# chunks


@query(f"WITH {NODES} SELECT 'chunk_' || sha256(concat_ws(chr(0), 'quern.chunk.node.v1', document_id, node_id, text)) AS chunk_id, document_id, ordinal, node_id, kind, text, token_count, page FROM nodes WHERE trim(text) <> ''")
def chunks_node(spark, sf_dir):
    """One unit for each body node with text."""
    return C.node_chunks(nodes(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT chunk_id, document_id, ordinal, text, token_count FROM chunks")
def chunks_fixed(spark, sf_dir):
    """Overlapping windows of tokens."""
    return windows(spark, sf_dir)


@query(f"WITH {NODES} SELECT document_id, ordinal, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS place, trim(text) AS text, token_count FROM nodes WHERE trim(text) <> ''")
def chunks_long_context(spark, sf_dir):
    """Body text in source order."""
    return C.long_context_chunks(nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE {NODES}, n AS (SELECT document_id, ordinal, kind, page, token_count, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS k FROM nodes WHERE trim(text) <> ''),
f AS (SELECT document_id, k, ordinal, ordinal AS unit, token_count AS tokens, page, kind IN ('paragraph', 'list_item') AND token_count < 64 AS open FROM n WHERE k = 1
  UNION ALL
  SELECT n.document_id, n.k, n.ordinal, CASE WHEN j THEN f.unit ELSE n.ordinal END, CASE WHEN j THEN f.tokens + n.token_count ELSE n.token_count END, CASE WHEN j THEN f.page ELSE n.page END, CASE WHEN j THEN true ELSE n.kind IN ('paragraph', 'list_item') AND n.token_count < 64 END
  FROM f JOIN n ON n.document_id = f.document_id AND n.k = f.k + 1,
  LATERAL (SELECT f.open AND n.kind IN ('paragraph', 'list_item') AND n.token_count < 64 AND f.page = n.page AND f.tokens < 128 AND f.tokens + n.token_count <= 256 AS j))
SELECT f.document_id, f.unit, count(*) AS n_nodes, string_agg(nodes.text, chr(10) ORDER BY f.ordinal) AS text, sum(nodes.token_count)::BIGINT AS token_count, min(nodes.page) AS page_start, max(nodes.page) AS page_end
FROM f JOIN nodes ON nodes.document_id = f.document_id AND nodes.ordinal = f.ordinal GROUP BY 1, 2""")
def chunks_merged(spark, sf_dir):
    """Small neighbours joined by a fold."""
    return C.merged_chunks(nodes(spark, sf_dir))


@query(f"""WITH {PATHS}, b AS (SELECT n.document_id, n.ordinal, n.text, p.heading_path FROM page_nodes n JOIN paths p ON p.document_id = n.document_id AND p.ordinal = n.ordinal WHERE n.content_layer = 'body'),
t AS (SELECT *, CASE WHEN len(heading_path) > 0 AND {FOLD.format('heading_path[-1]')} = {FOLD.format('text')} THEN heading_path[1:len(heading_path) - 1] ELSE heading_path END AS trail FROM b)
SELECT document_id, ordinal, CASE WHEN len(trail) > 0 THEN array_to_string(list_append(trail, text), chr(10)) ELSE text END AS search_text FROM t""")
def search_text(spark, sf_dir):
    """Headings above the text that is searched."""
    n = trees.page_nodes(table(spark, sf_dir, "pages"))
    both = n.where("content_layer = 'body'").join(trees.heading_paths(n), ["document_id", "ordinal"])
    return C.search_text(both).select("document_id", "ordinal", "search_text")


# retrieval

POSTED = f"""{CHUNKS}, {QUESTIONS},
sized AS (SELECT chunk_id, {TERMS.format('text')} AS t FROM chunks), whole AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS average FROM sized),
posted AS (SELECT chunk_id, len(t) AS length, term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM sized) GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY 1)"""
BM25 = f"""{POSTED}, asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TERMS.format('query')}) AS term FROM questions) GROUP BY 1, 2),
b AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 6) AS sparse FROM posted JOIN dfs USING (term) JOIN asked USING (term), whole GROUP BY 1, 2),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, chunk_id) AS rank FROM b WHERE sparse > 0)"""
HASHED = """(SELECT {0}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {0})) AS w FROM (
  SELECT {0}, ('0x' || substr(sha256(term), 9, 8))::BIGINT % 256 AS bucket, sum(CASE WHEN ('0x' || substr(sha256(term), 17, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END * c) AS v
  FROM (SELECT {0}, term, count(*) AS c FROM (SELECT {0}, unnest({1}) AS term FROM {2}) GROUP BY 1, 2) GROUP BY 1, 2) WHERE v <> 0)"""
DENSE = f"""qv AS {HASHED.format('query_id', TERMS.format('query'), 'questions')}, cv AS {HASHED.format('chunk_id', TERMS.format('text'), 'chunks')},
d AS (SELECT query_id, chunk_id, round(sum(qv.w * cv.w), 6) AS dense FROM cv JOIN qv USING (bucket) GROUP BY 1, 2),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS rank FROM d WHERE dense > 0)"""
#: Hits of each ranking that are fused where a budget is given.
CHANNEL = 500
FUSED = f"""{BM25}, {DENSE}, s AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS s FROM bm25 WHERE rank <= {CHANNEL} UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM dense WHERE rank <= {CHANNEL}),
u AS (SELECT query_id, chunk_id, round(sum(s), 9) AS fused FROM s GROUP BY 1, 2), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM u)"""


@query(f"WITH {POSTED} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, whole")
def bm25_stats(spark, sf_dir):
    """Document frequency and weight of every term."""
    return R.bm25_stats(windows(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {BM25} SELECT query_id, rank, chunk_id, sparse FROM bm25 WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    """The 20 best windows of each question by BM25."""
    return R.bm25(windows(spark, sf_dir), questions(spark, sf_dir), 20).select("query_id", "rank", "chunk_id", "sparse")


@query(f"WITH {QUESTIONS} SELECT query_id, bucket, round(w, 9) AS weight FROM {HASHED.format('query_id', TERMS.format('query'), 'questions')}")
def hash_embedding(spark, sf_dir):
    """Hashed vectors of questions."""
    return R.hash_vectors(questions(spark, sf_dir), "query_id", "query").withColumn("weight", F.round("weight", 9))


@query(f"WITH {CHUNKS}, {QUESTIONS}, {DENSE} SELECT query_id, rank, chunk_id, dense FROM dense WHERE rank <= 20")
def dense_topk(spark, sf_dir):
    """The 20 best windows of each question by hashed vectors."""
    return R.dense(windows(spark, sf_dir), questions(spark, sf_dir), 20).select("query_id", "rank", "chunk_id", "dense")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def vector_topk(spark, sf_dir):
    """The 10 nearest given vectors of every vector whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    return R.cosine_pairs(v, v.where("vec_id % 100 = 0"), 10).select("query_id", "rank", "vec_id", "score")


def fusion(chunks: DataFrame, spark, sf_dir) -> DataFrame:
    """Both rankings of chunks fused: one pass over their texts."""
    return R.fused(R.rankings(chunks, questions(spark, sf_dir), CHANNEL))


@query(f"WITH {FUSED} SELECT query_id, rank, chunk_id, fused FROM fused")
def rrf_fusion(spark, sf_dir):
    """Reciprocal rank fusion of both rankings."""
    return fusion(windows(spark, sf_dir), spark, sf_dir).select("query_id", "rank", "chunk_id", "fused")


def trimmed(spark, sf_dir) -> DataFrame:
    """Hits of both rankings: at least 40 and three times 2,048 tokens; with texts, which meet only what is left."""
    c = stored(windows(spark, sf_dir), "windows")
    found = stored(fusion(c, spark, sf_dir), "fused")
    sized = c.select("chunk_id", "token_count").join(R.small(found), "chunk_id")
    kept = stored(R.trim(sized, 40, R.python_round(2048 * 3.0)).drop("token_count"), "trimmed")
    return c.select("chunk_id", "document_id", "text", "token_count").join(R.small(kept), "chunk_id").join(R.small(questions(spark, sf_dir)), "query_id")


HITS = f"{FUSED}, hits AS (SELECT f.query_id, f.rank, f.chunk_id, f.fused, c.document_id, c.text, c.token_count, q.query FROM fused f JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id))"
BEFORE = "coalesce(sum(token_count) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass_before"
TRIMMED = f"{HITS}, trimmed AS (SELECT * FROM (SELECT *, {BEFORE} FROM hits) WHERE rank - 1 < 40 OR mass_before < 6144)"
UNIQUE = f"{TRIMMED}, uniq AS (SELECT * EXCLUDE (mass_before) FROM trimmed QUALIFY row_number() OVER (PARTITION BY query_id, {NORMAL.format('text')} ORDER BY rank) = 1)"
POOL = f"{UNIQUE}, pool AS (SELECT * FROM (SELECT *, {BEFORE} FROM uniq) WHERE (rank - 1 < 20 OR mass_before < 4096) AND rank <= 250)"
LEXICAL = f"len(list_intersect(list_distinct({TERMS.format('query')}), {TERMS.format('text')})) / greatest(len(list_distinct({TERMS.format('query')})), 1)"
RERANKED = f"{POOL}, scored AS (SELECT *, round({LEXICAL}, 6) AS reranked FROM pool), reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, fused DESC, chunk_id) AS new_rank FROM scored)"


@query(f"WITH {TRIMMED} SELECT query_id, rank, chunk_id, token_count FROM trimmed")
def hit_trim(spark, sf_dir):
    """At least 40 hits and three times 2,048 tokens."""
    return trimmed(spark, sf_dir).select("query_id", "rank", "chunk_id", "token_count")


@query(f"WITH {UNIQUE} SELECT query_id, rank, chunk_id FROM uniq")
def unique_search_text(spark, sf_dir):
    """Hits without those whose text a better one has."""
    return R.unique_text(trimmed(spark, sf_dir)).select("query_id", "rank", "chunk_id")


def pool(spark, sf_dir):
    return R.trim(R.unique_text(trimmed(spark, sf_dir)), 20, R.python_round(2048 * 2.0), 250)


@query(f"WITH {POOL} SELECT query_id, rank, chunk_id FROM pool")
def rerank_pool(spark, sf_dir):
    """What is reranked: at least 20 and twice 2,048 tokens, at most 250."""
    return pool(spark, sf_dir).select("query_id", "rank", "chunk_id")


@query(f"WITH {RERANKED} SELECT query_id, new_rank AS rank, chunk_id, reranked, fused FROM reranked")
def retrieve_hybrid(spark, sf_dir):
    """The whole retrieval: both rankings, fusion, trims, lexical reranking."""
    return R.reranked(pool(spark, sf_dir)).select("query_id", "rank", "chunk_id", "reranked", "fused")


CLAUSE = "(?i)\\s*(?:[,;]|\\b(?:and|versus|vs\\.?|while|whereas)\\b)\\s*"
FACETS = f"""q_ AS (SELECT query_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS q FROM questions),
parts AS (SELECT query_id, q, unnest(regexp_split_to_array(q, '{CLAUSE}')) AS raw, generate_subscripts(regexp_split_to_array(q, '{CLAUSE}'), 1) AS pos FROM q_),
f_ AS (SELECT *, trim(regexp_replace(raw, '(?i)^(?:(?:across|using|within|from|in|according to|based on)\\s+|(?:which|what|where|when|how|does|do|is|are)\\s+)', ''), ' .?!,:;-') AS facet FROM parts),
g_ AS (SELECT *, {FOLD.format('facet')} AS key FROM f_ WHERE len(regexp_extract_all(facet, '[\\p{{L}}\\p{{N}}\\p{{M}}_][\\p{{L}}\\p{{N}}\\p{{M}}_.-]*')) >= 3),
h_ AS (SELECT * FROM g_ WHERE key <> rtrim({FOLD.format('q')}, '?.!') QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY pos) = 1),
facets AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS facet_no, facet FROM h_ QUALIFY facet_no <= 3)"""


@query(f"WITH {QUESTIONS}, {FACETS} SELECT query_id, facet_no, facet FROM facets")
def query_facets(spark, sf_dir):
    """Clauses of questions."""
    return R.query_facets(questions(spark, sf_dir))


def asked_facets(spark, sf_dir):
    """Questions and their facets as questions of one list: (query_id of the list, question, facet_no, query)."""
    q = questions(spark, sf_dir)
    facets = R.query_facets(q).select(F.col("query_id").alias("question"), "facet_no", F.col("facet").alias("query"))
    every = q.select(F.col("query_id").alias("question"), F.lit(0).cast("long").alias("facet_no"), "query").unionByName(facets)
    return every.withColumn("query_id", F.col("question") * 10 + F.col("facet_no"))


@query(f"""WITH base AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark), {FACETS.replace('FROM questions', 'FROM base')},
{CHUNKS}, questions AS (SELECT query_id * 10 AS query_id, query FROM base UNION ALL SELECT query_id * 10 + facet_no, facet FROM facets), {BM25.split('questions AS (SELECT item_id AS query_id, coalesce(text, ' + "''" + ') AS query FROM benchmark),')[1]},
w AS (SELECT query_id // 10 AS query_id, chunk_id, rank, (CASE query_id % 10 WHEN 0 THEN 2.0 ELSE 1.0 END)::DOUBLE / (60 + rank) AS s FROM bm25 WHERE rank <= {CHANNEL}),
u AS (SELECT query_id, chunk_id, round(sum(s), 9) AS fused, min(rank) AS best_rank FROM w GROUP BY 1, 2), c AS (SELECT query_id // 10 AS query_id, count(*) AS n FROM bm25 WHERE rank <= {CHANNEL} AND query_id % 10 = 0 GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, best_rank, chunk_id) AS rank FROM u) SELECT r.query_id, r.rank, r.chunk_id, r.fused, r.best_rank FROM r JOIN c USING (query_id) WHERE r.rank <= c.n""")
def faceted_fusion(spark, sf_dir):
    """Rankings of a question (weight 2) and of its facets (weight 1) fused and cut to the length of the question's."""
    every = asked_facets(spark, sf_dir)
    found = R.bm25(windows(spark, sf_dir), every.select("query_id", "query"), CHANNEL)
    of = found.select(F.floor(F.col("query_id") / 10).cast("long").alias("query_id"), (F.col("query_id") % 10 == 0).alias("whole"), "chunk_id", "rank")
    s = F.when(F.col("whole"), 2.0).otherwise(1.0) / (R.RRF + F.col("rank"))
    n = of.groupBy("query_id").agg(F.count_if(F.col("whole")).alias("n"))
    summed = of.groupBy("query_id", "chunk_id").agg(F.round(F.sum(s), 9).alias("fused"), F.min("rank").alias("best_rank"))
    out = R.ranked(summed, F.desc("fused"), F.col("best_rank"), F.col("chunk_id"))
    return out.join(n, "query_id").where("rank <= n").select("query_id", "rank", "chunk_id", "fused", "best_rank")
