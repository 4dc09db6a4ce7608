"""Queries over expansion, packing and what packets are worth, each with SQL for DuckDB where SQL can fold it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import packing as P
from quern.operators import retrieval as R
from quern.operators import structure as S
from quern.plans import core
from quern.plans.core import BM25, CHUNKS, COVERAGE, FACETS, FOLD, NODES, NORMAL, PATHS, QUESTIONS, TERMS, nodes, questions
from quern.runtime import discard, stored, table
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


# expansion


def _near(kind: str, penalty: float, heading: bool) -> str:
    same = " AND a.heading_path = b.heading_path" if heading else ""
    return f"""WITH {PATHS}, n AS (SELECT x.document_id, x.ordinal, x.kind, p.heading_path, row_number() OVER (PARTITION BY x.document_id ORDER BY x.ordinal) AS place FROM page_nodes x JOIN paths p ON p.document_id = x.document_id AND p.ordinal = x.ordinal WHERE x.content_layer = 'body')
SELECT a.document_id, a.ordinal AS anchor, b.ordinal AS neighbour, abs(a.place - b.place) AS distance, round(pow({penalty}, abs(a.place - b.place)), 6) AS penalty
FROM n a JOIN n b ON a.document_id = b.document_id AND b.place - a.place IN (-1, 1) WHERE a.kind = '{kind}' AND b.kind = '{kind}'{same}"""


def _with_paths(spark, sf_dir):
    n = trees.page_nodes(table(spark, sf_dir, "pages"))
    return n.join(trees.heading_paths(n), ["document_id", "ordinal"])


@query(_near("paragraph", S.SIBLING, True))
def sibling_expand(spark, sf_dir):
    """Paragraphs next to each paragraph under the same headings."""
    return S.neighbours(_with_paths(spark, sf_dir), "paragraph", 1, S.SIBLING, True)


UNITS = f"""{NODES}, units AS (SELECT 'chunk_' || sha256(concat_ws(chr(0), 'quern.chunk.page.v1', document_id, page)) AS chunk_id, document_id, page, string_agg(text, chr(10) ORDER BY ordinal) AS text, sum(token_count)::BIGINT AS token_count
  FROM nodes WHERE trim(text) <> '' GROUP BY document_id, page)"""
#: Questions meet pages of documents: BM25 with the same definition as over windows.
UNIT_BM25 = BM25.replace(CHUNKS, UNITS + ", chunks AS (SELECT * FROM units)")
PACK_LIMIT = 500
ANCHORS = 20
CANDIDATES = f"{UNIT_BM25}, candidates AS (SELECT b.query_id, b.rank, b.chunk_id, b.sparse, u.document_id, u.page, u.text, u.token_count, q.query FROM bm25 b JOIN units u USING (chunk_id) JOIN questions q USING (query_id) WHERE b.rank <= {PACK_LIMIT})"


def units(spark, sf_dir) -> DataFrame:
    """Pages of documents as units."""
    n = nodes(spark, sf_dir).where("trim(text) <> ''").groupBy("document_id", "page")
    n = n.agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"])).alias("text"), F.sum("token_count").alias("token_count"))
    return n.select(F.concat(F.lit("chunk_"), T.identity(F.lit("quern.chunk.page.v1"), F.col("document_id"), F.col("page"))).alias("chunk_id"), "*")


def candidates(spark, sf_dir) -> DataFrame:
    """The best pages of each question with their texts: stored, as packing and every metric read them again."""
    u, q = stored(units(spark, sf_dir), "units"), questions(spark, sf_dir)
    best = stored(R.bm25(u, q, PACK_LIMIT), "best")
    found = stored(u.join(R.small(best), "chunk_id").join(R.small(q), "query_id"), "candidates")
    discard(u)
    return found


@query(f"""WITH {CANDIDATES}, a AS (SELECT * FROM candidates WHERE rank <= {ANCHORS}),
n AS (SELECT a.query_id, u.chunk_id, abs(u.page - a.page) AS distance, a.rank AS anchor_rank, a.sparse FROM a JOIN units u ON u.document_id = a.document_id AND abs(u.page - a.page) <= 3 WHERE (a.query_id, u.chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM a)),
best AS (SELECT *, round(sparse * pow(0.8, greatest(distance, 1)), 6) AS score FROM n QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY distance, anchor_rank) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best) SELECT query_id, rank, chunk_id, distance, score FROM r WHERE rank <= 64""")
def page_neighbors(spark, sf_dir):
    """Pages near the twenty best of each question."""
    u = units(spark, sf_dir)
    anchors = candidates(spark, sf_dir).where(F.col("rank") <= ANCHORS).select("query_id", "rank", F.col("sparse").alias("score"), "document_id", "page", "chunk_id")
    return S.page_neighbours(anchors, u)


# packing


@query(f"WITH {CANDIDATES} SELECT query_id, rank, chunk_id FROM candidates QUALIFY row_number() OVER (PARTITION BY query_id, {NORMAL.format('text')} ORDER BY rank) = 1")
def dedupe_exact(spark, sf_dir):
    """Candidates without repeated texts."""
    return P.dedupe_exact(candidates(spark, sf_dir)).select("query_id", "rank", "chunk_id")


@query()
def dedupe_full(spark, sf_dir):
    """Candidates without repeated or contained texts."""
    c = candidates(spark, sf_dir).withColumn("page_start", F.col("page")).withColumn("page_end", F.col("page"))
    return P.dedupe_contained(c).select("query_id", "rank", "chunk_id")


BUDGETED = f"{CANDIDATES}, budgeted AS (SELECT *, unnest([2048, 4096, 8192, 16384])::BIGINT AS budget FROM candidates)"


@query(f"WITH {BUDGETED} SELECT query_id, budget, rank, chunk_id FROM (SELECT *, coalesce(sum(token_count + 3) OVER (PARTITION BY query_id, budget ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM budgeted) WHERE rank <= {P.POOL} OR b < budget * 1.5")
def pool_cap(spark, sf_dir):
    """The first 500 candidates, or one and a half budgets of them."""
    return P.pool_cap(P.with_budgets(candidates(spark, sf_dir)), multiple=1.5).select("query_id", "budget", "rank", "chunk_id")


def packed(spark, sf_dir, found: DataFrame | None = None) -> DataFrame:
    c = P.with_budgets(found if found is not None else candidates(spark, sf_dir)).withColumn("source", F.concat_ws("#", "document_id", F.col("page").cast("string")))
    return P.pack_greedy(c.select("query_id", "budget", "rank", "chunk_id", "source", "token_count"))


PACKED = f"""{BUDGETED},
fold AS (SELECT query_id, budget, 0::BIGINT AS rank, budget AS left_, 0::BIGINT AS slot, false AS taken FROM (SELECT DISTINCT query_id, budget FROM budgeted)
  UNION ALL SELECT f.query_id, f.budget, f.rank + 1, CASE WHEN c.token_count + 3 <= f.left_ THEN f.left_ - c.token_count - 3 ELSE f.left_ END, CASE WHEN c.token_count + 3 <= f.left_ THEN f.slot + 1 ELSE f.slot END, c.token_count + 3 <= f.left_
  FROM fold f JOIN budgeted c ON c.query_id = f.query_id AND c.budget = f.budget AND c.rank = f.rank + 1),
packed AS (SELECT f.query_id, f.budget, f.slot, c.chunk_id, f.rank, (c.token_count + 3)::BIGINT AS cost, c.token_count, c.text, c.document_id, c.page, c.query FROM fold f JOIN budgeted c ON c.query_id = f.query_id AND c.budget = f.budget AND c.rank = f.rank WHERE f.taken)"""


@query(f"WITH RECURSIVE {PACKED} SELECT query_id, budget, slot, chunk_id, rank, cost FROM packed")
def pack_greedy(spark, sf_dir):
    """Packets of four budgets, filled by rank."""
    return packed(spark, sf_dir)


def packed_texts(spark, sf_dir) -> DataFrame:
    found = candidates(spark, sf_dir)
    c = found.select("query_id", "chunk_id", "document_id", "page", "text", "token_count", "query")
    return packed(spark, sf_dir, found).join(c, ["query_id", "chunk_id"])


@query(f"""WITH RECURSIVE {PACKED} SELECT query_id, budget, sha256(string_agg('<evidence id="E' || slot || '">' || chr(10) || text || chr(10) || '</evidence>', chr(10) || chr(10) ORDER BY slot)) AS block_sha256, count(*) AS n_items FROM packed GROUP BY 1, 2""")
def render_block(spark, sf_dir):
    """Packets as one block of tagged items (its digest)."""
    return P.render(packed_texts(spark, sf_dir)).select("query_id", "budget", F.sha2("block", 256).alias("block_sha256"), "n_items")


@query(f"WITH RECURSIVE {PACKED} SELECT query_id, budget, count(*) AS n_items, sum(cost)::BIGINT AS cost, sum(token_count)::BIGINT AS token_count, sum(cost) <= budget AS fits FROM packed GROUP BY 1, 2")
def packet_invariants(spark, sf_dir):
    """Sums of each packet, and whether it is within its budget."""
    return packed_texts(spark, sf_dir).groupBy("query_id", "budget").agg(F.count("*").alias("n_items"), F.sum("cost").alias("cost"), F.sum("token_count").alias("token_count"), (F.sum("cost") <= F.col("budget")).alias("fits"))


# Fixed value: how tables are referred to.
REFERENCE = r"(?i)\bTable\s+[A-Z0-9]+(?:[.\-][A-Z0-9]+)+"


def coverable(spark, sf_dir) -> DataFrame:
    """Candidates with the arrays that coverage looks at."""
    c = candidates(spark, sf_dir)
    f = R.query_facets(questions(spark, sf_dir), P.FACETS, P.FACET_TERMS)
    facets = f.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("facet_no", T.coverage_terms(F.col("facet")).alias("t")))), lambda x: x["t"]).alias("facets"))
    refs = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0)), T.normal))
    return c.join(R.small(facets), "query_id", "left").select(
        "query_id", "rank", "chunk_id", "token_count", F.round(R.lexical(F.col("query"), F.col("text")), 6).alias("reranked"), F.lit(0).alias("tier"),
        T.coverage_terms(F.col("text")).alias("terms"), T.coverage_terms(F.col("query")).alias("query_terms"), F.coalesce("facets", F.array().cast("array<array<string>>")).alias("facets"),
        refs(F.col("text")).alias("references"), refs(F.col("query")).alias("query_references"), F.array(F.concat_ws("#", "document_id", F.col("page").cast("string"))).alias("page_keys"), F.lit("").alias("heading"),
    )


FACETS4 = FACETS.replace(">= 3)", ">= 2)").replace("facet_no <= 3", "facet_no <= 4")


@query(f"""WITH {CANDIDATES}, {FACETS4}, fa AS (SELECT query_id, list({COVERAGE.format('facet')}) AS fs FROM facets GROUP BY 1),
c AS (SELECT c.*, {COVERAGE.format('text')} AS terms, {COVERAGE.format('query')} AS qt, coalesce(fs, []) AS fs FROM candidates c LEFT JOIN fa USING (query_id))
SELECT query_id, chunk_id, round(8.0 * 0 + 6.0 * len(list_filter(fs, lambda f: len(f) > 0 AND len(list_intersect(f, terms)) / len(f) >= 0.5)) + 2.0 * len(list_intersect(terms, qt)) + 0.25 + 4.0 / rank, 6) AS gain FROM c""")
def coverage_step1_utility(spark, sf_dir):
    """What each candidate adds as a first choice."""
    return P.first_gain(coverable(spark, sf_dir))


@query()
def pack_coverage(spark, sf_dir):
    """Packets chosen by coverage."""
    return P.coverage(P.with_budgets(coverable(spark, sf_dir)))


@query()
def pack_adaptive(spark, sf_dir):
    """Packets chosen by coverage until breadth is exhausted, then by score."""
    return P.coverage(P.with_budgets(coverable(spark, sf_dir)), adaptive=True)


# metrics

GOLD = f"""gold AS (SELECT q.query_id, u.document_id, u.page FROM questions q JOIN units u ON len(trim(q.query)) > 0 AND contains({NORMAL.format('u.text')}, {NORMAL.format('q.query')}))"""
METRIC = f"{PACKED}, {GOLD}"


def gold(spark, sf_dir) -> DataFrame:
    """(query_id, document_id, page): pages that hold a question's whole text.

    Pages and questions meet by their first four words, so that only pages with those are searched.
    """
    q = questions(spark, sf_dir).withColumn("norm", T.normal(F.col("query"))).where("norm <> ''")
    gram = lambda words, k: F.concat_ws(" ", F.slice(words, k, 4))
    q = q.withColumn("w", F.split("norm", " "))
    # a question's first and last words may be part of longer ones on the page: its second to fifth words are whole
    long = q.where(F.size("w") >= 6).select("query_id", "norm", gram(F.col("w"), F.lit(2)).alias("key"))
    short = q.where(F.size("w") < 6).select("query_id", "norm")
    u = stored(units(spark, sf_dir).select("document_id", "page", T.normal(F.col("text")).alias("body")), "bodies")
    # only places and four words are exploded; the text is looked up again where they meet
    split = u.select("document_id", "page", F.split("body", " ").alias("w"))
    grams = split.select("document_id", "page", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda k: gram(F.col("w"), k))).alias("key"))
    met = stored(grams.join(R.small(long), "key").select("query_id", "norm", "document_id", "page").distinct(), "met")
    a = u.join(R.small(met), ["document_id", "page"]).where("contains(body, norm)").select("query_id", "document_id", "page")
    b = u.join(R.small(short), F.expr("contains(body, norm)")).select("query_id", "document_id", "page")
    found = stored(a.unionByName(b), "gold")
    discard(u)
    return found


@query(f"WITH {UNITS}, {QUESTIONS}, {GOLD} SELECT query_id, document_id, page FROM gold")
def gold_pages(spark, sf_dir):
    """Pages that hold a question's text."""
    return gold(spark, sf_dir)


CELLS = f"""{METRIC}, cells AS (SELECT q.query_id, b.budget FROM questions q, (SELECT unnest([2048, 4096, 8192, 16384])::BIGINT AS budget) b),
matched AS (SELECT p.query_id, p.budget, count(DISTINCT (g.document_id, g.page)) AS n FROM packed p JOIN gold g ON g.query_id = p.query_id AND g.document_id = p.document_id AND g.page = p.page GROUP BY 1, 2),
total AS (SELECT query_id, count(DISTINCT (document_id, page)) AS n FROM gold GROUP BY 1),
recall AS (SELECT c.query_id, c.budget, coalesce(t.n, 0) AS n_gold, coalesce(m.n, 0) AS n_found, CASE WHEN coalesce(t.n, 0) = 0 THEN 1.0 ELSE round(coalesce(m.n, 0) / t.n, 9) END::DOUBLE AS page_recall
  FROM cells c LEFT JOIN matched m USING (query_id, budget) LEFT JOIN total t USING (query_id))"""


def cells(spark, sf_dir) -> DataFrame:
    """(query_id, budget, n_gold, n_found, page_recall, full_coverage): no gold is a recall of 1."""
    g = gold(spark, sf_dir).distinct()
    p = packed_texts(spark, sf_dir).select("query_id", "budget", "document_id", "page").distinct()
    found = p.join(g, ["query_id", "document_id", "page"]).groupBy("query_id", "budget").agg(F.count("*").alias("n_found"))
    total = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    every = P.with_budgets(questions(spark, sf_dir).select("query_id"))
    out = every.join(found, ["query_id", "budget"], "left").join(total, "query_id", "left").na.fill(0, ["n_found", "n_gold"])
    recall = F.when(F.col("n_gold") == 0, 1.0).otherwise(F.round(F.col("n_found") / F.col("n_gold"), 9))
    return out.select("query_id", "budget", "n_gold", "n_found", recall.alias("page_recall")).withColumn("full_coverage", F.col("page_recall") >= 1.0)


@query(f"WITH RECURSIVE {CELLS} SELECT query_id, budget, n_gold, n_found, page_recall, page_recall >= 1.0 AS full_coverage FROM recall")
def page_recall(spark, sf_dir):
    """Share of gold pages in each packet."""
    return cells(spark, sf_dir)


@query(f"""WITH RECURSIVE {CELLS}, firsts AS (SELECT g.query_id, b.budget, g.document_id, g.page, (SELECT min(p.slot) FROM packed p WHERE p.query_id = g.query_id AND p.budget = b.budget AND p.document_id = g.document_id AND p.page = g.page) AS slot FROM gold g, (SELECT unnest([2048, 4096, 8192, 16384])::BIGINT AS budget) b),
need AS (SELECT query_id, budget, CASE WHEN count(*) = count(slot) THEN max(slot) END AS last FROM firsts GROUP BY 1, 2)
SELECT c.query_id, c.budget, CASE WHEN n.query_id IS NULL THEN 0 ELSE (SELECT sum(p.token_count) FROM packed p WHERE p.query_id = c.query_id AND p.budget = c.budget AND p.slot <= n.last) END::BIGINT AS tokens_to_full FROM cells c LEFT JOIN need n USING (query_id, budget)""")
def tokens_to_full(spark, sf_dir):
    """Content tokens up to the item that completes a question's gold pages; 0 without any, null if never."""
    p = packed_texts(spark, sf_dir).select("query_id", "budget", "slot", "document_id", "page", "token_count")
    running = p.withColumn("mass", F.sum("token_count").over(W.partitionBy("query_id", "budget").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)))
    g = P.with_budgets(gold(spark, sf_dir).distinct())
    met = g.join(running, ["query_id", "budget", "document_id", "page"], "left").groupBy("query_id", "budget", "document_id", "page").agg(F.min("mass").alias("mass"))
    need = met.groupBy("query_id", "budget").agg(F.when(F.count("*") == F.count("mass"), F.max("mass")).alias("mass"), F.lit(True).alias("any"))
    every = P.with_budgets(questions(spark, sf_dir).select("query_id"))
    return every.join(need, ["query_id", "budget"], "left").select("query_id", "budget", F.when(F.col("any").isNull(), F.lit(0).cast("long")).otherwise(F.col("mass")).alias("tokens_to_full"))


@query(f"""WITH RECURSIVE {PACKED}, t AS (SELECT query_id, budget, slot, {TERMS.format('text')} AS t FROM packed),
g AS (SELECT query_id, budget, slot, i, array_to_string(t[i:i + 3], ' ') AS gram FROM (SELECT query_id, budget, slot, t, unnest(range(1, len(t) - 2)) AS i FROM t WHERE len(t) >= 4)),
d AS (SELECT *, min(slot) OVER (PARTITION BY query_id, budget, gram) < slot AS again FROM g),
s AS (SELECT query_id, budget, count(DISTINCT (slot, i + k)) AS n FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM d WHERE again) GROUP BY 1, 2),
w AS (SELECT query_id, budget, sum(len(t)) AS n FROM t GROUP BY 1, 2) SELECT w.query_id, w.budget, CASE WHEN w.n = 0 THEN 0.0 ELSE round(coalesce(s.n, 0) / w.n, 9) END AS redundancy FROM w LEFT JOIN s USING (query_id, budget)""")
def redundancy(spark, sf_dir):
    """Share of a packet's term places in a run of four that an earlier item has."""
    t = packed_texts(spark, sf_dir).select("query_id", "budget", "slot", T.terms(F.col("text")).alias("t"))
    g = t.where("size(t) >= 4").select("query_id", "budget", "slot", F.posexplode(F.expr("transform(sequence(1, size(t) - 3), i -> concat_ws(' ', slice(t, i, 4)))")).alias("i", "gram"))
    again = g.withColumn("first", F.min("slot").over(W.partitionBy("query_id", "budget", "gram"))).where("first < slot")
    places = again.select("query_id", "budget", "slot", F.explode(F.array(*[F.col("i") + k for k in range(4)])).alias("i")).distinct().groupBy("query_id", "budget").agg(F.count("*").alias("n"))
    whole = t.groupBy("query_id", "budget").agg(F.sum(F.size("t")).alias("w"))
    return whole.join(places, ["query_id", "budget"], "left").select("query_id", "budget", F.when(F.col("w") == 0, 0.0).otherwise(F.round(F.coalesce("n", F.lit(0)) / F.col("w"), 9)).alias("redundancy"))


@query(f"""WITH RECURSIVE {PACKED}, ctx AS (SELECT query_id, budget, {NORMAL.format("string_agg(text, chr(10) ORDER BY slot)")} AS context FROM packed GROUP BY 1, 2)
SELECT c.query_id, c.budget, contains(context, {NORMAL.format('query')}) AS quote_found FROM ctx c JOIN questions q USING (query_id) WHERE len(trim(q.query)) > 0""")
def quote_recall(spark, sf_dir):
    """Whether a packet's content holds the question's text as a quote, by the quote's normal form."""
    p = packed_texts(spark, sf_dir).groupBy("query_id", "budget").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("slot", "text"))), lambda x: x["text"])).alias("context"))
    q = questions(spark, sf_dir).where("trim(query) <> ''")
    both = p.join(R.small(q), "query_id").select("query_id", "budget", T.quote_normal(F.col("query")).alias("quote"), T.quote_normal(F.col("context")).alias("context"))
    return both.select("query_id", "budget", T.quote_found(F.col("quote"), F.col("context")).alias("quote_found"))


# summaries


@query(f"WITH RECURSIVE {CELLS} SELECT budget, count(*) AS n, round(avg(page_recall), 9) AS mean_recall, round(median(page_recall), 9) AS median_recall, round(avg(CASE WHEN n_gold > 0 THEN page_recall END), 9) AS mean_recall_with_gold, count(*) FILTER (WHERE page_recall >= 1.0) AS n_full FROM recall GROUP BY 1")
def summary_by_budget(spark, sf_dir):
    """Means, medians and conditional means of recall by budget."""
    c = cells(spark, sf_dir)
    return c.groupBy("budget").agg(F.count("*").alias("n"), F.round(F.avg("page_recall"), 9).alias("mean_recall"), F.round(F.median("page_recall"), 9).alias("median_recall"), F.round(F.avg(F.when(F.col("n_gold") > 0, F.col("page_recall"))), 9).alias("mean_recall_with_gold"), F.count_if(F.col("full_coverage")).alias("n_full"))


@query(f"""WITH RECURSIVE {CELLS}, p AS (SELECT a.query_id, a.budget, a.page_recall - b.page_recall AS delta FROM recall a JOIN recall b ON b.query_id = a.query_id AND b.budget = 2048 WHERE a.budget > 2048)
SELECT budget, count(*) AS n, round(avg(delta), 9) AS mean_delta, round(avg(delta), 9) > -0.03 AS not_inferior, count(*) >= 34 AS enough FROM p GROUP BY 1""")
def paired_deltas(spark, sf_dir):
    """Recall of larger budgets less that of the smallest, question by question, and whether it is not inferior by 0.03."""
    c = cells(spark, sf_dir)
    base = c.where("budget = 2048").select("query_id", F.col("page_recall").alias("base"))
    d = c.where("budget > 2048").join(base, "query_id").withColumn("delta", F.col("page_recall") - F.col("base"))
    return d.groupBy("budget").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 9).alias("mean_delta")).select("budget", "n", "mean_delta", (F.col("mean_delta") > -0.03).alias("not_inferior"), (F.col("n") >= 34).alias("enough"))
