"""Queries over answers: what a provider might reply to questions on orders, in every form that the contract knows, and what that is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import answers as A
from quern.operators import compiling as K
from quern.operators import generation as G
from quern.operators import structure as S
from quern.plans import catalog
from quern.plans.catalog import CATALOG
from quern.plans.core import FOLD
from quern.runtime import table
from quern.sources import graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_JSON = """'{"answer": " ' || said || ' ", "citations": ["E1", "E' || (2 + o_orderkey % 4) || '"]}'"""
#: Forms of a response by the order's key, and what the contract makes of each: (response, answer, citations, valid); the texts read alike in both engines.
FORMS = (
    (_JSON, "said", True),
    (f"'```json' || chr(10) || {_JSON} || chr(10) || '```'", "said", True),
    ("'  insufficient_evidence '", "'INSUFFICIENT_EVIDENCE'", True),
    ("'The answer is INSUFFICIENT_EVIDENCE'", "''", False),
    ("'{\"answer\": 7, \"citations\": []}'", "''", False),
    ("'{\"answer\": \"' || said || '\", \"citations\": [1]}'", "''", False),
    ("'{\"answer\": \"' || said || '\"'", "''", False),
    ("'{\"answer\": \"insufficient_evidence\", \"citations\": []}'", "'insufficient_evidence'", True),
    ("'[\"' || said || '\"]'", "''", False),
)
_SAID = "CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'The answer is ' || o_orderpriority ELSE 'order status ' || o_orderstatus END"
_PICK = lambda k: "CASE o_orderkey % 9 " + " ".join(f"WHEN {n} THEN {f[k]}" for n, f in enumerate(FORMS)) + " END"
_CITES = "o_orderkey % 9 IN (0, 1)"


def responses(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("said", F.expr(_SAID))
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.expr(_PICK(0)).alias("response"), "o_totalprice")


RESPONSES = f"""said AS (SELECT *, {_SAID} AS said FROM orders),
resp AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, said, {_PICK(0)} AS response, {_PICK(1)} AS answer, {_PICK(2)} AS valid, {_CITES} AS cites FROM said)"""


@query(f"WITH {RESPONSES} SELECT o_orderkey, answer, CASE WHEN cites THEN 'E1,E' || (2 + o_orderkey % 4) ELSE '' END AS citations, valid FROM resp")
def answer_parse(spark, sf_dir):
    """Responses read by the strict contract."""
    return responses(spark, sf_dir).withColumn("p", G.parsed(F.col("response"))).select("o_orderkey", "p.answer", F.array_join("p.citations", ",").alias("citations"), "p.valid")


_VERDICTS = ("'{\"entailed\": true, \"reason\": \" as it says \"}'", "'```' || chr(10) || '{\"entailed\": false, \"reason\": \"\"}' || chr(10) || '```'", "'{\"entailed\": \"true\", \"reason\": \"x\"}'", "'{\"entailed\": true}'", "'true'")
_VERDICT = "CASE o_orderkey % 5 " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(_VERDICTS)) + " END"


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS verdict, CASE o_orderkey % 5 WHEN 0 THEN 'as it says' ELSE '' END AS reason, o_orderkey % 5 < 2 AS valid FROM orders")
def judge_parse(spark, sf_dir):
    """Judges' responses: a boolean and a reason, or invalid."""
    return table(spark, sf_dir, "orders").withColumn("p", G.judged(F.expr(_VERDICT), "entailed")).select("o_orderkey", "p.verdict", "p.reason", "p.valid")


def _cells(spark, sf_dir) -> DataFrame:
    r = responses(spark, sf_dir)
    known = F.array(F.lit("E1"), F.lit("E2"), F.lit("E3"))
    cost = A.response_cost(F.col("o_orderkey") % 1000 + 100, F.lit(100), F.lit(50), 3.0, 0.3, 15.0)
    return G.cell_scores(r.select("o_orderkey", "o_orderstatus", "o_orderpriority", "response", F.col("o_orderpriority").alias("gold"), F.lit("Str").alias("form"), F.lit("exact").alias("rule"), (F.col("o_orderkey") % 9 != 2).alias("answerable"), known.alias("known"), cost.alias("cost")))


# what is right by construction: the priority said plainly or with a lead-in
_RIGHT = "(cites AND o_orderkey % 3 < 2)"
SCORES = f"""{RESPONSES}, sc AS (SELECT *, CASE WHEN NOT valid THEN 0.0 WHEN o_orderkey % 9 = 2 THEN 1.0 WHEN {_RIGHT} THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy,
  CASE WHEN cites THEN CASE WHEN o_orderkey % 4 < 2 THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS citation_validity, valid AND o_orderkey % 9 IN (2, 7) AS abstained, ((o_orderkey % 1000) * 3.0 + 30 + 750) / 1000000 AS cost FROM resp)"""


@query(f"WITH {SCORES} SELECT o_orderkey, valid, abstained, CASE o_orderkey % 9 WHEN 2 THEN 'unanswerable' ELSE 'entity' END AS kind, CASE WHEN cites THEN 2 ELSE 0 END::BIGINT AS n_citations, accuracy, citation_validity FROM sc")
def generation_cells(spark, sf_dir):
    """What each response is worth."""
    return _cells(spark, sf_dir).select("o_orderkey", "valid", "abstained", "kind", "n_citations", "accuracy", "citation_validity")


@query(f"WITH {SCORES} SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE abstained) AS n_abstained, round(avg(accuracy), 9) AS accuracy, round(avg(citation_validity), 9) AS citation_validity, round(avg(cost), 9) AS cost_per_query, round(CASE WHEN sum(accuracy) > 0 THEN sum(cost) / sum(accuracy) END, 9) AS cost_per_correct FROM sc GROUP BY 1, 2")
def generation_summary(spark, sf_dir):
    """Means of scores and costs of a query and of a right answer, by two factors."""
    return G.summary(_cells(spark, sf_dir), "o_orderstatus", "o_orderpriority").drop("token_f1", "anls")


_FORM = "CASE o_orderkey % 6 WHEN 0 THEN 'Int' WHEN 1 THEN 'Bool' WHEN 2 THEN 'Str' WHEN 3 THEN 'None' WHEN 4 THEN 'Float' ELSE 'List' END"
_RULE = "CASE o_custkey % 5 WHEN 0 THEN 'choice_exact_match' WHEN 1 THEN 'percentage_exact' WHEN 2 THEN 'numeric_tolerance' WHEN 3 THEN 'boolean_match' ELSE 'exact' END"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR {_FORM} = 'None' THEN 'unanswerable' WHEN {_RULE} = 'choice_exact_match' THEN 'single_choice' WHEN {_RULE} = 'percentage_exact' THEN 'percentage'
WHEN {_FORM} IN ('Int', 'Float') OR {_RULE} = 'numeric_tolerance' THEN 'numeric' WHEN {_FORM} = 'Bool' THEN 'boolean' ELSE 'entity' END AS kind FROM orders""")
def answer_types(spark, sf_dir):
    """By what kind of comparison an answer is scored."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", A.answer_type(F.col("o_orderstatus") != "P", F.expr(_FORM), F.expr(_RULE)).alias("kind"))


_BOOL = "CASE o_orderkey % 6 WHEN 0 THEN 'Yes, it is.' WHEN 1 THEN 'that is FALSE' WHEN 2 THEN 'yes and no' WHEN 3 THEN 'perhaps' WHEN 4 THEN 'Correct!' ELSE 'The answer is incorrect' END"


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN true WHEN 5 THEN false END AS truth, (o_orderkey % 6 IN (0, 4))::INT::DOUBLE AS accuracy FROM orders")
def boolean_answers(spark, sf_dir):
    """Truth values that texts state, null where they state none or both, and their scores against yes."""
    o = table(spark, sf_dir, "orders").withColumn("t", F.expr(_BOOL))
    return o.select("o_orderkey", A.boolean(F.col("t")).alias("truth"), A.accuracy(F.col("t"), F.lit("yes"), F.lit("boolean")).alias("accuracy"))


@query("SELECT o_orderkey, (o_orderkey % 4 = o_orderkey % 3)::INT::DOUBLE AS accuracy FROM orders")
def choice_answers(spark, sf_dir):
    """First letters A to D that answers choose, against gold."""
    letter = lambda n: F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("o_orderkey") % n + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("option "), F.lower(letter(4)), F.lit(") because"))
    return o.select("o_orderkey", A.accuracy(said, letter(3), F.lit("single_choice")).alias("accuracy"))


@query("SELECT c_custkey, round(CASE WHEN s > 0 THEN s * 0.85 WHEN s < 0 THEN s / 0.85 ELSE -0.15 END, 6) AS penalised FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS s FROM customer)")
def signed_penalty(spark, sf_dir):
    """Scores of either sign, lowered."""
    c = table(spark, sf_dir, "customer").withColumn("s", F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return c.select("c_custkey", F.round(S.penalised(F.col("s"), F.lit(S.SIBLING)), 6).alias("penalised"))


_TR = f"CASE WHEN len(p.heading_path) > 0 AND {FOLD.format('trim(p.heading_path[-1])')} = {FOLD.format('trim(n.text)')} THEN p.heading_path[1:len(p.heading_path) - 1] ELSE p.heading_path END"


def _trail_sql(depth: bool) -> str:
    cut = "tr[greatest(len(tr) - 1, 1):]" if depth else "tr"
    return f"CASE WHEN len(tr) = 0 THEN text ELSE array_to_string(list_transform({cut}, lambda h, i: CASE i WHEN 1 THEN h ELSE '> ' || h END), chr(10)) || chr(10) || chr(10) || text END"


@query(f"WITH {CATALOG}, t AS (SELECT n.document_id, n.ordinal, n.text, {_TR} AS tr FROM nodes n JOIN paths p ON p.document_id = n.document_id AND p.ordinal = n.ordinal) SELECT document_id, ordinal, {_trail_sql(False)} AS rendered, {_trail_sql(True)} AS last_two FROM t")
def heading_trails(spark, sf_dir):
    """Nodes under all of their headings, and under the last two."""
    n = catalog.nodes(spark, sf_dir)
    both = n.join(graph.heading_paths(n), ["document_id", "ordinal"])
    path, text = F.col("heading_path"), F.col("text")
    return both.select("document_id", "ordinal", K.trail(path, text).alias("rendered"), K.trail(path, text, 2).alias("last_two"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""SELECT o_orderkey, sha256({_quoted(G.INSTRUCTIONS)} || chr(10) || chr(10) || 'Question:' || chr(10) || q || chr(10) || chr(10) || 'Evidence:' || chr(10) || e) AS prompt_sha256,
sha256({_quoted(G.ENTAILMENT)} || chr(10) || chr(10) || 'Question:' || chr(10) || q || chr(10) || chr(10) || 'Answer:' || chr(10) || a || chr(10) || chr(10) || 'Cited evidence:' || chr(10) || e) AS entailment_sha256,
sha256({_quoted(G.EQUIVALENCE)} || chr(10) || chr(10) || 'Inputs:' || chr(10) || '{{"candidate_answer":"' || a || '","question":"' || q || '","reference_answer":"' || a || '"}}') AS equivalence_sha256
FROM (SELECT o_orderkey, 'What is the priority of order ' || o_orderkey || '?' AS q, o_orderpriority AS a, '<evidence id="E1">' || chr(10) || o_orderpriority || chr(10) || '</evidence>' AS e FROM orders)""")
def prompts(spark, sf_dir):
    """Prompts for answers and for two judges (their digests)."""
    q, a = F.expr("'What is the priority of order ' || o_orderkey || '?'"), F.col("o_orderpriority")
    e = F.concat(F.lit('<evidence id="E1">\n'), a, F.lit("\n</evidence>"))
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.sha2(G.prompt(q, e), 256).alias("prompt_sha256"), F.sha2(G.entailment_prompt(q, a, e), 256).alias("entailment_sha256"), F.sha2(G.equivalence_prompt(q, a, a), 256).alias("equivalence_sha256"))


# an order's lines are its packet; a response cites two of them
_CITED = """cited AS (SELECT o_orderkey AS cell, unnest([0, 1]) AS place, unnest(['E1', 'E' || (2 + o_orderkey % 4)]) AS label FROM orders WHERE o_orderkey % 9 IN (0, 1)),
shown AS (SELECT l_orderkey AS cell, 'E' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS label, l_partkey, l_suppkey, l_linenumber FROM lineitem)"""


def _packets(spark, sf_dir) -> DataFrame:
    slot = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    li = table(spark, sf_dir, "lineitem").withColumn("slot", slot)
    return li.select(F.col("l_orderkey").alias("query_id"), F.lit(0).alias("budget"), "slot", F.format_string("%d/%d/%d/%d", "l_orderkey", "l_partkey", "l_suppkey", "slot").alias("chunk_id"), F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_linenumber").cast("long").alias("page_start"), (F.col("l_linenumber") + 1).cast("long").alias("page_end"))


def _citations(spark, sf_dir) -> DataFrame:
    r = responses(spark, sf_dir).select(F.col("o_orderkey").alias("cell"), F.col("o_orderkey").alias("query_id"), F.lit(0).alias("budget"), G.parsed(F.col("response"))["citations"].alias("citations"))
    return G.cited(r, G.labels(_packets(spark, sf_dir)))


@query(f"WITH {_CITED} SELECT c.cell, c.place::BIGINT AS place, c.label, s.cell || '/' || s.l_partkey || '/' || s.l_suppkey || '/' || substr(s.label, 2) AS chunk_id FROM cited c LEFT JOIN shown s USING (cell, label)")
def citation_map(spark, sf_dir):
    """What citations stand for; labels that no item has are kept without one."""
    return _citations(spark, sf_dir)


@query(f"""WITH {_CITED}, j AS (SELECT c.cell, c.place, s.l_linenumber AS line FROM cited c LEFT JOIN shown s USING (cell, label))
SELECT cell, CASE WHEN cell IN (SELECT l_orderkey FROM lineitem) THEN round(count(*) FILTER (WHERE 3 BETWEEN line AND line + 1) / count(*), 9)::DOUBLE END AS support FROM j GROUP BY 1""")
def citation_support(spark, sf_dir):
    """The share of citations whose item has the gold page, page 3 of the item's own document."""
    items = _packets(spark, sf_dir).select("chunk_id", "document_id", "page_start", "page_end")
    cited = _citations(spark, sf_dir).withColumn("query_id", F.col("cell"))
    gold = _packets(spark, sf_dir).select("query_id", "document_id", F.lit(3).cast("long").alias("page"))
    return G.citation_support(cited, items.dropDuplicates(["chunk_id"]), gold)
