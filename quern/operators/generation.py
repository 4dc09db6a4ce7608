"""Answers of a provider: prompts, strict parsing, labels and citations, cell scores, summaries. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import answers as A

# Fixed value: what a response says that finds no evidence.
MARKER = "INSUFFICIENT_EVIDENCE"
#: Our instructions; a prompt is these, the question and the evidence.
INSTRUCTIONS = (
    "Answer the question from the evidence below and from nothing else. Reply with one JSON object that has two fields: \"answer\", a string, and "
    f"\"citations\", a list of the labels of the evidence used. If the evidence doesn't hold the answer, the answer is {MARKER} with no citations."
)
ENTAILMENT = "Say whether the cited evidence supports the answer. Reply with one JSON object: \"entailed\", true or false, and \"reason\", a string."
EQUIVALENCE = "Say whether the candidate answer means the same as the reference answer. Reply with one JSON object: \"equivalent\", true or false, and \"reason\", a string."


def prompt(question: Column, evidence: Column, instructions: str = INSTRUCTIONS) -> Column:
    return F.concat(F.lit(f"{instructions}\n\nQuestion:\n"), question, F.lit("\n\nEvidence:\n"), evidence)


def entailment_prompt(question: Column, answer: Column, evidence: Column) -> Column:
    return F.concat(F.lit(f"{ENTAILMENT}\n\nQuestion:\n"), question, F.lit("\n\nAnswer:\n"), answer, F.lit("\n\nCited evidence:\n"), evidence)


def equivalence_prompt(question: Column, reference: Column, candidate: Column) -> Column:
    inputs = F.to_json(F.struct(candidate.alias("candidate_answer"), question.alias("question"), reference.alias("reference_answer")))
    return F.concat(F.lit(f"{EQUIVALENCE}\n\nInputs:\n"), inputs)


def without_fence(text: Column) -> Column:
    """What is inside one enclosing code fence, its language mark left out, or the trimmed text."""
    t = F.trim(text, F.lit(" \t\n\r"))
    inner = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)\n[ \t]*```$", 1)
    return F.when(t.rlike(r"(?s)^```[^\n]*\n.*\n[ \t]*```$"), F.regexp_replace(inner, r"^\s*json\s*", "")).otherwise(t)


def abstains(answer: Column) -> Column:
    return F.lower(F.trim(answer, F.lit(" \t\n\r"))) == MARKER.lower()


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def parsed(text: Column) -> Column:
    """struct(answer, citations, valid) of a response, by the strict contract: nothing is repaired, but a bare marker is an abstention."""
    body = without_fence(text)
    v = F.try_parse_json(body)
    cited = F.try_variant_get(v, "$.citations", "array<variant>")
    strings = cited.isNotNull() & F.forall(cited, lambda c: F.coalesce(F.schema_of_variant(c) == "STRING", F.lit(False)))
    good = F.coalesce((_kind(v, "$.answer") == "STRING") & F.startswith(_kind(v, "$.citations"), F.lit("ARRAY")) & strings, F.lit(False))
    bare = v.isNull() & abstains(body)
    none = F.array().cast("array<string>")
    answer = F.when(good, F.trim(F.try_variant_get(v, "$.answer", "string"))).when(bare, F.lit(MARKER)).otherwise("")
    return F.struct(answer.alias("answer"), F.when(good, F.try_variant_get(v, "$.citations", "array<string>")).otherwise(none).alias("citations"), (good | bare).alias("valid"))


def judged(text: Column, field: str) -> Column:
    """struct(verdict, reason, valid) of a judge's response: a boolean and a string, or invalid."""
    v = F.try_parse_json(without_fence(text))
    good = F.coalesce((_kind(v, f"$.{field}") == "BOOLEAN") & (_kind(v, "$.reason") == "STRING"), F.lit(False))
    verdict = F.when(good, F.try_variant_get(v, f"$.{field}", "boolean")).otherwise(False)
    return F.struct(verdict.alias("verdict"), F.when(good, F.trim(F.try_variant_get(v, "$.reason", "string"))).otherwise("").alias("reason"), good.alias("valid"))


def labels(packed: DataFrame) -> DataFrame:
    """(query_id, budget, label, chunk_id): the label under which an item is shown, its slot."""
    return packed.select("query_id", "budget", F.concat(F.lit("E"), F.col("slot").cast("string")).alias("label"), "chunk_id")


def cited(responses: DataFrame, shown: DataFrame) -> DataFrame:
    """responses (cell, query_id, budget, citations) -> (cell, place, label, chunk_id): what each citation stands for; an unknown label stands for itself and has no item."""
    each = responses.select("cell", "query_id", "budget", F.posexplode("citations").alias("place", "label"))
    return each.join(shown, ["query_id", "budget", "label"], "left").select("cell", F.col("place").cast("long").alias("place"), "label", "chunk_id")


def cell_scores(cells: DataFrame) -> DataFrame:
    """cells (response, gold, form, rule, answerable, known: labels that a packet assigned) with what the response is worth; an invalid one scores 0 throughout."""
    found = cells.withColumn("_p", parsed(F.col("response")))
    answer, valid = F.col("_p.answer"), F.col("_p.valid")
    kind = A.answer_type(F.col("answerable"), F.col("form"), F.col("rule"))
    ok = lambda score: F.when(valid, F.round(score, 9)).otherwise(0.0)
    given = F.col("_p.citations")
    good = F.size(F.filter(given, lambda c: F.array_contains(F.col("known"), c)))
    return found.withColumns({
        "answer": answer, "valid": valid, "abstained": valid & abstains(answer), "kind": kind, "n_citations": F.size(given).cast("long"),
        "accuracy": ok(A.accuracy(answer, F.col("gold"), kind)), "token_f1": ok(A.token_f1(answer, F.col("gold"))), "anls": ok(A.anls(answer, F.col("gold"))),
        "citation_validity": F.when(F.size(given) > 0, F.round(good / F.size(given), 9)).otherwise(0.0),
    }).drop("_p")


def citation_support(citations: DataFrame, items: DataFrame, gold: DataFrame) -> DataFrame:
    """(cell, support): the share of a cell's citations (cell, query_id, chunk_id) whose item's pages (chunk_id, document_id, page_start, page_end) hold a gold page.

    An interval join by document; null where a question (query_id, document_id, page) has no gold page.
    """
    known = citations.join(items.dropDuplicates(["chunk_id"]), "chunk_id", "left")
    pages = gold.select("query_id", "document_id", "page").distinct()
    met = known.join(pages, ["query_id", "document_id"]).where("page BETWEEN page_start AND page_end").select("cell", "place").distinct().groupBy("cell").agg(F.count("*").alias("_met"))
    total = citations.groupBy("cell", "query_id").agg(F.count("*").alias("_n"))
    asked = pages.select("query_id").distinct().withColumn("_asked", F.lit(True))
    out = total.join(met, "cell", "left").join(asked, "query_id", "left")
    return out.select("cell", F.when(F.col("_asked"), F.round(F.coalesce("_met", F.lit(0)) / F.col("_n"), 9)).alias("support"))


def summary(cells: DataFrame, *keys: str) -> DataFrame:
    """Means by keys, with the cost of a query and of a right answer (null without one); cells have cost and the scores of cell_scores()."""
    mean = lambda c: F.round(F.avg(c), 9).alias(c)
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if("abstained").alias("n_abstained"), mean("accuracy"), mean("token_f1"), mean("anls"), mean("citation_validity"),
        F.round(F.avg("cost"), 9).alias("cost_per_query"), F.round(F.try_divide(F.sum("cost"), F.sum("accuracy")), 9).alias("cost_per_correct"),
    )


def calls(eligible: Column, conditions: int, judges: int) -> Column:
    """How many calls a run makes at most."""
    return eligible * conditions * (1 + judges)
