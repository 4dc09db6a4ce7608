"""Packing candidates under a token budget: caps, removal of duplicates, greedy and coverage selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T

BUDGETS = (2048, 4096, 8192, 16384)
POOL = 500
#: Tokens around an item's content: the opening tag's two, the closing tag's one.
FRAME = 3
# What a step of coverage is worth.
REFERENCE, FACET, TERM, PAGE, HEADING, RANK = 8.0, 6.0, 2.0, 0.25, 0.25, 4.0
FACET_SHARE = 0.5
FACETS, FACET_TERMS = 4, 2


def with_budgets(candidates: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """Each candidate for each budget: rankings don't depend on budgets, so they are multiplied last."""
    return candidates.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])))


def pool_cap(candidates: DataFrame, most: int = POOL, multiple: float = 0.0) -> DataFrame:
    """The first `most` by rank, or a longer prefix until its cost reaches multiple x budget."""
    before = F.coalesce(F.sum(F.col("token_count") + FRAME).over(W.partitionBy("query_id", "budget").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return candidates.withColumn("_b", before).where((F.col("rank") <= most) | (F.col("_b") < F.col("budget") * multiple)).drop("_b")


def dedupe_exact(candidates: DataFrame) -> DataFrame:
    """The best ranked of the candidates of a query with the same normalised text."""
    order = W.partitionBy("query_id", T.normal(F.col("text"))).orderBy("rank")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dedupe_contained(candidates: DataFrame) -> DataFrame:
    """As dedupe_exact, and without texts contained in a kept text of the same document on an overlapping page.

    What is kept depends on what was kept before, so this is a fold by query and document; a query's pool is capped first.
    """
    schema = candidates.select("query_id", "rank").schema

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int, str]] = []
        rows = []
        for r in frame.sort_values("rank").itertuples():
            if any(r.norm == t or (r.norm in t and a <= r.page_end and r.page_start <= z) for a, z, t in kept):
                continue
            kept.append((r.page_start, r.page_end, r.norm))
            rows.append((r.query_id, r.rank))
        return pd.DataFrame(rows, columns=["query_id", "rank"])

    exact = dedupe_exact(candidates).withColumn("norm", T.normal(F.col("text")))
    found = exact.select("query_id", "document_id", "rank", "page_start", "page_end", "norm").groupBy("query_id", "document_id").applyInPandas(fold, schema)
    return candidates.join(found, ["query_id", "rank"], "left_semi")


def pack_greedy(candidates: DataFrame, frame: int = FRAME) -> DataFrame:
    """(query_id, budget, slot, chunk_id, rank, cost): by rank, first of each source, skipping what doesn't fit. A fold in the JVM."""
    items = candidates.groupBy("query_id", "budget").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "source", (F.col("token_count") + frame).alias("cost")))).alias("n"))
    empty = "cast(array() AS array<struct<rank: bigint, chunk_id: string, cost: bigint>>)"
    folded = items.select("query_id", "budget", F.expr(f"""aggregate(n, named_struct('out', {empty}, 'left', budget, 'seen', cast(array() AS array<string>)),
        (s, x) -> CASE WHEN x.cost <= s.left AND NOT array_contains(s.seen, x.source)
          THEN named_struct('out', concat(s.out, array(named_struct('rank', x.rank, 'chunk_id', x.chunk_id, 'cost', x.cost))), 'left', s.left - x.cost, 'seen', concat(s.seen, array(x.source))) ELSE s END, s -> s.out)""").alias("out"))
    slots = folded.select("query_id", "budget", F.posexplode("out").alias("slot", "x"))
    return slots.select("query_id", "budget", (F.col("slot") + 1).cast("long").alias("slot"), "x.chunk_id", "x.rank", "x.cost")


def coverage(candidates: DataFrame, adaptive: bool = False, frame: int = FRAME) -> DataFrame:
    """(query_id, budget, slot, chunk_id, gain): greedy choice by what a candidate adds to covered terms, facets, references, pages and headings.

    candidates: query_id, budget, rank, chunk_id, token_count, reranked, tier, terms, query_terms, facets (arrays of terms), references,
    query_references, page_keys, heading. The least tier that still fits goes first. With adaptive, choice by coverage ends when all
    facets are covered or no candidate adds a page, and what is left follows by rank. One group is one query's capped pool.
    """

    def select(frame_: pd.DataFrame) -> pd.DataFrame:
        left = int(frame_["budget"].iloc[0])
        rows = list(frame_.sort_values(["rank", "chunk_id"]).itertuples())
        wanted = set(rows[0].query_terms)
        facets = [set(f) for f in rows[0].facets]
        asked = set(rows[0].query_references)
        cost = {r.chunk_id: int(r.token_count) + frame for r in rows}
        terms = {r.chunk_id: set(r.terms) for r in rows}
        refs = {r.chunk_id: set(r.references) & asked for r in rows}
        pages = {r.chunk_id: set(r.page_keys) for r in rows}
        hit = {r.chunk_id: {k for k, f in enumerate(facets) if f and len(f & terms[r.chunk_id]) / len(f) >= FACET_SHARE} for r in rows}
        done = {"terms": set(), "facets": set(), "refs": set(), "pages": set(), "headings": set()}
        out = []

        def gain(r) -> float:
            c = r.chunk_id
            return (
                REFERENCE * len(refs[c] - done["refs"]) + FACET * len(hit[c] - done["facets"]) + TERM * len((terms[c] & wanted) - done["terms"])
                + PAGE * len(pages[c] - done["pages"]) + HEADING * bool(r.heading and r.heading not in done["headings"]) + RANK / r.rank
            )

        while rows:
            fits = [r for r in rows if cost[r.chunk_id] <= left]
            if not fits:
                break
            least = min(r.tier for r in fits)
            fits = [r for r in fits if r.tier == least]
            coverable = {k for k, f in enumerate(facets) if f}  # without facets only pages tell whether breadth is exhausted
            if adaptive and ((coverable and coverable <= done["facets"]) or not any(pages[r.chunk_id] - done["pages"] for r in fits)):
                for r in sorted(rows, key=lambda r: (r.tier, -r.reranked, r.rank, r.chunk_id)):
                    if cost[r.chunk_id] <= left:
                        out.append((r.query_id, r.budget, len(out) + 1, r.chunk_id, 0.0))
                        left -= cost[r.chunk_id]
                break
            best = min(fits, key=lambda r: (-(g := gain(r)), -g / max(cost[r.chunk_id], 1), -r.reranked, r.rank, r.chunk_id))
            c = best.chunk_id
            out.append((best.query_id, best.budget, len(out) + 1, c, round(gain(best), 6)))
            rows.remove(best)
            left -= cost[c]
            done["terms"] |= terms[c] & wanted
            done["facets"] |= hit[c]
            done["refs"] |= refs[c]
            done["pages"] |= pages[c]
            if best.heading:
                done["headings"].add(best.heading)
        return pd.DataFrame(out, columns=["query_id", "budget", "slot", "chunk_id", "gain"])

    return candidates.groupBy("query_id", "budget").applyInPandas(select, "query_id long, budget long, slot long, chunk_id string, gain double")


def first_gain(candidates: DataFrame) -> DataFrame:
    """What each candidate would add as the first choice: plain columns."""
    matched = F.size(F.array_intersect("terms", "query_terms"))
    facets = F.size(F.filter("facets", lambda f: (F.size(f) > 0) & (F.size(F.array_intersect(f, F.col("terms"))) / F.size(f) >= FACET_SHARE)))
    refs = F.size(F.array_intersect("references", "query_references"))
    gain = REFERENCE * refs + FACET * facets + TERM * matched + PAGE * F.size("page_keys") + HEADING * (F.coalesce("heading", F.lit("")) != "").cast("int") + RANK / F.col("rank")
    return candidates.select("query_id", "chunk_id", F.round(gain, 6).alias("gain"))


def render(packed: DataFrame) -> DataFrame:
    """(query_id, budget, block, n_items): items in slot order, each in its tag, a blank line between."""
    item = F.concat(F.lit('<evidence id="E'), F.col("slot").cast("string"), F.lit('">\n'), F.col("text"), F.lit("\n</evidence>"))
    rows = packed.groupBy("query_id", "budget").agg(F.sort_array(F.collect_list(F.struct("slot", item.alias("item")))).alias("x"))
    return rows.select("query_id", "budget", F.concat_ws("\n\n", F.transform("x", lambda r: r["item"])).alias("block"), F.size("x").cast("long").alias("n_items"))

