"""Selections that SQL can't fold, against slow models."""

import random

from quern.operators import packing as P


def model(rows, budget, adaptive):
    """rows: dicts; picks by the best gain each time."""
    left, out, rows = budget, [], list(rows)
    terms, facets, pages, heads, refs = set(), set(), set(), set(), set()
    every = {k for k, f in enumerate(rows[0]["facets"]) if f}

    def parts(r):
        t = set(r["terms"])
        hit = {k for k, f in enumerate(r["facets"]) if f and len(set(f) & t) / len(f) >= 0.5}
        return (set(r["references"]) & set(r["query_references"])) - refs, hit - facets, (t & set(r["query_terms"])) - terms, set(r["page_keys"]) - pages, bool(r["heading"]) and r["heading"] not in heads

    while True:
        fits = [r for r in rows if r["token_count"] + P.FRAME <= left]
        if not fits:
            return out
        tier = min(r["tier"] for r in fits)
        fits = [r for r in fits if r["tier"] == tier]
        if adaptive and ((every and every <= facets) or all(not parts(r)[3] for r in fits)):
            for r in sorted(rows, key=lambda r: (r["tier"], -r["reranked"], r["rank"], r["chunk_id"])):
                if r["token_count"] + P.FRAME <= left:
                    out.append(r["chunk_id"])
                    left -= r["token_count"] + P.FRAME
            return out
        def key(r):
            a, b, c, d, e = parts(r)
            u = 8.0 * len(a) + 6.0 * len(b) + 2.0 * len(c) + 0.25 * len(d) + 0.25 * e + 4.0 / r["rank"]
            return (-u, -u / (r["token_count"] + P.FRAME), -r["reranked"], r["rank"], r["chunk_id"])
        best = min(fits, key=key)
        a, b, c, d, _ = parts(best)
        refs, facets, terms, pages = refs | a, facets | b, terms | c, pages | d
        heads.add(best["heading"])
        rows.remove(best)
        out.append(best["chunk_id"])
        left -= best["token_count"] + P.FRAME


def test_coverage(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for q in range(6):
        asked, facets = r.sample(words, 6), [r.sample(words, r.randint(0, 3)) for _ in range(3)]
        for k in range(20):
            rows.append({"query_id": q, "budget": r.choice([60]) + 10 * q, "rank": k + 1, "chunk_id": f"c{k}", "token_count": r.randint(1, 30), "reranked": r.randint(0, 4) / 4, "tier": int(r.random() < 0.3), "terms": r.sample(words, r.randint(0, 6)), "query_terms": asked, "facets": facets, "references": r.sample(["table a.1", "table b.2"], r.randint(0, 2)), "query_references": ["table a.1"], "page_keys": [f"p{r.randint(1, 5)}"], "heading": r.choice(["", "h", "g"])})
    schema = "query_id long, budget long, rank long, chunk_id string, token_count long, reranked double, tier int, terms array<string>, query_terms array<string>, facets array<array<string>>, references array<string>, query_references array<string>, page_keys array<string>, heading string"
    df = spark.createDataFrame([tuple(x.values()) for x in rows], schema)
    for adaptive in (False, True):
        got = {}
        for x in P.coverage(df, adaptive).orderBy("query_id", "slot").collect():
            got.setdefault(x.query_id, []).append(x.chunk_id)
        assert got == {q: m for q in range(6) if (m := model([x for x in rows if x["query_id"] == q], 60 + 10 * q, adaptive))}


def test_adaptive_without_facets_goes_by_pages(spark):
    """No facet isn't all facets: coverage goes on while pages are new, and only then the score decides."""
    schema = "query_id long, budget long, rank long, chunk_id string, token_count long, reranked double, tier int, terms array<string>, query_terms array<string>, facets array<array<string>>, references array<string>, query_references array<string>, page_keys array<string>, heading string"
    rows = [(1, 100, k, f"c{k}", 1, k / 10, 0, ["a"] if k == 1 else [], ["a"], [], [], [], ["p2" if k in (4, 5) else "p1"], "") for k in range(1, 8)]
    got = [x.chunk_id for x in P.coverage(spark.createDataFrame(rows, schema), adaptive=True).orderBy("slot").collect()]
    assert got == ["c1", "c2", "c3", "c4", "c7", "c6", "c5"]


def test_contained(spark):
    rows = [(1, 1, "d", 1, 1, "alpha beta gamma"), (1, 2, "d", 1, 1, "Beta  gamma"), (1, 3, "d", 2, 2, "beta"), (1, 4, "e", 1, 1, "beta"), (1, 5, "d", 1, 3, "gamma"), (1, 6, "e", 9, 9, "BETA")]
    df = spark.createDataFrame(rows, "query_id long, rank long, document_id string, page_start long, page_end long, text string")
    assert sorted(x["rank"] for x in P.dedupe_contained(df).collect()) == [1, 3]


def test_greedy_skips_and_continues(spark):
    df = spark.createDataFrame([(1, 20, 1, "a", "s1", 10), (1, 20, 2, "b", "s2", 9), (1, 20, 3, "c", "s1", 1), (1, 20, 4, "d", "s4", 1)], "query_id long, budget long, rank long, chunk_id string, source string, token_count long")
    assert [(x.slot, x.chunk_id, x.cost) for x in P.pack_greedy(df).orderBy("slot").collect()] == [(1, "a", 13), (2, "d", 4)]
