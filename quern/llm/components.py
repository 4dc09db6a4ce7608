"""Connected components of links between rows, without gathering them anywhere.

Each round is a large-star step (every row's larger neighbours move to its least neighbour) and a
small-star step (its smaller ones do), until the links are stars around the least id of each
component. Both steps aggregate by row and join the result back, so a row with very many
links is split by adaptive execution. Rounds grow with the logarithm of the number of rows in a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import discard, stored


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, component) for every id in links (a, b), two long columns; component is the least id that can be reached."""
    edges = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # all links now point from a larger to a smaller row
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, edges = edges, stored(small, name)
        discard(old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")).first()
        if before == now:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
