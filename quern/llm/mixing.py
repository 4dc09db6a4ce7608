"""Mixing sources to target weights by capped water-filling.

target(source) = min(epochs x size, level x weight), where the level is the one at which the
targets add up to the size of all sources: sources at their cap are clamped, and their excess
goes to the others in proportion to weight until no target is above its cap. The level comes
from one pass over sources sorted by the level at which each reaches its cap.

Each document of a source is taken floor(target / size) whole times. The rest of the target is
filled in an order drawn by a seeded hash of the document's id: whole documents, then the first
words of one more, so that a source's taken words are its target rounded to a word.
Running sums go by pieces of the hash range, so that no task gets a whole source.

Defined results: null texts and texts without words have size 0 and are taken as 0 words; a null
source is a source of its own, last in order; sources without words have target 0; documents that
share an id share their place in the order, and are told apart by their text's hash, then size;
rows that agree in all of these are interchangeable. Other columns pass through untouched whatever
their names, but mix() replaces those that it adds; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.runtime import input_bytes, stored, table

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Pieces of the hash range of one source: at least this many hexadecimal digits, and more where a piece of all input would have more bytes than this.
DIGITS, PIECE_BYTES = 3, 32 << 20
#: Sources whose limits (about 100 bytes each) are broadcast; beyond, the same join shuffles.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """How many runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    text = F.btrim(F.coalesce(text, F.lit("")), blank)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): one row for each source, weights by code point, null last, repeating.

    share is the wanted size as a part of all sizes, at most epochs.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    n = len(weights)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % n + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(int(epochs))).withColumn("whole", F.sum("source_size").over(everything))
    by_level = W.orderBy((F.col("cap") / F.col("weight")).asc(), "place")
    # with the sources before this one clamped: the level of the rest, and whether this one stays below its cap
    ranked = (
        ranked.withColumn("clamped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("whole") * F.lit(float(share)) - F.col("clamped")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("fits"), F.struct("clamped", "level"))).over(everything)["level"]
    return ranked.withColumn("filled", level).select(
        "source",
        "source_size",
        F.when(F.col("filled").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("filled") * F.col("weight"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    share: float = 1.0,
    seed: str = SEED,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_taken (words that the mix takes, repeats counted); columns so named are replaced."""
    taken = plan(docs, weights, epochs, share, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    own = {"mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_taken": "taken"}
    rest = [c for c in docs.columns if c.lower() not in own]
    return taken.select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], *[F.col(c).alias(name) for name, c in own.items()])


def digits_for(docs: DataFrame) -> int:
    """Hexadecimal digits of a piece: more for larger inputs, so that a piece of one source stays small. Results don't depend on it."""
    return next((n for n in range(DIGITS, 7) if PIECE_BYTES << (4 * n) >= input_bytes(docs)), 7)


def plan(docs: DataFrame, weights=WEIGHTS, epochs=EPOCHS, share=1.0, seed=SEED, *, id_col="doc_id", text_col="text", source_col="source", keep_row: bool = True) -> DataFrame:
    """(id, source, size, source_size, target, taken[, _row]).

    Running sums over pieces tell for each source the one piece in which its target is met: rows of pieces before it are taken,
    those of later ones aren't, and only the rows of that piece are ranked. Texts of other rows never move.
    """
    text = F.col(f"`{text_col}`")
    draw = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        text.alias("_text"),
        draw.alias("draw"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep_row else []),
    ).withColumn("piece", F.substring("draw", 1, digits_for(docs)))
    pieces = rows.select("source", "piece", words(F.col("_text")).alias("size")).groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    pieces = stored(pieces, "mix-pieces")
    sources = targets(pieces.groupBy("source").agg(F.sum("piece_size").alias("source_size")), weights, epochs, share)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("times", times).withColumn("rest", F.round("target").cast("long") - F.col("times") * F.col("source_size"))
    ends = pieces.withColumn("piece_end", F.sum("piece_size").over(W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, 0)))
    met = ends.withColumnRenamed("source", "s").join(sources.select("source", "rest"), F.col("s").eqNullSafe(F.col("source"))).where("piece_end > rest")
    edges = met.groupBy("source").agg(F.min(F.struct("piece", (F.col("piece_end") - F.col("piece_size")).alias("start"))).alias("e"))
    limits = sources.alias("a").join(edges.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
        F.col("a.source").alias("limit_source"), "source_size", "target", "times", "rest", F.coalesce(F.col("e.piece"), F.lit("g")).alias("edge"), F.coalesce(F.col("e.start"), F.lit(0)).alias("edge_start")
    )  # no hexadecimal digit comes after "g"
    limits = stored(limits, "mix-limits")
    near = F.broadcast(limits) if limits.count() <= BROADCAST_SOURCES else limits
    both = rows.join(near, F.col("source").eqNullSafe(F.col("limit_source")))
    own = ["_row"] if keep_row else []
    apart = both.where("piece <> edge").withColumn("size", words(F.col("_text"))).withColumn("more", F.when(F.col("piece") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    inner = W.partitionBy("source").orderBy("draw", "mark", "size").rowsBetween(W.unboundedPreceding, 0)
    edge = both.where("piece = edge").withColumn("size", words(F.col("_text"))).withColumn("mark", F.md5(F.coalesce(F.col("_text"), F.lit(""))))
    start = F.col("edge_start") + F.sum("size").over(inner) - F.col("size")
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start)))
    columns = ["id", "source", "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("more")).cast("long").alias("taken"), *own]
    return apart.select(*columns).unionByName(edge.select(*columns))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows repeated whole, and the first words of those taken in part; docs' columns.

    The words of a part keep what stands between them.
    """
    text_col = options.get("text_col", "text")
    mixed = plan(docs, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.concat(
        F.array_repeat(F.struct(F.lit(0).alias("part")), whole),
        F.when(part > 0, F.array(F.struct(part.alias("part")))).otherwise(F.array().cast("array<struct<part:int>>")),
    )
    out = mixed.select("_row", F.explode(copies).alias("copy"))
    text, blank = F.col(f"_row.`{text_col}`"), "[\\x20\\x09-\\x0D]+"
    lead = F.when(text.rlike("^" + blank), 1).otherwise(0)
    pieces = F.split(text, blank, F.col("copy.part") + lead + 1)  # the last piece is all that follows
    rest = F.when(F.size(pieces) > F.col("copy.part") + lead, F.length(F.element_at(pieces, -1))).otherwise(0)
    head = F.rtrim(F.substring(text, F.lit(1), F.length(text) - rest), F.lit(" \t\n\x0b\x0c\r"))
    return out.select(*[(F.when(F.col("copy.part") > 0, head).otherwise(text).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c)) for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents at weights 5, 2, 1, repeating, takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs, keep_row=False).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1/' || coalesce(doc_id::VARCHAR, '')) AS draw, md5(coalesce(text, '')) AS mark
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS whole FROM r),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clamped,
             sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open FROM w),
v AS (SELECT *, (whole * 1.0::DOUBLE - clamped) / open AS level FROM l),
f AS (SELECT arg_min(level, clamped) FILTER (WHERE level * weight <= cap) AS filled FROM v),
t AS (SELECT source, source_size, CASE WHEN filled IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, filled * weight) END AS target FROM v, f),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS start,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS times
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       times * size + greatest(0, least(size, round(target)::BIGINT - times * source_size - start)) AS taken
FROM o
"""
