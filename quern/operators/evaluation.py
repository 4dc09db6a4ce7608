"""What packets are worth: pages, pages whose text is really there, quotes, answers, stages, and intervals over questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.runtime import stored

try:  # the interpreter's own takes half the time for texts of some bytes
    from _md5 import md5
except ImportError:
    from hashlib import md5

ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rules whose gold answers are numbers, numbers as texts write them, and the margin of non-inferiority.
NUMERIC_RULES = ("numeric_tolerance", "percentage_exact")
NUMBER = r"(?<![\w.,])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?![\w]|[.,]\d)"
MARGIN, UNITS = -0.03, 34
DRAWS = 10_000


def decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(38,10)")


def answer_in(content: Column, gold: Column, rule: Column) -> Column:
    """Whether one item's content has the gold answer: by value for rules on numbers, else by its normal form between characters that aren't of words."""
    text, needle = T.quote_normal(content), T.quote_normal(F.trim(gold))
    value = decimal(F.trim(F.rtrim(F.trim(gold), F.lit("%"))))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), decimal)
    literal = F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), needle, F.lit(r"\E(?!\w)")))
    return F.when(rule.isin(*NUMERIC_RULES) & value.isNotNull(), F.array_contains(numbers, value)).otherwise(literal)


def answer_present(items: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, budget, answer_present) for packed items (query_id, budget, text): in a single item; null where it doesn't apply.

    questions: query_id, gold, rule, answerable. An unanswerable question, or a gold answer that is null, empty or boolean, has none.
    """
    applies = F.col("answerable") & (F.trim(F.coalesce("gold", F.lit(""))) != "") & ~F.lower("gold").isin("true", "false")
    both = items.join(questions, "query_id")
    hit = F.when(applies, answer_in(F.col("text"), F.col("gold"), F.col("rule")))
    return both.select("query_id", "budget", hit.alias("hit")).groupBy("query_id", "budget").agg(F.bool_or("hit").alias("answer_present"))


def quote_recall(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """(query_id, budget, n_quotes, n_found): quotes (query_id, quote) in the joined content of packed items (query_id, budget, slot, text)."""
    context = items.groupBy("query_id", "budget").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("slot", "text"))), lambda x: x["text"])).alias("context"))
    both = context.join(quotes.where("trim(quote) <> ''"), "query_id").select("query_id", "budget", T.quote_found(T.quote_normal(F.col("quote")), T.quote_normal(F.col("context"))).alias("found"))
    return both.groupBy("query_id", "budget").agg(F.count("*").alias("n_quotes"), F.count_if("found").alias("n_found"))


def pages_of(nodes: DataFrame) -> DataFrame:
    """(document_id, ordinal, page): each page of a node's range; nodes without pages have none."""
    return nodes.where("page_start IS NOT NULL AND page_end IS NOT NULL").select("document_id", "ordinal", F.explode(F.sequence("page_start", "page_end")).alias("page"))


def selected_pages(items: DataFrame, nodes: DataFrame, verified: bool = False) -> DataFrame:
    """(query_id, budget, document_id, page) of items (query_id, budget, document_id, ordinal, text); verified: only where the item holds all of the node's text."""
    n = nodes.select("document_id", "ordinal", T.normal(F.col("text")).alias("node_text"))
    if verified:
        items = items.join(n, ["document_id", "ordinal"]).where((F.col("node_text") != "") & F.contains(T.normal(F.col("text")), F.col("node_text")))
    return items.join(pages_of(nodes), ["document_id", "ordinal"]).select("query_id", "budget", "document_id", "page").distinct()


def recall(selected: DataFrame, gold: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """cells (query_id, budget) with the share of gold (query_id, document_id, page) that is selected; 1 without any."""
    met = selected.join(gold.distinct(), ["query_id", "document_id", "page"]).groupBy("query_id", "budget").agg(F.count("*").alias("_met"))
    total = gold.distinct().groupBy("query_id").agg(F.count("*").alias("_gold"))
    out = cells.join(met, ["query_id", "budget"], "left").join(total, "query_id", "left")
    share = F.when(F.coalesce("_gold", F.lit(0)) == 0, 1.0).otherwise(F.round(F.coalesce("_met", F.lit(0)) / F.col("_gold"), 9))
    return out.withColumn(name, share).drop("_met", "_gold")


def stage(pool: DataFrame, nodes: DataFrame, gold: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """(query_id, budget, stage, n, tokens, page_recall) of a pool of candidates, each id once."""
    one = pool.dropDuplicates(["query_id", "budget", "document_id", "chunk_id"])
    sums = one.groupBy("query_id", "budget").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    found = recall(selected_pages(one, nodes), gold, cells, "page_recall").join(sums, ["query_id", "budget"], "left").na.fill(0, ["n", "tokens"])
    return found.select("query_id", "budget", F.lit(name).alias("stage"), "n", "tokens", "page_recall")


def paired_intervals(spark: SparkSession, deltas: DataFrame, key: list[str], draws: int = DRAWS) -> DataFrame:
    """deltas (key..., seed, cluster, delta) -> (key..., n, clusters, mean_delta, low, high): mean and 95 % interval by drawing clusters with replacement.

    The deltas of all clusters drawn are pooled, so a mean weighs questions. Draws are hashes of seed, sample and place: they need no generator's state,
    and a sample's sum and count are all that leaves a task.
    """
    c = deltas.groupBy(*key, "seed", "cluster").agg(F.sum("delta").alias("_sum"), F.count("*").alias("n"))
    place = W.partitionBy(*key).orderBy("cluster")
    c = c.withColumn("i", (F.row_number().over(place) - 1).cast("long")).withColumn("m", F.count("*").over(W.partitionBy(*key)))
    point = c.groupBy(*key, "seed", "m").agg(F.sum("n").alias("n"), F.round(F.sum("_sum") / F.sum("n"), 9).alias("mean_delta"))
    means = _sample_means(spark, c.select(*key, "seed", "i", "_sum", "n"), key, draws)
    ranked = means.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("mean", "b")) - 1)
    at = lambda p: F.max(F.when(F.col("place") == round((draws - 1) * p), F.col("mean")))
    ends = ranked.groupBy(*key).agg(at(0.025).alias("low"), at(0.975).alias("high"))
    return point.join(ends, key).select(*key, "n", F.col("m").alias("clusters"), "mean_delta", "low", "high")


#: Samples of one task's row, and places whose draws are hashed at once.
SAMPLES, PLACES = 100, 1 << 16


def _sample_means(spark: SparkSession, clusters: DataFrame, key: list[str], draws: int) -> DataFrame:
    """(key..., b, mean): for each key, `draws` samples of its clusters (key..., seed, i, _sum, n), i from 0 on.

    A key's sums and counts are two arrays, sent once for each SAMPLES samples; draws are made and added up inside a task, so that no draw is a row.
    """
    arrays = clusters.groupBy(*key, "seed").agg(F.sort_array(F.collect_list(F.struct("i", "_sum", "n"))).alias("x"))
    arrays = arrays.select(*key, "seed", F.transform("x", lambda r: r["_sum"].cast("double")).alias("sums"), F.transform("x", lambda r: r["n"].cast("long")).alias("counts"))
    blocks = spark.range(0, draws, SAMPLES, numPartitions=max(1, -(-draws // SAMPLES))).withColumnRenamed("id", "first")
    kinds = {f.name: f.dataType.simpleString() for f in arrays.schema}

    def means(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums, counts = np.array(row["sums"], float), np.array(row["counts"], float)
                m, samples = len(sums), range(row["first"], min(row["first"] + SAMPLES, draws))
                total, n = np.zeros(len(samples)), np.zeros(len(samples))
                for j in range(0, m, PLACES):
                    places = [b"%d" % k for k in range(j, min(j + PLACES, m))]
                    for at, b in enumerate(samples):
                        seeded = f"{row['seed']}/{b}/".encode()
                        digests = b"".join([md5(seeded + p).digest() for p in places])
                        drawn = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % m
                        total[at] += sums[drawn].sum()
                        n[at] += counts[drawn].sum()
                out += [{**{k: row[k] for k in key}, "b": b, "total": float(total[at]), "n": float(n[at])} for at, b in enumerate(samples)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([*(batch.schema.field(k) for k in key), pa.field("b", pa.int32()), pa.field("total", pa.float64()), pa.field("n", pa.float64())]))

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "b int, total double, n double"])
    one = spark.conf.get(ARROW, "10000")
    spark.conf.set(ARROW, "1")  # a row holds all of a key's clusters
    try:
        found = stored(blocks.join(F.broadcast(arrays)).mapInArrow(means, schema), "samples")
    finally:
        spark.conf.set(ARROW, one)
    return found.select(*key, "b", F.round(F.col("total") / F.col("n"), 9).alias("mean"))


def non_inferior(intervals: DataFrame) -> DataFrame:
    """intervals with satisfied, confirmatory and a status: strictly above the margin, over enough questions and clusters."""
    ok, sure = F.col("low") > MARGIN, (F.col("n") >= UNITS) & (F.col("clusters") >= UNITS)
    status = F.concat_ws(" ", F.when(sure, "confirmatory").otherwise("screening"), F.when(ok, "pass").otherwise("fail"))
    return intervals.withColumns({"satisfied": ok, "confirmatory": sure, "status": status})
