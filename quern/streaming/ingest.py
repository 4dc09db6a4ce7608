"""Incremental ingest: what isn't in the store yet, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("source_sha256", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def uncached(docs: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of docs whose content isn't in store (source_sha256): each content once, by its least doc_id."""
    new = hashed(docs).join(store.select("source_sha256").distinct(), "source_sha256", "left_anti")
    return new.groupBy("source_sha256").agg(F.min("doc_id").alias("doc_id"))


def follow(spark: SparkSession, landing: str, store: str, checkpoint: str):
    """A stream from a folder of documents to a store of contents: each batch adds what the store lacks.

    The write is keyed by content, so that a batch that runs again adds nothing twice. Returns the started query;
    it ends when all files that are there have been read.
    """
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def add(batch: DataFrame, _: int) -> None:
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(store)
        there = path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(path)
        known = batch.sparkSession.read.parquet(store) if there else hashed(batch).where("false")
        uncached(batch, known).write.mode("append").parquet(store)

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
