"""A benchmark's release: JSON lines read by a fixed schema, brought into one shape, checked against what was pinned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "struct<locator:string,pages:array<int>,quote:string,source_type:string>"
_EVIDENCE = f"struct<document_id:string,url:string,evidence_pages:array<int>,evidence_items:array<{_ITEM}>>"
DOCUMENTS = "document_id string, url string, title string, domain string, page_count int, file_size_bytes bigint, source_host string, public_metadata map<string,string>"
QUESTIONS = f"question_id string, question string, task_type string, document {_EVIDENCE}, documents array<{_EVIDENCE}>, answer struct<format:string,value:string,verification_rule:string>, metadata struct<domain:string,is_unanswerable:boolean>"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def documents(raw: DataFrame) -> DataFrame:
    """(document_id, url, title, domain, page_count, file_size_bytes, source_host, metadata): a release's documents."""
    return raw.select("document_id", "url", F.nullif(F.trim("title"), F.lit("")).alias("title"), "domain", "page_count", "file_size_bytes", "source_host", F.to_json("public_metadata").alias("metadata"))


def questions(raw: DataFrame) -> DataFrame:
    """Questions on one or several documents in one shape; evidence without pages and items is left out."""
    asked = F.when(F.col("task_type") == "single_doc", F.array("document")).otherwise(F.coalesce("documents", F.array().cast(raw.schema["documents"].dataType)))
    some = lambda e: (F.size(F.coalesce(e["evidence_pages"], F.array().cast("array<int>"))) > 0) | (F.size(F.coalesce(e["evidence_items"], F.array().cast(f"array<{_ITEM}>"))) > 0)
    return raw.select(
        "question_id", "question", "task_type", F.transform(asked, lambda e: e["document_id"]).alias("document_ids"), F.transform(asked, lambda e: e["url"]).alias("urls"),
        F.filter(asked, some).alias("evidence"), F.col("answer.value").alias("gold"), F.col("answer.format").alias("form"), F.col("answer.verification_rule").alias("rule"),
        (~F.coalesce("metadata.is_unanswerable", F.lit(False))).alias("answerable"),
    )


def gold_pages(found: DataFrame) -> DataFrame:
    """(question_id, document_id, page) of evidence: its own pages and those of its items."""
    e = found.select("question_id", F.explode("evidence").alias("e"))
    own = F.coalesce("e.evidence_pages", F.array().cast("array<int>"))
    items = F.flatten(F.transform(F.coalesce("e.evidence_items", F.array().cast(f"array<{_ITEM}>")), lambda i: F.coalesce(i["pages"], F.array().cast("array<int>"))))
    return e.select("question_id", F.col("e.document_id").alias("document_id"), F.explode(F.array_distinct(F.concat(own, items))).alias("page"))


def problems(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, id): repeated ids, questions on unknown documents, addresses that differ from the document's."""
    again = lambda df, column, kind: df.groupBy(F.col(column).alias("id")).count().where("count > 1").select(F.lit(kind).alias("kind"), "id")
    each = found.select("question_id", F.explode(F.arrays_zip(F.col("document_ids").alias("d"), F.col("urls").alias("u"))).alias("x"))
    met = each.join(docs.select("document_id", "url"), F.col("x.d") == F.col("document_id"), "left")
    unknown = met.where("document_id IS NULL").select(F.lit("unknown document").alias("kind"), F.col("question_id").alias("id"))
    moved = met.where("document_id IS NOT NULL AND NOT (x.u <=> url)").select(F.lit("other address").alias("kind"), F.col("question_id").alias("id"))
    return again(docs, "document_id", "repeated document").unionByName(again(found, "question_id", "repeated question")).unionByName(unknown).unionByName(moved).distinct()


def changed_files(spark: SparkSession, root: str, pinned: dict[str, str]) -> list[str]:
    """Names under root whose SHA-256 isn't the pinned one, or that are missing."""
    if not pinned:
        return []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    have = {r.path.rsplit("/", 1)[-1]: r.digest for r in files.select("path", F.sha2("content", 256).alias("digest")).collect()}
    return sorted(name for name, digest in pinned.items() if have.get(name) != digest)


def subset(found: DataFrame, ids: list[str], key: str = "question_id") -> DataFrame:
    """Questions in the order of a manifest's ids, with their position; an unknown or repeated id is an error."""
    if len(set(ids)) != len(ids):
        raise ValueError("a subset names each question once")
    wanted = found.sparkSession.createDataFrame(list(enumerate(ids)), f"position long, {key} string")
    lacking = [r[0] for r in wanted.join(found, key, "left_anti").select(key).limit(5).collect()]
    if lacking:
        raise ValueError(f"not in the release: {', '.join(lacking)}")
    return wanted.join(found, key).orderBy("position")
