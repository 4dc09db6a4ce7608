"""Runs, indexes and bundles as files: staged, then renamed; never overwritten; read back only if they are what was asked for."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict, report: str | None = None) -> None:
    """A run's tables as JSON lines, its manifest and report, all at once under path; an existing path is refused."""
    if exists(spark, path):
        raise FileExistsError(path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.json(f"{staged}/{name}")
    write_text(spark, f"{staged}/manifest.json", json.dumps(manifest, sort_keys=True, indent=2))
    if report is not None:
        write_text(spark, f"{staged}/report.md", report)
    p, fs = _fs(spark, staged)
    if not fs.rename(p, _fs(spark, path)[0]):
        fs.delete(p, True)
        raise FileExistsError(path)


def packets(spark: SparkSession, path: str, schema: str, system: str, budgets: list[int], expected: int) -> DataFrame:
    """A published run's packet items of one system and some budgets; the number of cells has to be the expected one."""
    found = spark.read.schema(schema).json(f"{path}/contexts").where((F.col("system") == system) & F.col("budget").isin(budgets))
    cells = found.select("query_id", "budget").distinct().count()
    if cells != expected:
        raise ValueError(f"{cells} cells where {expected} were expected")
    return found


def markdown(df: DataFrame, title: str, order: list[str]) -> str:
    """A small summary as a table."""
    rows = df.orderBy(*order).collect()
    shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in rows), ""])


# index


def digest(chunks: DataFrame) -> str:
    """One digest of all of a table's rows, whatever their order: rows' hashes are summed by range before they are hashed."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(chunks.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = chunks.select(row.alias("h")).withColumn("part", F.substring("h", 1, 2))
    half = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = parts.groupBy("part").agg(F.count("*").cast("string").alias("n"), half(3).alias("a"), half(33).alias("b"))
    return sums.agg(F.sha2(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("part", "n", "a", "b"))), lambda x: F.concat_ws(",", x["part"], x["n"], x["a"], x["b"]))), 256)).first()[0]


def index(spark: SparkSession, root: str, chunks: DataFrame, config: dict, embed) -> DataFrame:
    """Vectors of chunks: those of an artifact under root whose configuration and chunks are these, else made by embed(chunks) and kept."""
    state = {"config": config, "chunks": digest(chunks)}
    key = spark.range(1).select(F.sha2(F.lit(json.dumps(state, sort_keys=True)), 256)).first()[0]
    path = f"{root}/{key}"
    if exists(spark, f"{path}/manifest.json") and json.loads(read_text(spark, f"{path}/manifest.json")) == state:
        return spark.read.parquet(f"{path}/vectors")
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    embed(chunks).write.parquet(f"{staged}/vectors")
    write_text(spark, f"{staged}/manifest.json", json.dumps(state, sort_keys=True))
    p, fs = _fs(spark, staged)
    if not exists(spark, path):
        fs.rename(p, _fs(spark, path)[0])
    return spark.read.parquet(f"{path}/vectors")


# documents


def canonical(nodes: DataFrame) -> DataFrame:
    """(document_id, content): a document's nodes as one JSON object with sorted fields, in reading order."""
    fields = sorted(c for c in nodes.columns if c != "document_id")
    rows = nodes.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*[F.col(f"`{c}`") for c in fields]).alias("node")))).alias("x"))
    return rows.select("document_id", F.to_json(F.struct("document_id", F.transform("x", lambda r: r["node"]).alias("nodes"))).alias("content"))


def bundles(nodes: DataFrame, features: DataFrame, html: DataFrame) -> DataFrame:
    """(document_id, content, jsonld, html, manifest): all that an agent gets of a document, with a digest of each part."""
    item = F.struct("kind", "text", "importance", "ordinal")
    f = features.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "kind", "text", item.alias("f")))), lambda x: x["f"]).alias("features"))
    ld = f.select("document_id", F.to_json(F.struct(F.lit("Document").alias("@type"), F.col("document_id").alias("@id"), "features")).alias("jsonld"))
    both = canonical(nodes).join(ld, "document_id", "left").join(html.select("document_id", "html"), "document_id", "left").na.fill("", ["jsonld", "html"])
    sums = F.to_json(F.struct(*[F.sha2(c, 256).alias(c) for c in ("content", "html", "jsonld")]))
    return both.withColumn("manifest", sums)


def tampered(found: DataFrame) -> DataFrame:
    """(document_id) of bundles whose parts don't have the digests of their manifest."""
    said = F.from_json("manifest", "content string, html string, jsonld string")
    return found.where(~((said["content"] == F.sha2("content", 256)) & (said["html"] == F.sha2("html", 256)) & (said["jsonld"] == F.sha2("jsonld", 256)))).select("document_id")


# cells of a long run


class CellLog:
    """Cells that are done, appended batch by batch under a header that has to stay the same: a run that is started again does what is left."""

    def __init__(self, spark: SparkSession, path: str, header: dict):
        self.spark, self.path = spark, path
        text = json.dumps(header, sort_keys=True)
        if not exists(spark, f"{path}/header.json"):
            write_text(spark, f"{path}/header.json", text)
        elif read_text(spark, f"{path}/header.json") != text:
            raise ValueError("the log was begun by a run with other settings")

    def done(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/cells") if exists(self.spark, f"{self.path}/cells") else None

    def left(self, cells: DataFrame, key: str = "cell") -> DataFrame:
        done = self.done()
        return cells if done is None else cells.join(done.select(key), key, "left_anti")

    def append(self, results: DataFrame, key: str = "cell") -> None:
        """A batch that failed half-way left nothing that is read; one that is written again adds nothing twice."""
        self.left(results.dropDuplicates([key]), key).write.mode("append").parquet(f"{self.path}/cells")


