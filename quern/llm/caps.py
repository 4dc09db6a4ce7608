"""Embedding near-dedup by spherical-cap filters.

Filter directions are structured random product codes: a seeded rotation splits a unit vector into two halves, each half has
a random code of SIZE unit vectors, and every pair of code words is a direction. A vector belongs to all directions whose
inner product with it exceeds a threshold; list decoding finds them without looking at all pairs: the words of one half in
order of score, cut off by what the best word of the other half can add. Vectors that share a
direction meet and are compared exactly, in double precision. Similar vectors share many directions.

The number of directions grows with the number of vectors, so that a direction holds about HOLDS vectors and a vector has
about LIST directions at every size. A direction that holds more than TILE vectors is split into tiles, and each pair of
tiles is a task's group of its own.

Equal vectors are one class from the start: they are compared once, whatever their number, and count as links of each other.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths don't link; rows that share an id are one node, each reported; a null id has a null component and isn't linked; ids of
vectors, not labels, decide; other columns are ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.runtime import input_bytes, partitions, prepare, stored, table, tidy

SIMILAR = 0.9
LIST, HOLDS, TILE = 32, 512, 1024
#: A vector has at least so many directions: its best ones, if fewer exceed the threshold.
LEAST = 16
SEED = 11
#: Bytes of vectors for each group of filters.
HOME_BYTES = 4 << 20


@functools.lru_cache(maxsize=4)
def code(dimensions: int, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, words of the first half, words of the second half)."""
    r = np.random.default_rng([seed, dimensions, size])
    rotation = np.linalg.qr(r.normal(size=(dimensions, dimensions)))[0]
    halves = []
    for n in (dimensions // 2, dimensions - dimensions // 2):
        w = r.normal(size=(size, max(n, 1)))
        halves.append(w / np.linalg.norm(w, axis=1, keepdims=True))
    return rotation, halves[0], halves[1]


def size_for(vectors: int) -> int:
    """Words in each half's code."""
    return int(np.clip(np.ceil(np.sqrt(LIST * max(vectors, 1) / HOLDS)), 4, 1 << 20))


def threshold(dimensions: int, size: int) -> float:
    """Inner product that a random vector exceeds with LIST of the directions."""
    share = min(0.45, LIST / size**2)
    return NormalDist().inv_cdf(1 - share) / np.sqrt(dimensions) * np.sqrt(2)  # of the sum of both halves


def decode(units: np.ndarray, size: int) -> list[np.ndarray]:
    """Directions (first word * size + second word) of each unit vector."""
    d = units.shape[1]
    rotation, first, second = code(d, size)
    x = units @ rotation
    a, b = x[:, : d // 2] @ first.T if d > 1 else np.zeros((len(x), size)), x[:, d // 2 :] @ second.T
    least, out = threshold(d, size), []
    for s, t in zip(a, b, strict=True):
        order = np.argsort(-t)
        falling = -t[order]
        limit = least
        for _ in range(8):
            live = np.flatnonzero(s >= limit + falling[0])
            count = np.searchsorted(falling, s[live] - limit, side="right")
            if int(count.sum()) >= LEAST:
                break
            limit -= 0.05
        total = int(count.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        found = np.repeat(live, count) * size + order[inside]
        if limit < least and total > LEAST:  # of the loosened list, the best ones
            found = found[np.argsort(-(s[found // size] + t[found % size]), kind="stable")[:LEAST]]
        out.append(found)
    return out


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw, mark): vectors that can link, packed in their own precision, and a digest of them."""
    prepare(vectors.sparkSession)
    v, kind = F.col(vector_col), precision(vectors, vector_col)
    good = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    source = vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.asarray(x, dtype=kind).tobytes() for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(raw, pa.binary())], ["id", "raw"])

    return source.mapInArrow(run, "id long, raw binary").withColumn("mark", F.md5("raw"))


def precision(vectors: DataFrame, vector_col: str) -> str:
    return "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"


def units_of(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, in double precision and of length one."""
    x = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no squares that overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def class_links(classes: DataFrame, least: float = SIMILAR, kind: str = "<f4") -> DataFrame:
    """(a, b), a < b: linked classes (id, raw), each pair once."""
    spark = classes.sparkSession
    n = classes.count()
    size = size_for(n)

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column("id").to_pylist(), b.column("raw").to_pylist()
            by: dict[int, list[int]] = {}
            for k, r in enumerate(raw):
                by.setdefault(len(r), []).append(k)
            out_id, out_filter = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for length, at in by.items():
                for k, found in zip(at, decode(units_of([raw[k] for k in at], kind), size), strict=True):
                    out_id.append(np.full(len(found), ids[k]))
                    out_filter.append(found * 4099 + length // 4 % 4099)  # vectors of other lengths never meet
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_filter))], ["id", "direction"])

    listed = stored(classes.select("id", "raw").mapInArrow(directions, "id long, direction long"), "directions")
    counts = listed.groupBy("direction").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    seats = listed.join(counts, "direction").withColumn("k", tiles).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    seats = seats.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    seats = seats.select("id", "direction", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    # groups grow with the vectors: a vector goes to about LIST of them with its bytes, place and filter
    homes = max(8 * partitions(spark), 2 * LIST * input_bytes(classes) // HOME_BYTES)
    home = F.pmod(F.xxhash64("direction", "x", "y"), F.lit(homes))
    placed = seats.join(classes.select("id", "raw"), "id").withColumn("home", home)

    def compare(t: pa.Table) -> pa.Table:
        ids, raw, own = t.column("id").to_numpy(), t.column("raw").to_pylist(), t.column("own").to_numpy()
        x, y, direction = t.column("x").to_numpy(), t.column("y").to_numpy(), t.column("direction").to_numpy()
        order = np.lexsort((ids, y, x, direction))
        key = np.stack([direction[order], x[order], y[order]])
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        out = [np.zeros((2, 0), np.int64)]
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            at = order[a:z]
            u = units_of([raw[k] for k in at.tolist()], kind)
            cross = x[at[0]] != y[at[0]]
            i, j = np.nonzero(np.triu(u @ u.T >= least - 1e-12, 1))
            if cross:
                apart = own[at][i] != own[at][j]
                i, j = i[apart], j[apart]
            good = np.einsum("ij,ij->i", u[i], u[j]) >= least
            p, q = ids[at][i[good]], ids[at][j[good]]
            out.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        del t, raw, out
        tidy()
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return placed.groupBy("home").applyInArrow(compare, "a long, b long").where("a <> b").distinct()


def near_duplicates(vectors: DataFrame, least: float = SIMILAR, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors."""
    found = stored(valid(vectors, id_col, vector_col), "vectors")
    classes = found.groupBy("mark").agg(F.min("id").alias("id"), F.count("*").alias("members"), F.first("raw").alias("raw"))
    classes = stored(classes, "classes")
    links = stored(class_links(classes, least, precision(vectors, vector_col)), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.groupBy("id").agg(F.sum("members").alias("members"))
    degree = both.join(sizes.select(F.col("id").alias("b"), "members"), "b").groupBy("a").agg(F.sum("members").alias("others"))
    reached = components(links, "caps")
    of_class = sizes.join(degree.withColumnRenamed("a", "id"), "id", "left").join(reached, "id", "left").select(
        "id", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    per_row = found.select("id", "mark").distinct().join(classes.select("mark", F.col("id").alias("of")), "mark").join(of_class.withColumnRenamed("id", "of"), "of")
    per_id = per_row.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = vectors.select(F.col(id_col).cast("long").alias("id")).join(per_id, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of at least 0.9 between embeddings, and their classes."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
