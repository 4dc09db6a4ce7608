"""URL filter: rules on host and path first, then two character language models.

Every url that a rule decides is a training string for the model of accepted or of rejected urls.
Each model is a smoothed variable-order Markov model: the chance of a byte after its longest
context of up to ORDER bytes, interpolated (Witten-Bell) down to a uniform chance. The
verdict compares the difference of the two log-likelihoods, divided by the length, with a
threshold calibrated on strings held out of the counts (crc32 of the url, remainder 0 by 5).

Counts cover all urls and are exact: a byte with its context of ORDER bytes is a gram, a number of 48 bits, and how often
each gram occurs is a stored table that grows with the urls. Contexts of 2 bytes and more are summed from
the grams of one bucket, as a bucket holds all grams with the same two bytes before the last; what shorter contexts need
is 2 x 256 x 256 counts, the only ones that the driver gathers. To score, the different grams of each chunk of urls
go to the buckets and come back with their difference.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule, and
its whole text (null: none) goes to the models; an empty string has a difference of 0 and is
allowed; without strings of both kinds, or with none held out, the threshold is 0, and without any
training strings everything is allowed. Repeated rows get repeated results; other columns are
ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.llm.shingles import mix
from quern.runtime import partitions, prepare, stored, table

ORDER = 5
#: Buckets of grams, as bits: they grow with the urls, and there are no more than contexts of two bytes.
MIN_BITS, MAX_BITS = 5, 16
#: Urls for each bucket, and rows in each chunk that is scored at once.
BUCKET_URLS, CHUNK_ROWS = 1 << 15, 50_000
#: Grams that a task counts before it sends them on.
HELD_GRAMS = 1 << 20
#: (rule, verdict): host, then the beginning of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# rules


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null; of rules as long, the first by code point."""
    found = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return found if found is not None else F.lit(None).cast("string")


def with_rules(pages: DataFrame, rules=RULES, *, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep..., url, host, path, rule, ruled): ruled is the rule's verdict or null."""
    base = pages.select(*[F.col(c) for c in keep], F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    base = base.select(*keep, "_url", host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.create_map(*[F.lit(x) for r in rules for x in r])[F.col("rule")] if rules else F.lit(None).cast("string")
    return base.withColumn("ruled", verdict)


# language models


def grams(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each string its gram, which is the ORDER bytes before it and the byte, and the string of each byte.

    Contexts at a string's start hold zeros in place of bytes before it.
    """
    size = np.array([len(s) for s in strings], dtype=np.int64)
    x = np.frombuffer(b"".join([b"\0" * ORDER + s for s in strings]), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(strings)), size)
    at = np.arange(size.sum()) + (owner + 1) * ORDER
    gram = np.zeros(len(at), dtype=np.int64)
    for k in range(ORDER, -1, -1):
        gram = (gram << 8) | x[at - k]
    return gram, owner


def _bucket(gram: np.ndarray, bits: int) -> np.ndarray:
    """Grams with the same two bytes before the last share a bucket."""
    return (mix(((gram >> 8) & 0xFFFF).astype(np.uint64)) % np.uint64(1 << bits)).astype(np.int64)


def _low(gram: np.ndarray, k: int) -> np.ndarray:
    """What is left of grams for contexts of k bytes."""
    return gram & ((1 << (8 * (k + 1))) - 1)


def _step(p: np.ndarray, asked: np.ndarray, have: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Chances p after one more order: asked are grams of that order, have (ascending) those that occur n times."""
    first = np.flatnonzero(np.r_[True, (have[1:] >> 8) != (have[:-1] >> 8)]) if len(have) else np.zeros(0, np.int64)
    if not len(first):
        return p
    context, seen, kinds = have[first] >> 8, np.add.reduceat(n, first), np.diff(np.r_[first, len(have)])
    c = np.minimum(np.searchsorted(context, asked >> 8), len(context) - 1)
    known = context[c] == asked >> 8
    g = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    pair = np.where(have[g] == asked, n[g], 0)
    return np.where(known, (pair + kinds[c] * p) / (seen[c] + kinds[c]), p)


def _differences(asked: np.ndarray, have: np.ndarray, counts: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Log of the chance of each asked gram as accepted less that as rejected.

    have, counts: grams (ascending) of the asked ones' buckets and how often each model saw them, (2, grams); short: counts by [model, byte before, byte].
    """
    total = np.zeros(len(asked))
    for model, sign in ((0, -1.0), (1, 1.0)):
        p = np.full(len(asked), 1 / 256)
        single, pairs = short[model].sum(0), short[model].reshape(-1)
        for k, n in ((0, single), (1, pairs)):
            own = np.flatnonzero(n)
            p = _step(p, _low(asked, k), own, n[own])
        own = counts[model] > 0
        g, n = have[own], counts[model][own]
        for k in range(2, ORDER + 1):
            low, back = np.unique(_low(g, k), return_inverse=True)
            p = _step(p, _low(asked, k), low, np.bincount(back, n, len(low)).astype(np.int64))
        total += sign * np.log(p)
    return total


@dataclass
class Model:
    """counts: stored (bucket, grams binary, reject binary, accept binary), the grams of a bucket and how often each model saw them; short: counts by [model, byte before, byte]."""

    bits: int
    counts: DataFrame
    short: np.ndarray
    threshold: float = 0.0

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (text binary, and others) with difference: the log-likelihood as accepted less that as rejected, divided by length; 0 for an empty string, null for null."""
        spark, bits = rows.sparkSession, self.bits
        prepare(spark)
        shared = spark.sparkContext.broadcast(self.short)
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
        chunks = max(partitions(spark), -(-rows.count() // CHUNK_ROWS))
        rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks))).drop("_row")

        def ask(t: pa.Table) -> pa.Table:
            gram = np.unique(grams(t.column("text").to_pylist())[0])
            bucket = _bucket(gram, bits)
            order = np.argsort(bucket, kind="stable")
            gram, bucket = gram[order], bucket[order]
            cuts = _cuts(bucket)
            chunk = t.column("_chunk")[0].as_py()
            return pa.table({"bucket": pa.array([int(bucket[a]) for a, _ in cuts], pa.int64()), "chunk": pa.array([chunk] * len(cuts), pa.int64()), "grams": pa.array([gram[a:z].tobytes() for a, z in cuts], pa.binary())})

        def answer(asks: pa.Table, own: pa.Table) -> pa.Table:
            have, reject, accept = (_flat(own, c) for c in ("grams", "reject", "accept"))
            asked = asks.column("grams").to_pylist()
            one, back = np.unique(_flat(asks, "grams"), return_inverse=True)
            found = _differences(one, have, np.stack([reject, accept]), shared.value)[back]
            ends = np.cumsum([len(g) // 8 for g in asked]).tolist()
            return pa.table({"chunk": asks.column("chunk"), "grams": pa.array(asked, pa.binary()), "found": pa.array([found[z - len(g) // 8 : z].tobytes() for g, z in zip(asked, ends, strict=True)], pa.binary())})

        asks = rows.where("length(text) > 0").select("_chunk", "text").groupBy("_chunk").applyInArrow(ask, "bucket long, chunk long, grams binary")
        answers = asks.groupBy("bucket").cogroup(self.counts.groupBy("bucket")).applyInArrow(answer, "chunk long, grams binary, found binary")
        schema = StructType([f for f in rows.schema.fields if f.name != "_chunk"] + [StructField("difference", DoubleType())])

        def put(t: pa.Table, found: pa.Table) -> pa.Table:
            have, d = _flat(found, "grams"), _flat(found, "found", np.float64)
            order = np.argsort(have)
            have, d = have[order], d[order]
            texts = t.column("text").to_pylist()
            strings = [x or b"" for x in texts]
            gram, owner = grams(strings)
            total = np.bincount(owner, d[np.searchsorted(have, gram)], len(strings)) if len(gram) else np.zeros(len(strings))
            total = total / np.maximum([len(x) for x in strings], 1)
            out = t.drop_columns(["_chunk"])
            return out.append_column("difference", pa.array([None if x is None else v for x, v in zip(texts, total.tolist(), strict=True)], pa.float64()))

        return rows.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(put, schema)

    def differences(self, strings: list[bytes]) -> np.ndarray:
        """scored() for strings at hand."""
        rows = self.counts.sparkSession.createDataFrame([(k, bytearray(s)) for k, s in enumerate(strings)], "place long, text binary")
        return np.array([r.difference for r in sorted(self.scored(rows).collect(), key=lambda r: r.place)])


def _cuts(v: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    return list(zip(first.tolist(), np.r_[first, len(v)][1:].tolist(), strict=True))


def _flat(t: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=kind)


def _strings(column: pa.Array) -> list[bytes]:
    return [(u or "").encode() for u in column.to_pylist()]


def train(ruled: DataFrame) -> Model:
    """Counts over all urls with a rule's verdict; with_rules() gives the rows. Copies of a url count as often as they occur."""
    spark = ruled.sparkSession
    prepare(spark)
    decided = ruled.where("ruled IS NOT NULL").select(F.col("_url").alias("url"), (F.col("ruled") == "allow").cast("int").alias("model"), (F.crc32(F.col("_url").cast("binary")) % 5 == 0).alias("held"))
    bits = int(np.clip((decided.count() // BUCKET_URLS).bit_length(), MIN_BITS, MAX_BITS))

    def packed(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = _bucket(gram, bits)
        order = np.argsort(bucket, kind="stable")
        gram, n, bucket = gram[order], n[:, order], bucket[order]
        cuts = _cuts(bucket)
        columns = [pa.array([x[a:z].tobytes() for a, z in cuts], pa.binary()) for x in (gram, n[0], n[1])]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in cuts], pa.int64()), *columns], ["bucket", "grams", "reject", "accept"])

    def added(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, back = np.unique(gram, return_inverse=True)
        return one, np.stack([np.bincount(back, x, len(one)).astype(np.int64) for x in n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        for b in batches:
            model = np.array(b.column("model").to_pylist(), dtype=np.int64)
            g, owner = grams(_strings(b.column("url")))
            own = model[owner]
            gram, n = added(np.r_[gram, g], np.concatenate([n, np.stack([own == 0, own == 1]).astype(np.int64)], axis=1))
            if len(gram) > HELD_GRAMS:
                yield from packed(gram, n)
                gram, n = gram[:0], n[:, :0]
        yield from packed(gram, n)

    def summed(t: pa.Table) -> pa.Table:
        gram, n = added(_flat(t, "grams"), np.stack([_flat(t, "reject"), _flat(t, "accept")]))
        return pa.table({"bucket": t.column("bucket")[:1], "grams": pa.array([gram.tobytes()], pa.binary()), "reject": pa.array([n[0].tobytes()], pa.binary()), "accept": pa.array([n[1].tobytes()], pa.binary())})

    schema = "bucket long, grams binary, reject binary, accept binary"
    parts = decided.where("NOT held").select("url", "model").mapInArrow(run, schema)
    counts = stored(parts.groupBy("bucket").applyInArrow(summed, schema), "url-counts")

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << 16), dtype=np.int64)
        for b in batches:
            gram = _flat(b, "grams")
            for model, c in enumerate(("reject", "accept")):
                np.add.at(total[model], _low(gram, 1), _flat(b, c))
        m, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[m, pair])], ["model", "pair", "n"])

    found = counts.mapInArrow(shortened, "model int, pair int, n long").groupBy("model", "pair").agg(F.sum("n").alias("n")).toPandas()
    short = np.zeros((2, 1 << 16), dtype=np.int64)
    short[found.model.to_numpy(int), found.pair.to_numpy(int)] = found.n.to_numpy(int)
    model = Model(bits, counts, short.reshape(2, 256, 256))
    model.threshold = _threshold(decided.where("held").select("url", "model"), model)
    return model


def _threshold(held: DataFrame, model: Model) -> float:
    """Where accepted and rejected held-out strings are told apart best (mean of the two shares), from a histogram of their differences."""
    edges = np.linspace(-4, 4, 801)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(edges) + 1), dtype=np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column("difference").to_numpy(zero_copy_only=False), side="right")
            np.add.at(total, (np.array(b.column("model").to_pylist(), dtype=np.int64), at), 1)
        m, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[m, at])], ["model", "at", "n"])

    scored = model.scored(held.select("model", F.col("url").cast("binary").alias("text"))).select("model", "difference")
    found = scored.mapInArrow(run, "model int, at int, n long").groupBy("model", "at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, len(edges) + 1))
    total[found.model.to_numpy(int), found["at"].to_numpy(int)] = found.n.to_numpy(float)
    if not total.sum(1).all():
        return 0.0
    share = np.cumsum(total, axis=1)[:, :-1] / total.sum(1, keepdims=True)  # below each edge
    gain = share[0] + 1 - share[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(edges[best[len(best) // 2]])


def judge(ruled: DataFrame, model: Model) -> DataFrame:
    """ruled's rows with difference (null where a rule decides) and verdict."""
    text = F.when(F.col("ruled").isNull(), F.coalesce(F.col("_url"), F.lit("")).cast("binary"))
    scored = model.scored(ruled.withColumn("text", text))
    verdict = F.when((F.length("text") == 0) | (F.col("difference") >= model.threshold), "allow").otherwise("block")
    return scored.select(*ruled.columns, "difference", F.coalesce("ruled", verdict).alias("verdict"))


def op8_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    ruled = with_rules(table(spark, sf_dir, "pages"))
    return judge(ruled, train(ruled)).select("page_id", "host", "path", "rule", "verdict", "difference")
