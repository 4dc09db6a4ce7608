"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

describe() turns a text into a few transformed statistics, all from whole texts. Each class k has
a mean and a covariance S_k, shrunk towards the pooled covariance and that one's diagonal:
    C_k = (1 - a) ((1 - b) S_k + b S) + a diag(S)
The score is the posterior of class 1, from the difference of the two log densities (half the
squared Mahalanobis distances plus log determinants), by way of Cholesky factors that are
computed once and sent along with the model.

The fit uses a bounded sample of labelled rows: at most SAMPLE of them, those whose ids have the
least seeded hash. Everything else covers all rows.

Defined results: null and empty texts are described by zeros and get a score like any other; rows
with null labels aren't used; a doc_id with several labels counts once for each; without labels of
both classes the score is the share of class 1 among the labels, or 0.5 without any; repeated rows
get repeated results; other columns are ignored whatever their names; an empty table gives an empty
table.
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
from quern.runtime import fresh, prepare, table, tidy

#: Most labelled rows that a fit uses.
SAMPLE = 20_000
SHRINK_TO_POOLED, SHRINK_TO_DIAGONAL = 0.2, 0.05
KEEP_FROM = 0.3

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "stops", "commas", "line_feeds", "symbol_runs", "distinct_words", "capitals_inside",
)

_UPPER, _DIGIT, _SYMBOL, _STOP, _COMMA, _LINE, _SPACE = (np.zeros(256, np.bool_) for _ in range(7))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STOP[[ord(c) for c in ".?!:;"]] = True
_COMMA[ord(",")] = True
_LINE[10] = True
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,:;?'\"-()"]] = True


def describe(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; a megabyte of text, or one text, at a time."""
    out, lo = [np.zeros((0, len(STATISTICS)))], 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) < 1 << 20):
            total += len(texts[hi])
            hi += 1
        out.append(_describe(texts[lo:hi]))
        lo = hi
    return np.concatenate(out)


def _describe(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    if not size.sum():
        return out
    x = np.frombuffer(b"".join(texts), dtype=np.uint8)
    doc_end = np.cumsum(size)
    doc_start = doc_end - size

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return (total[doc_end] - total[doc_start]).astype(float)

    space = _SPACE[x]
    begin = ~space  # words begin where no space is, after one or at the text's start
    begin[1:] &= space[:-1]
    begin[doc_start[size > 0]] = ~space[doc_start[size > 0]]
    at = np.flatnonzero(begin)
    words = count(begin)
    letters = np.maximum(count(~space), 1)
    doc_of = np.searchsorted(doc_end, at, side="right")
    # a word's length: bytes up to the next space or the text's end
    gaps = np.flatnonzero(space)
    after = np.searchsorted(gaps, at)
    stop = np.minimum(np.where(after < len(gaps), gaps[np.minimum(after, len(gaps) - 1)] if len(gaps) else len(x), len(x)), doc_end[doc_of])
    length = (stop - at).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(doc_of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc_of, length**2, n) / some - mean**2, 0))
    # distinct words by a hash of each whole word, as a share of the square root law's expectation: codes of bytes at their places, summed by word
    letter = np.flatnonzero(~space)
    edge = np.searchsorted(letter, at)
    spot = (letter - np.repeat(at, np.diff(np.r_[edge, len(letter)]))).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = mix((spot << np.uint64(8) | x[letter].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        total = np.r_[np.uint64(0), np.cumsum(code, dtype=np.uint64)]
        key = mix(total[np.r_[edge[1:], len(letter)].astype(np.int64)] - total[edge]) if len(at) else np.zeros(0, np.uint64)
    mixed = np.sort((key >> np.uint64(24)) | (doc_of.astype(np.uint64) << np.uint64(40)))
    first = np.r_[True, mixed[1:] != mixed[:-1]]
    distinct = np.bincount((mixed[first] >> np.uint64(40)).astype(np.int64), minlength=n)
    upper, symbol = _UPPER[x], _SYMBOL[x]
    runs = symbol.copy()
    runs[1:] &= symbol[:-1]
    runs[0] = False
    inside = upper.copy()
    inside[1:] &= ~space[:-1]
    inside[0] = False
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2], out[:, 3] = np.log1p(mean), np.log1p(spread)
    for k, flags in ((4, upper), (5, _DIGIT[x]), (6, symbol), (7, _STOP[x]), (8, _COMMA[x]), (9, _LINE[x]), (10, runs), (12, inside)):
        out[:, k] = np.sqrt(count(flags) / letters)
    out[:, 11] = np.log1p(distinct) - 0.9 * np.log1p(words)
    return out


@dataclass
class Model:
    """Two Gaussians: means, inverses of Cholesky factors, log determinants with log priors. Constant if one class is missing."""

    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    offset: np.ndarray | None = None
    constant: float = 0.5

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(rows), self.constant)
        z = [np.einsum("ij,ij->i", y, y) for y in ((rows - self.mean[k]) @ self.whiten[k].T for k in (0, 1))]
        odds = self.offset[1] - self.offset[0] - 0.5 * (z[1] - z[0])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(rows: np.ndarray, labels: np.ndarray, to_pooled: float = SHRINK_TO_POOLED, to_diagonal: float = SHRINK_TO_DIAGONAL) -> Model:
    found = [rows[labels == k] for k in (0, 1)]
    if min(map(len, found)) < 2:
        return Model(constant=float(labels.mean()) if len(labels) else 0.5)
    d = rows.shape[1]
    mean = np.array([x.mean(0) for x in found])
    own = [(x - m).T @ (x - m) / len(x) for x, m in zip(found, mean, strict=True)]
    pooled = sum(len(x) * s for x, s in zip(found, own, strict=True)) / len(rows)
    diagonal = np.diag(np.diag(pooled) + 1e-6)
    whiten, offset = [], []
    for x, s in zip(found, own, strict=True):
        factor = np.linalg.cholesky((1 - to_diagonal) * ((1 - to_pooled) * s + to_pooled * pooled) + to_diagonal * diagonal)
        whiten.append(np.linalg.solve(factor, np.eye(d)))
        offset.append(np.log(len(x) / len(rows)) - np.log(np.diag(factor)).sum())
    return Model(mean, np.array(whiten), np.array(offset))


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; such labels are never used."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text binary, label int) of at most `most` labelled rows that aren't held out, chosen by a seeded hash of the id.

    The chosen ids are at most `most` rows, which bounds what is broadcast.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.md5(F.concat(F.lit(seed), F.col("_id").cast("string"))), "_id", "label")
        .limit(most)
    )
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("text")).join(F.broadcast(chosen), "_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    prepare(docs.sparkSession)
    names = ", ".join(f"{c} double" for c in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = describe([t or b"" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in rows.T], b.column("label")], [*STATISTICS, "label"])

    found = sample(docs, labels, label, most, "quality/", id_col, text_col).mapInArrow(run, f"{names}, label int").toPandas()
    found = found.sort_values(list(found.columns), kind="stable")  # sums don't depend on the order of arrival
    return fit(found[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), found["label"].to_numpy(int))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score in 0 to 1 for each whole text; one pass, no shuffle. A column named score_col is replaced."""
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c != score_col]
    source = docs.select(*rest).withColumn(score_col, F.col(text_col).cast("string").cast("binary"))
    schema = StructType([*docs.select(*rest).schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(score_col)
            found = pa.array(model.score(describe([t or b"" for t in b.column(at).to_pylist()])))
            columns = [found if k == at else b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)
        tidy()

    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, labels: DataFrame, least: float = KEEP_FROM) -> DataFrame:
    """The rows of docs whose score is at least `least`; docs' columns."""
    name = fresh("quality", docs)
    scored = score(docs, train(docs, labels), score_col=name)
    return scored.where(F.col(name) >= least).select(*docs.columns)


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
