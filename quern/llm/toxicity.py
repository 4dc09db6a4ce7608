"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into windows of WINDOW words. A window's bag holds the character 2- to 6-grams of its
words with their word edges (a space stands for each edge), hashed into BUCKETS rows of an embedding table.
The mean of a bag's embeddings goes into a softmax over two classes. As a few toxic words in a
long text would drown in one mean, a text's score is that of its most toxic window; training
takes each labelled text by its windows: at first all of them, then the quarter, the sixteenth and at last the one that score highest.
Embeddings and softmax learn together by Adagrad. Misspelt words share n-grams with words that
were seen, and so their embeddings.

For scoring, embeddings and softmax collapse into one number for each bucket, so that a window's
log odds are a mean of numbers: one pass over the bytes in numpy, whole texts, no shuffle.

The fit uses a bounded sample of labelled rows: at most SAMPLE of them, those whose ids have the
least seeded hash, each with all its windows. Bags are made again in each pass, a few texts at a time: what
the driver holds are the sample's texts and the bags of the few windows that a pass chooses of each. Everything
else covers all rows.

Defined results: null, empty and blank texts have an empty bag, and the score of the bias alone;
a fit without labels of both classes gives every text the share of class 1, or 0.5 without any;
repeated rows get repeated results; other columns are ignored whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.llm.quality import held_out, sample
from quern.llm.shingles import pieces
from quern.runtime import prepare, table, tidy

SAMPLE = 6_000
WINDOW = 24
GRAMS = (2, 3, 4, 5, 6)
BITS = 17
DIMENSIONS = 8
#: Passes over the sample, and rounds over the windows that a pass chooses.
EPOCHS, ROUNDS = 4, 3
#: Bags of a step, and the least steps over the windows that a pass chooses: small samples take more rounds.
BAGS, STEPS = 128, 250
RATE = 0.5
#: Windows of one text together weigh at most as much as so many; the best ones of a clean text that the last pass uses.
FIRST_WEIGHT, CLEAN_WINDOWS = 8, 4
#: Bytes of text whose bags are made at a time.
PART = 1 << 19
#: Added to a bag's size in its mean: short bags are drawn towards the bias.
EASE = 40
TOXIC_FROM = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window of each n-gram, its bucket, first window of each text, windows of each text); a text without words has one empty window."""
    padded = b"".join([b" " + t + b" " for t in texts])
    x = _LOWER[np.frombuffer(padded, dtype=np.uint8)]
    end = np.cumsum([len(t) + 2 for t in texts])
    space = x == 32
    begins = np.zeros(len(x), dtype=np.bool_)
    begins[1:] = space[:-1] & ~space[1:]
    word = np.cumsum(begins)  # number of the word at or before each byte, over all texts
    words_before = np.r_[0, word[end - 1]]
    words = np.diff(words_before)
    windows = np.maximum(1, -(-words // WINDOW))
    first = np.cumsum(windows) - windows
    doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, end]))
    window_of = first[doc] + np.maximum(word - 1 - words_before[doc], 0) // WINDOW
    # a word that a window holds again adds nothing to its bag
    letter = np.flatnonzero(~space)
    with np.errstate(over="ignore"):
        spot = letter - np.flatnonzero(begins)[word[letter] - 1] + 1
        code = (x[letter].astype(np.uint64) + np.uint64(7)) * (spot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
    sums = np.r_[np.uint64(0), np.cumsum(code, dtype=np.uint64)]
    count = int(word[-1]) if len(word) else 0
    edges = np.searchsorted(letter, np.flatnonzero(begins))
    key = sums[np.r_[edges[1:], len(letter)].astype(np.int64)] - sums[edges] if count else np.zeros(0, np.uint64)
    holder = window_of[np.flatnonzero(begins)]
    by = np.lexsort((key, holder))
    again = np.r_[False, (key[by][1:] == key[by][:-1]) & (holder[by][1:] == holder[by][:-1])][:count]
    fresh = np.ones(count + 1, dtype=np.bool_)
    fresh[by[again] + 1] = False
    new = fresh[word]
    # an n-gram may begin and end with a space but hold none inside; it counts for the window of its last letter
    gap = np.cumsum(space)
    h = np.zeros(len(x), dtype=np.uint64)
    out_window, out_bucket = [], []
    v = x.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            m = len(x) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + v[n - 1 :]
            if n in GRAMS:
                if n == 2:
                    good = ~space[:m] & ~space[1:]
                else:
                    good = gap[n - 2 : n - 2 + m] == gap[:m]
                at = np.flatnonzero(good & new[n - 2 : n - 2 + m])
                mixed = (h[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                out_window.append(window_of[at + n - 2])
                out_bucket.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *out_window]), np.concatenate([empty, *out_bucket]), first, windows


@dataclass
class Model:
    """One number for each bucket, and the bias: log odds of a window are the mean over its bag plus the bias."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = 0.0
    constant: float | None = None

    def windows(self, window: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(window, self.weight[bucket], n)
        return total / (np.bincount(window, minlength=n) + EASE) + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        window, bucket, first, windows = bags(texts)
        odds = np.maximum.reduceat(self.windows(window, bucket, int(windows.sum())), first)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, bag sizes, text of each bag) for all windows that aren't empty, some texts at a time; a bag's buckets follow each other."""
    for lo, hi in pieces(texts, PART):
        window, bucket, _, windows = bags(texts[lo:hi])
        size = np.bincount(window, minlength=int(windows.sum()))
        owner = lo + np.repeat(np.arange(hi - lo), windows)
        yield bucket[np.argsort(window, kind="stable")].astype(np.int32), size[size > 0], owner[size > 0]


def _gathered(bucket: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the bags in rows, the place of each one's bag in rows)."""
    start = np.cumsum(size) - size
    n = size[rows]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return bucket[np.repeat(start[rows], n) + inside], np.repeat(np.arange(len(rows)), n)


@dataclass
class Joint:
    """What is learned together: an embedding for each bucket, the softmax's rows and biases, and Adagrad's sums of squares."""

    table: np.ndarray
    soft: np.ndarray
    bias: np.ndarray
    grown: tuple[np.ndarray, np.ndarray, np.ndarray]

    def step(self, bucket: np.ndarray, bag: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One batch of bags: the gradient of the softmax's cross entropy by softmax and embeddings."""
        n, d = size[:, None] + EASE, self.table.shape[1]
        mean = np.stack([np.bincount(bag, self.table[bucket, k], len(y)) for k in range(d)], axis=1) / n
        p = chances(mean, self.soft, self.bias)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None] / weight.sum()
        g_soft, g_bias, g_mean = p.T @ mean, p.sum(0), p @ self.soft / n * 64  # bags are long: a larger step for embeddings
        touched, inverse = np.unique(bucket, return_inverse=True)
        g = np.stack([np.bincount(inverse, g_mean[bag, k], len(touched)) for k in range(d)], axis=1)
        self.grown[0][touched] += (g**2).mean(1)
        self.table[touched] -= RATE * g / np.sqrt(self.grown[0][touched])[:, None]
        self.grown[1][:] += g_soft**2
        self.grown[2][:] += g_bias**2
        self.soft -= 0.1 * g_soft / np.sqrt(self.grown[1])
        self.bias -= 0.1 * g_bias / np.sqrt(self.grown[2])

    def collapsed(self) -> Model:
        """The same odds with one number for each bucket."""
        return Model(self.table @ (self.soft[1] - self.soft[0]), float(self.bias[1] - self.bias[0]))


def chances(mean: np.ndarray, soft: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logit = mean @ soft.T + bias
    p = np.exp(logit - logit.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def joint(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, dimensions: int = DIMENSIONS) -> Joint:
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    texts, labels = [texts[k] for k in order.tolist()], labels[order]
    bias = np.log(np.maximum(np.bincount(labels, minlength=2), 1) / len(labels))
    grown = np.full(1 << BITS, 1e-4), np.full((2, dimensions), 1e-4), np.full(2, 1e-4)
    model = Joint(rng.normal(0, 0.1, (1 << BITS, dimensions)), rng.normal(0, 0.1, (2, dimensions)), bias, grown)

    def learn(bucket: np.ndarray, size: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> None:
        for rows in np.array_split(rng.permutation(len(size)), max(1, len(size) // BAGS)):
            if len(rows):
                model.step(*_gathered(bucket, size, rows), size[rows], labels[owner[rows]], weight[rows])

    for epoch in range(epochs):
        if not epoch:  # all windows of all texts
            for bucket, size, owner in _parts(texts):
                windows = np.bincount(owner, minlength=len(texts))[owner]
                learn(bucket, size, owner, np.minimum(1.0, FIRST_WEIGHT / windows))
            continue
        flat = model.collapsed().weight
        chosen = []
        for bucket, size, owner in _parts(texts):  # each text by the windows that now score highest
            if not len(size):
                continue
            odds = np.bincount(np.repeat(np.arange(len(size)), size), flat[bucket], len(size)) / (size + EASE)
            ranked = np.lexsort((-odds, owner))
            head = np.r_[True, owner[ranked][1:] != owner[ranked][:-1]]
            place = np.arange(len(ranked)) - np.maximum.accumulate(np.where(head, np.arange(len(ranked)), 0))
            # at last the best window of a toxic text, and the best few of a clean one, which all have to be clean
            share = np.ceil(np.bincount(owner, minlength=len(texts))[owner[ranked]] / 4**epoch if epoch < epochs - 1 else np.zeros(len(ranked)))
            rows = np.sort(ranked[place < np.maximum(share, np.where(labels[owner[ranked]] == 1, 1, CLEAN_WINDOWS))])
            chosen.append((_gathered(bucket, size, rows)[0], size[rows], owner[rows]))
        if chosen:
            bucket, size, owner = (np.concatenate(c) for c in zip(*chosen, strict=True))
            kept = np.bincount(owner, minlength=len(texts))[owner]
            for _ in range(max(ROUNDS, STEPS * BAGS // max(1, len(size)))):
                learn(bucket, size, owner, np.minimum(1.0, FIRST_WEIGHT / kept))
    return model


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, dimensions: int = DIMENSIONS) -> Model:
    if len(set(labels.tolist())) < 2:
        return Model(constant=float(labels.mean()) if len(labels) else 0.5)
    return joint(texts, labels, seed, epochs, dimensions).collapsed()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the driver; the sample's texts come one partition at a time and are sorted, so that a rerun agrees."""
    rows = sorted((bytes(r.text or b""), r.label) for r in sample(docs, labels, label, most, "toxic/", id_col, text_col).toLocalIterator())
    return fit([t for t, _ in rows], np.array([y for _, y in rows], dtype=np.int64))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score in 0 to 1 for each whole text; one pass, no shuffle. A column named score_col is replaced.

    The model, 2**BITS numbers, is broadcast once.
    """
    spark = docs.sparkSession
    prepare(spark)
    rest = [c for c in docs.columns if c != score_col]
    source = docs.select(*rest).withColumn(score_col, F.col(text_col).cast("string").cast("binary"))
    schema = StructType([*docs.select(*rest).schema.fields, StructField(score_col, DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(score_col)
            texts = [t or b"" for t in b.column(at).to_pylist()]
            found = [shared.value.score(texts[lo:hi]) for lo, hi in pieces(texts)]  # about a MB of text at a time, whatever the batch
            columns = [pa.array(np.concatenate([np.zeros(0), *found])) if k == at else b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)
        tidy()

    return source.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
