"""Token files: ids under a static range asymmetric numeral system (rANS).

A shard is one file image. It starts with a frequency table that all its blocks share. Each block
is coded by itself: ids are dealt in turn to LANES interleaved coders with 64-bit states and 32-bit
words, so that one step codes LANES ids. The index holds a checkpoint for each block (its first
id, its place and size, its number of words) and a checksum, so that any block can be decoded
alone and in parallel; and the documents' ids and lengths. write_shards() makes shards in
ascending order of document ids: a range partitioning, a sort within it, and no step that needs
all of a corpus. Spark has no writer for binary files and workers may not reach a store that Spark does, so an image is
a value of a binary column that Spark writes and reads; any store that Spark reaches will do, and `image` written as a file is the file.

Layout, all little-endian: magic, header (counts), symbols, frequencies, document ids, their null
flags and lengths, checkpoints, header's checksum, blocks (final states, then words).

Defined results: a null or empty text holds the end id alone; documents that share an id follow
each other in the order of their texts, null first; null ids come first and read back as null;
other columns are ignored whatever their names; an empty table gives no shards and reads back as
no rows. A checksum that doesn't fit raises ValueError.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.words import UnitCache
from quern.runtime import prepare, stored, table, tidy

TOKENIZER = "byte_bpe_50k.json"
END = 0
MAGIC = b"QRANS1\0\0"
#: Frequencies of a table add up to 2**SCALE; states stay in [2**31, 2**63).
SCALE = 18
LOW = np.uint64(1 << 31)
LANES = 1024
BLOCK = 1 << 18
#: Ids after which a shard is closed, at the end of a document.
SHARD = 1 << 20


# coding


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies that add up to 2**SCALE, each at least 1)."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError("too many symbols for one table")
    total = 1 << SCALE
    f = np.maximum(1, counts * total // max(1, counts.sum()))
    order = np.argsort(-f, kind="stable")
    while (rest := total - int(f.sum())) != 0 and len(f):
        if rest > 0:
            f[order[0]] += rest
        else:
            spare = np.minimum(f[order] - 1, np.maximum(1, f[order] // 8))
            cut = np.minimum(spare, np.maximum(0, -rest - (np.cumsum(spare) - spare)))
            f[order] -= cut
    return symbols.astype(np.uint32), f.astype(np.uint32)


def encode_block(index: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(final states, words in the order in which a decoder takes them) for indices into the table."""
    steps = -(-len(index) // LANES)
    state = np.full(LANES, LOW, dtype=np.uint64)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    f_all, c_all = freq[index].astype(np.uint64), start[index].astype(np.uint64)
    room = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        f, c = f_all[t * LANES : (t + 1) * LANES], c_all[t * LANES : (t + 1) * LANES]
        x = state[: len(f)]
        full = x >= (f << room)
        out[t] = x[full].astype(np.uint32)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << np.uint64(SCALE)) + (x - q * f) + c
    return state, np.concatenate(out) if out else np.zeros(0, np.uint32)


def decode_block(state: np.ndarray, words: np.ndarray, n: int, slot: np.ndarray, freq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Indices into the table."""
    state, at = state.copy(), 0
    out = np.empty(n, dtype=np.int64)
    mask = np.uint64((1 << SCALE) - 1)
    freq, start = freq.astype(np.uint64), start.astype(np.uint64)
    for lo in range(0, n, LANES):
        m = min(LANES, n - lo)
        x = state[:m]
        low = x & mask
        s = slot[low]
        out[lo : lo + m] = s
        x = freq[s] * (x >> np.uint64(SCALE)) + low - start[s]
        empty = x < LOW
        k = int(np.count_nonzero(empty))
        if k:
            x[empty] = (x[empty] << np.uint64(32)) | words[at : at + k]
            at += k
        state[:m] = x
    if at != len(words) or not (state == LOW).all():
        raise ValueError("a block's words don't fit its states")
    return out


_HEADER = struct.Struct("<8sIIQII")  # magic, symbols, documents, ids, blocks, lanes
_POINT = np.dtype([("first", "<u8"), ("place", "<u8"), ("size", "<u8"), ("ids", "<u4"), ("words", "<u4"), ("crc", "<u4"), ("pad", "<u4")])


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    symbols, freq = frequencies(ids)
    start = np.cumsum(freq) - freq
    if len(symbols) and int(symbols[-1]) < 1 << 22:
        place = np.zeros(int(symbols[-1]) + 1, dtype=np.int64)
        place[symbols] = np.arange(len(symbols))
        index = place[ids]
    else:
        index = np.searchsorted(symbols, ids)
    points, blocks, place = np.zeros(-(-len(ids) // BLOCK), dtype=_POINT), [], 0
    for k in range(len(points)):
        part = index[k * BLOCK : (k + 1) * BLOCK]
        state, words = encode_block(part, freq, start)
        data = state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        points[k] = (k * BLOCK, place, len(data), len(part), len(words), zlib.crc32(data), 0)
        blocks.append(data)
        place += len(data)
    head = b"".join(
        [
            _HEADER.pack(MAGIC, len(symbols), len(doc_ids), len(ids), len(points), LANES),
            symbols.astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(),
            np.array([i is None for i in doc_ids], dtype="u1").tobytes(),
            np.array(lengths, dtype="<u4").tobytes(),
            points.tobytes(),
        ]
    )
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


class Shard:
    """A file image: its documents, and any block or all ids."""

    def __init__(self, data: bytes):
        self.data = data
        magic, symbols, docs, self.n, blocks, lanes = _HEADER.unpack_from(data)
        if magic != MAGIC or lanes != LANES:
            raise ValueError("not a token file of this format")
        at = _HEADER.size

        def take(kind, n):
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        self.symbols, self.freq = take("<u4", symbols), take("<u4", symbols)
        ids, null, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.points = take(_POINT, blocks)
        if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
            raise ValueError("the header's checksum doesn't fit")
        self.base = at + 4
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(symbols), self.freq)

    def block(self, k: int) -> np.ndarray:
        p = self.points[k]
        lo = self.base + int(p["place"])
        data = self.data[lo : lo + int(p["size"])]
        if zlib.crc32(data) != p["crc"]:
            raise ValueError(f"the checksum of block {k} doesn't fit")
        state = np.frombuffer(data, dtype="<u8", count=LANES)
        words = np.frombuffer(data, dtype="<u4", offset=8 * LANES)
        return self.symbols[decode_block(state, words, int(p["ids"]), self.slot, self.freq, self.start)]

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self.block(k) for k in range(len(self.points)))])


# columns


#: Units that a worker remembers; the library learns a unit at a higher price than op1's trees.
CACHE_UNITS = 800_000


#: Words that the library's model takes in one call.
TOGETHER = 200

#: Units that the pattern matches as a whole, and that are letters in every version of Unicode.
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch


def _alphabet() -> str:
    """The character by which a byte-level tokenizer writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return "".join(name[b] for b in range(256))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str | None) -> UnitCache:
    """Once for each worker process; without a path, the worker's own copy of the public tokenizer.

    A text that spells an added token, such as the end of a text, goes to the library whole, which gives that token's id.
    Words of plain letters go to the library's model at once, many in a call: its other steps would leave them whole, at a higher price than the merges.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, models, pre_tokenizers

    found = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
    apart = tuple(t.content for t in found.get_added_tokens_decoder().values())
    code, kind = ("H", np.dtype("u2")) if found.get_vocab_size() <= 1 << 16 else ("I", np.dtype("u4"))

    def whole(new: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(new), 20_000):
            out += [array(code, e.ids).tobytes() for e in found.encode_batch_fast(new[lo : lo + 20_000], add_special_tokens=False)]
        return out

    cut, model, names = found.pre_tokenizer, found.model, _alphabet()
    known = isinstance(model, models.BPE) and found.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
    if not known or any(a == " " or _LETTERS(a) for a in apart):
        return UnitCache(whole, kind, CACHE_UNITS, apart)
    bar = names[255]  # of a byte that no text has
    alone = found.get_vocab(with_added_tokens=False)
    changed = model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix or model.fuse_unk
    if changed or not all(c in alone for c in names) or any(bar in t for t in alone if t != bar):
        return UnitCache(whole, kind, CACHE_UNITS, apart)
    bare, between, spell = Tokenizer(model), alone[bar], {**dict(enumerate(names)), 10: bar}

    def merged(words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, many in one call: nothing merges with the bar between them."""
        spelled = ["\n".join([*words[lo : lo + TOGETHER], ""]).encode().decode("latin-1").translate(spell) for lo in range(0, len(words), TOGETHER)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in bare.encode_batch_fast(spelled, add_special_tokens=False)), kind)
        bars = np.flatnonzero(ids == between)
        size = np.diff(bars, prepend=-1) - 1
        data, end = ids[ids != between].tobytes(), np.cumsum(size) * kind.itemsize
        return [data[a:z] for a, z in zip((end - size * kind.itemsize).tolist(), end.tolist(), strict=True)]

    def learn(new: list[str]) -> list[bytes]:
        words = [u for u in new if _LETTERS(u)]
        ids = dict(zip(words, merged(words), strict=True))
        others = [u for u in new if u not in ids]
        ids.update(zip(others, whole(others), strict=True))
        return [ids[u] for u in new]

    return UnitCache(learn, kind, CACHE_UNITS, apart)


def write_shards(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(part, shard, before, n_ids, image): token files in ascending order of part, then shard. A part is a range of document ids; before counts its ids in earlier shards."""
    prepare(docs.sparkSession)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def image() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            data = pack([i for i, _ in held], [len(x) for _, x in held], ids)
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "shard", "before", "n_ids", "image"])

        known = tokenizer(path)
        for b in batches:
            for i, ids in zip(b.column("id").to_pylist(), known.ids(b.column("text").to_pylist()), strict=True):
                held.append((i, np.append(ids, ids.dtype.type(end))))
                size += len(ids) + 1
                if size >= SHARD:
                    yield image()
                    held, size, shard, before = [], 0, shard + 1, before + size
        if held:
            yield image()
        tidy()

    return ordered.mapInArrow(run, "part int, shard int, before long, n_ids long, image binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids): each document's ids as little-endian unsigned 32-bit integers, and how many ids come before it.

    Only the parts' totals are gathered and broadcast: one row for each partition that wrote.
    """
    prepare(shards.sparkSession)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    offsets = totals.select("part", (F.sum("part_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("part_ids")).alias("part_start"))
    placed = shards.select("part", "before", "image").join(F.broadcast(offsets), "part").select((F.col("part_start") + F.col("before")).alias("start"), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("image"), strict=True):
                s = Shard(data.as_buffer().to_pybytes())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths.astype(np.int64))
                begins = ends - s.lengths
                texts = pa.array([ids[a:z].tobytes() for a, z in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start + begins, pa.int64()), texts], ["doc_id", "start", "ids"])
        tidy()

    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def op7_tokens_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as token files and read back from them."""
    shards = stored(write_shards(table(spark, sf_dir, "documents")), "rans")
    return read_shards(shards).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
