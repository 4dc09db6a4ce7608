"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the pattern is encoded by itself. A match that is a token as a whole takes that
id. Else the leaves of a segment tree hold, for each byte position, the rank of the pair of
tokens that starts there; every inner node holds the least rank below it and the leftmost place
of it. A merge takes the root's pair and updates three leaves (the merged token, its live left
neighbour and the place that vanished), each along one path to the root: n bytes take
O(n log n) steps. Many short matches are encoded side by side in one array of trees.

Defined results: a null or empty text has no ids and decodes to no bytes; a null id passes
through; repeated rows give repeated results; other columns are ignored whatever their names;
an empty table gives an empty table. Texts are never cut, whatever their length. Ids that are
not in the vocabulary can't be decoded and raise KeyError.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.words import PATTERN, UnitCache
from quern.runtime import prepare, table, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
_NONE = np.int64(1) << 62
#: From this many bytes on, a match gets a tree of its own.
_LONG = 256


class Bpe:
    """A vocabulary of ranks, with encoding and decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.bytes_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair_keys, self.pair_ranks = self._hashed(pairs)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.cache = UnitCache(self._learn, self.kind)

    # one tree

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one match by its own segment tree."""
        n = len(piece)
        ids = [int(self.bytes_ids[b]) for b in piece]
        width = 1 << max(1, n - 1).bit_length()
        none = (1 << 62, 0)
        tree = [none] * (2 * width)
        tokens, ranks = self.tokens, self.ranks
        pair = lambda i, j: ranks.get(tokens[ids[i]] + tokens[ids[j]])
        for i in range(n - 1):
            if (r := pair(i, i + 1)) is not None:
                tree[width + i] = (r, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: tuple[int, int]) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k //= 2
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] != none:
            rank, i = tree[1]
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            put(gone, none)
            if after[i] < n:
                before[after[i]] = i
            r = pair(i, after[i]) if after[i] < n else None
            put(i, none if r is None else (r, i))
            if (j := before[i]) >= 0:
                r = pair(j, i)
                put(j, none if r is None else (r, j))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    # many trees

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _hashed(self, pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressed table of pairs, at most a quarter full; lookups end at an empty slot."""
        bits = max(4, (4 * len(pairs)).bit_length())
        keys, ranks = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        todo = np.array(list(pairs), dtype=np.int64)
        value = np.array(list(pairs.values()), dtype=np.int64)
        slot = self._slot(todo, bits)
        while len(todo):
            free = keys[slot] < 0
            keys[slot[free]] = todo[free]
            done = keys[slot] == todo
            ranks[slot[done]] = value[done]
            todo, value, slot = todo[~done], value[~done], (slot[~done] + 1) % (1 << bits)
        return keys, ranks

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        key = left * self.size + right
        slot = self._slot(key, len(self.pair_keys).bit_length() - 1)
        rank = np.where(self.pair_keys[slot] == key, self.pair_ranks[slot], -1)
        key, slot = key.reshape(-1), slot.reshape(-1)
        flat = rank.reshape(-1)
        more = np.flatnonzero((self.pair_keys[slot] != key) & (self.pair_keys[slot] >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) % len(self.pair_keys)
            found = self.pair_keys[slot[more]]
            hit = found == key[more]
            flat[more[hit]] = self.pair_ranks[slot[more[hit]]]
            more = more[~hit & (found >= 0)]
        return rank

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as bytes of self.kind, of matches of 2 to width bytes; width is a power of two."""
        m = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(m, width)
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = self.bytes_ids[raw]
        place = np.arange(width, dtype=np.int64)
        tree = np.full((m, 2 * width), _NONE, dtype=np.int64)
        first = self._rank(ids[:, :-1], ids[:, 1:])
        fits = (first >= 0) & (place[None, 1:] < length[:, None])
        tree[:, width : 2 * width - 1] = np.where(fits, first * width + place[None, :-1], _NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        # neighbours; place width stands for "none" on either side
        after = np.where(np.r_[place, width][None, :] + 1 < length[:, None], np.r_[place + 1, width][None, :], width)
        before = np.broadcast_to(np.r_[width, place[:-1], width], (m, width + 1)).copy()
        live = place[None, :] < length[:, None]
        ids_ = np.concatenate([ids, np.zeros((m, 1), np.int64)], axis=1)
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            i, rank = root % width, root // width
            gone = after[rows, i]
            follow = after[rows, gone]
            ids_[rows, i] = rank
            live[rows, gone] = False
            after[rows, i] = follow
            before[rows, follow] = i
            lead = before[rows, i]
            right = self._rank(rank, ids_[rows, follow])
            left = self._rank(ids_[rows, lead], rank)
            at = np.concatenate([gone, i, np.where(lead < width, lead, gone)])
            value = np.concatenate(
                [
                    np.full(len(rows), _NONE),
                    np.where((follow < width) & (right >= 0), right * width + i, _NONE),
                    np.where((lead < width) & (left >= 0), left * width + lead, _NONE),
                ]
            )
            three = np.concatenate([rows, rows, rows]) * (2 * width)
            flat = tree.reshape(-1)
            node = at + width
            flat[three + node] = value
            while node[0] > 1:
                node = node >> 1
                flat[three + node] = np.minimum(flat[three + 2 * node], flat[three + 2 * node + 1])
            rows = rows[flat[rows * (2 * width) + 1] < _NONE]
        size = self.kind.itemsize
        flat, ends = ids_[:, :-1][live].astype(self.kind).tobytes(), (np.cumsum(live.sum(1)) * size).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each match as bytes of self.kind."""
        size, ranks = self.kind.itemsize, self.ranks
        out = [None if i is None else i.to_bytes(size, "little") for i in map(ranks.get, pieces)]
        by_width: dict[int, list[int]] = {}
        for k, found in enumerate(out):
            if found is None:
                if (n := len(pieces[k])) < _LONG:
                    by_width.setdefault(max(4, 1 << (n - 1).bit_length()), []).append(k)
                else:
                    out[k] = np.array(self.merge_one(pieces[k]), dtype=self.kind).tobytes()
        for width, at in by_width.items():
            step = max(1, (1 << 19) // width)  # bounds the arrays
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                for k, ids in zip(part, self.merge_many([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        cut = list(map(PATTERN.findall, new))
        pieces = list({p for c in cut for p in c})
        known = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces]), strict=True))
        return [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cut]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.cache.ids(texts)

    def decode(self, ids: list[int]) -> bytes:
        try:
            if ids and min(ids) < 0:
                raise IndexError
            return b"".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError):
            raise KeyError("an id that isn't in the vocabulary") from None


@functools.lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Bpe:
    """Once for each worker process; without a path, the worker's own copy of the public vocabulary."""
    return Bpe(path or public_tokenizers.path(VOCABULARY))


def encode(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded binary]) of every text, without a shuffle.

    With decoded, the ids are decoded again to bytes in the same pass.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            ids = bpe.encode(b.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.zeros(0, "<u2"), *ids]).astype(np.int32)
            columns = [b.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
            if decoded:
                columns.append(pa.array([bpe.decode(i.tolist()) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])
        tidy()

    schema = f"id {id_type}, ids array<int>" + ", decoded binary" * decoded
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of arrays of ids; a null array decodes to no bytes."""
    prepare(tokens.sparkSession)
    source = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            found = [bpe.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], ["id", "decoded"])

    return source.mapInArrow(run, f"id {id_type}, decoded binary").withColumnRenamed("id", id_col)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: counts and digests."""
    done = encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
