"""Suffix-array dedup: byte strings that also start in a document with a smaller id are removed.

A byte goes if it is in a string of LENGTH bytes that also starts in a document with a smaller id.
Matches never cross documents, and are judged on the input.

Suffixes are sorted in blocks, none of which needs the corpus in memory:

1. Every window of LENGTH bytes has an anchor: the GRAM bytes in it with the least hash, the leftmost of
   those. Equal windows have equal anchors at equal places, so only suffixes whose windows have
   one anchor can be equal. The windows of one occurrence of an anchor start in a row; the bytes they
   cover are its block. Blocks go to buckets of the anchors' hashes as packed
   arrays of hashes and places, about a twelfth of the text's positions.
2. Blocks that are equal are one from here on: those in documents other than the least one are
   covered whole, and the least one's stands for them.
3. If an anchor has several different blocks, their texts are fetched, and the suffixes that start
   windows in them are sorted by their bytes, a suffix bucket at a time: whole anchors of about BATCH bytes, and of an
   anchor with more than that, ranges of the suffixes' first bytes (then of the next ones). Ties within a bucket are
   resolved by names of a difference cover: positions p with p mod 8 in {0, 1, 2, 4} have names that order
   them by their first 8, 16, 32, 40 and 48 bytes, made once by doubling. For any two positions some
   shift below 8 takes both into the cover, so the first 8 bytes, the name at that shift and the last 8
   bytes tell whether LENGTH bytes are equal. The least document of equal suffixes covers the others' windows.
   What a task holds beyond its blocks and a byte for each suffix is bounded by BATCH.
4. What is covered comes together by document and is cut out.

Equality of whole blocks (step 2) goes by 64-bit hashes within a 32-bit anchor hash within a bucket; bytes decide the rest.

Defined results: a null text is no bytes, and stays null as text in cut(); texts shorter than LENGTH lose nothing; strings that repeat
within one document only stay; rows that share an id, or have none, are ordered by id (null first), then text, and
equal rows count as one; other columns are ignored by spans() whatever their names; an empty table
gives an empty table. A cut may split a character: cut() drops the broken bytes from its text column.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.shingles import mix, pieces
from quern.runtime import buckets, fresh, partitions, prepare, stored, table, tidy

LENGTH = 50
GRAM = 20
#: Difference cover of the residues by 8: every two residues have a common shift into it.
PERIOD, COVER = 8, (0, 1, 2, 4)
#: Bytes of the blocks whose suffixes are sorted at a time.
BATCH = 1 << 19
#: Bytes of a document that are looked at at a time; windows of one slab and the next don't share an anchor's block.
SLAB = 1 << 22
#: Bytes of several documents that are looked at at a time.
PIECE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse by 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)]), np.cumprod(np.r_[np.uint64(1), np.full(n, inverse)])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, block's hash, first window, last window less first) of all anchors; windows count from each text's start."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for lo, hi in pieces(texts, PIECE):
        if hi - lo == 1 and len(texts[lo]) > SLAB:
            parts = [(texts[lo][s : s + SLAB + LENGTH - 1], s, lo) for s in range(0, len(texts[lo]) - LENGTH + 1, SLAB)]
            groups = [[p] for p in parts]
        else:
            groups = [[(texts[k], 0, k) for k in range(lo, hi) if len(texts[k]) >= LENGTH]]
        for g in groups:
            if g:
                for o, v in zip(out, _anchors(g), strict=True):
                    o.append(v)
    kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, k), *o]) for o, k in zip(out, kinds, strict=True))


def _anchors(group: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, ...]:
    size = np.array([len(t) for t, _, _ in group], dtype=np.int64)
    x = np.frombuffer(b"".join(t for t, _, _ in group), dtype=np.uint8)
    n = len(x)
    power, inverse = _powers(1 << int(n).bit_length())
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(_TABLE[x] * power[:n], dtype=np.uint64)]
        h = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    bits = np.uint64((1 << 24) - 1)
    v = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    span = LENGTH - GRAM + 1
    width = 1
    while 2 * width <= span:  # least over windows of grams, by doubling
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
    end = np.cumsum(size)
    # windows that lie in one text
    ok = np.ones(len(v), dtype=np.bool_)
    for e in end[:-1].tolist():
        ok[max(0, e - LENGTH + 1) : e] = False
    start = np.flatnonzero(ok)
    place = (v[start] & bits).astype(np.int64)
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]] | np.r_[True, np.diff(start) != 1])
    last = np.r_[head[1:], len(start)] - 1
    first, final, at = start[head], start[last], place[head]
    which = np.searchsorted(end, first, side="right")
    with np.errstate(over="ignore"):
        block = (total[final + LENGTH] - total[first]) * inverse[first] + (final - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (at - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    offset = np.array([s for _, s, _ in group], dtype=np.int64) - (end - size)
    owner = np.array([k for _, _, k in group], dtype=np.int64)
    return owner[which], mix(h[at] + np.uint64(1)), mix(block), first + offset[which], final - first


# packed arrays


def pack(a: np.ndarray) -> bytes:
    """Integers as differences, in the least width that holds them."""
    a = np.asarray(a, dtype=np.int64)
    if not len(a):
        return b""
    d = np.diff(a)
    d = (d << 1) ^ (d >> 63)  # small for small differences of either sign
    most = int(d.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    if (d < 0).any():
        return b"\0" + a.astype("<i8").tobytes()
    return bytes([width]) + a[:1].astype("<i8").tobytes() + d.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    if not data[0]:
        return np.frombuffer(data, "<i8", offset=1)
    d = np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.int64)
    return np.cumsum(np.r_[np.frombuffer(data, "<i8", 1, 1), (d >> 1) ^ -(d & 1)])


def _all(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpack, t.column(name).to_pylist())])


def _flat(t: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=kind)


def _cuts(key: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values in a sorted array."""
    if not len(key):
        return []
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist()
    return list(zip(at, [*at[1:], len(key)], strict=True))


def _homes(kind: int, ids: np.ndarray, lo: np.ndarray, more: np.ndarray, bucket: int, homes: int, width: str = "<u4") -> list[tuple]:
    """Rows (home, kind, bucket, ids, lo, more) for each home of documents."""
    home = (mix(ids.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.lexsort((lo, ids, home))
    home, ids, lo, more = home[order], ids[order], lo[order], more[order]
    return [(int(home[a]), kind, bucket, pack(ids[a:z]), pack(lo[a:z]), more[a:z].astype(width).tobytes()) for a, z in _cuts(home)]


_HOME_SCHEMA = "home long, kind int, bucket long, ids binary, lo binary, more binary"
_HOME_TYPES = [("home", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("ids", pa.binary()), ("lo", pa.binary()), ("more", pa.binary())]


def _home_table(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(_HOME_TYPES)})


FULL, ASK, MASK = 0, 1, 2


# difference cover


def _key8(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number whose order is theirs."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | x[at + k].astype(np.uint64)
    return out


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows of columns, equal for equal rows; pairs of names are one number before they are sorted."""
    out = np.unique(columns[0], return_inverse=True)[1]
    for c in columns[1:]:
        if c.dtype == np.uint64:
            c = np.unique(c, return_inverse=True)[1]
        out = np.unique(out.astype(np.int64) << 32 | c, return_inverse=True)[1]
    return out


def _batches(gram: np.ndarray, size: np.ndarray) -> Iterator[slice]:
    """Ranges of sorted grams with about BATCH bytes, each gram whole."""
    cuts, total = _cuts(gram), np.r_[0, np.cumsum(size)]
    lo = 0
    while lo < len(cuts):
        hi = lo + 1
        while hi < len(cuts) and total[cuts[hi][1]] - total[cuts[lo][0]] <= BATCH:
            hi += 1
        yield slice(cuts[lo][0], cuts[hi - 1][1])
        lo = hi


def least_documents(blocks: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each block and each window of `length` bytes in it, the least id of the blocks with an equal window."""
    lengths = np.array([len(b) for b in blocks], dtype=np.int64)
    windows = np.maximum(lengths - length + 1, 0)
    first_window = np.cumsum(windows) - windows
    owner = np.repeat(ids, windows)
    inside = np.arange(windows.sum()) - np.repeat(first_window, windows)
    x = np.frombuffer(b"".join(blocks), dtype=np.uint8)
    if len(x) <= 2 * BATCH:
        least = _by_cover(x, lengths, np.repeat(np.cumsum(lengths) - lengths, windows) + inside, owner, length)
    else:
        least = np.empty(len(owner), dtype=np.int64)
        begin = np.repeat(np.cumsum(lengths) - lengths, windows) + inside
        todo = [(np.arange(len(owner)), 0)]
        while todo:  # a suffix bucket at a time
            rows, depth = todo.pop()
            if depth >= length:  # all equal
                least[rows] = owner[rows].min()
            elif len(rows) * length <= BATCH:
                cut = x[(begin[rows][:, None] + np.arange(length)).reshape(-1)]
                least[rows] = _by_cover(cut, np.full(len(rows), length), np.arange(len(rows)) * length, owner[rows], length)
            else:
                key = _key8(x, begin[rows] + min(depth, length - 8))
                order = np.argsort(key, kind="stable")
                rows, key = rows[order], key[order]
                lo = 0
                while lo < len(rows):  # ranges of keys; one key with too many suffixes goes on to the next bytes
                    hi = int(np.searchsorted(key, key[min(lo + BATCH // length, len(rows)) - 1], side="left"))
                    if hi <= lo:
                        hi = int(np.searchsorted(key, key[lo], side="right"))
                        todo.append((rows[lo:hi], depth + 8))
                    else:
                        todo.append((rows[lo:hi], depth))
                    lo = hi
    return np.split(least, np.cumsum(windows)[:-1])


def _by_cover(raw: np.ndarray, lengths: np.ndarray, at_raw: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For windows that start at at_raw in blocks of these lengths, one after the other: the least owner of an equal window."""
    stride = -(-lengths // PERIOD) * PERIOD + PERIOD  # no block's cover depends on the one before it
    begin = np.cumsum(stride) - stride
    n = int(stride.sum())
    x = np.zeros(n + length + 64, dtype=np.uint8)
    shift_of = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    x[np.arange(len(raw)) + shift_of] = raw
    start = at_raw + shift_of[at_raw] if len(at_raw) else at_raw
    # names of the cover by doubling: a step by a multiple of the period stays in the cover
    cover = np.flatnonzero(np.isin(np.arange(n + 64) % PERIOD, COVER))
    index = np.full(n + 64 + PERIOD, -1, dtype=np.int32)
    index[cover] = np.arange(len(cover))
    name = {8: _names(_key8(x, np.minimum(cover, n + 48)))}

    def at(step: int, by: int) -> np.ndarray:
        return name[by][index[np.minimum(cover + step, cover[-1] - (cover[-1] - cover) % PERIOD)]]

    name[16] = _names(name[8], at(8, 8))
    name[32] = _names(name[16], at(16, 16))
    name[40] = _names(name[32], at(32, 8))
    name[48] = _names(name[40], at(40, 8))
    least = owner.copy()
    head, tail = (_names(_key8(x, start + d)) for d in (0, length - 8))
    for shift in range(PERIOD):
        own = np.flatnonzero(np.isin((start + shift) % PERIOD, COVER))
        if len(own):
            # 8 bytes from the start, 40 or 48 by name from the shift on, and the last 8: together all of the window
            by = 48 if shift + 40 < length - 8 else 40
            group = _names(head[own], name[by][index[start[own] + shift]], tail[own])
            smallest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, group, owner[own])
            least[own] = np.minimum(least[own], smallest[group])
    return least


# Spark


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.col("text").cast("binary").alias("text"))


def _by_document(df: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """What is found grows with the input, so it is never broadcast: one plan for all sizes."""
    return df.join(found.hint("merge"), "id", how)


def _covered(docs: DataFrame, length: int) -> DataFrame:
    """(id, begin, end): packed places of maximal covered runs of bytes, for docs (id, text) with different ids."""
    if length != LENGTH:
        raise ValueError(f"only {LENGTH} bytes are supported")
    spark = docs.sparkSession
    prepare(spark)
    count = max(2 * partitions(spark), buckets(docs, 32 << 20))
    homes = buckets(docs, 128 << 20)  # of documents: what is found there is far smaller than what is looked through

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array(b.column("id").to_pylist(), dtype=np.int64)
            own, gram, block, lo, span = anchors([t or b"" for t in b.column("text").to_pylist()])
            bucket = ((gram >> np.uint64(40)) % np.uint64(count)).astype(np.int64)
            order = np.lexsort((lo, own, bucket))
            own, gram, block, lo, span, bucket = own[order], gram[order], block[order], lo[order], span[order], bucket[order]
            head = np.r_[True, (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])][: len(own)]
            rows = []
            for a, z in _cuts(bucket):
                h = np.flatnonzero(head[a:z])
                wide = "<u2" if lo[a:z].max() < 1 << 16 else "<u4"
                rows.append((
                    int(bucket[a]), pack(ids[own[a:z][h]]), pack(np.diff(np.r_[h, z - a])), gram[a:z].astype("<u4").tobytes(),
                    block[a:z].astype("<u8").tobytes(),
                    (b"2" if wide == "<u2" else b"4") + lo[a:z].astype(wide).tobytes(), span[a:z].astype("u1").tobytes(),
                ))
            names = ["bucket", "ids", "runs", "gram", "block", "lo", "span"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if not k else pa.binary()) for k in range(7)], names)
        tidy()

    def judge(t: pa.Table) -> pa.Table:
        """Blocks of one bucket of anchors: which are covered whole, and which have to be compared."""
        bucket = t.column("bucket")[0].as_py()
        ids = np.repeat(_all(t, "ids"), _all(t, "runs"))
        gram = _flat(t, "gram", "<u4")
        block = _flat(t, "block", "<u8")
        lo = np.concatenate([np.frombuffer(x, "<u2" if x[:1] == b"2" else "<u4", offset=1).astype(np.int64) for x in t.column("lo").to_pylist()])
        span = _flat(t, "span", "u1").astype(np.int64)
        order = np.lexsort((ids, block, gram))
        ids, gram, block, lo, span = ids[order], gram[order], block[order], lo[order], span[order]
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, block[1:] != block[:-1]]
        at = np.flatnonzero(new)
        least = np.repeat(ids[at], np.diff(np.r_[at, len(ids)]))  # ids ascend within equal blocks
        full = ids > least
        # an anchor's different blocks are compared if their documents differ
        group = np.cumsum(new_gram) - 1
        n_groups = int(group[-1]) + 1
        kinds = np.bincount(group[at], minlength=n_groups)
        low, high = np.full(n_groups, np.iinfo(np.int64).max), np.full(n_groups, np.iinfo(np.int64).min)
        np.minimum.at(low, group[at], ids[at])
        np.maximum.at(high, group[at], ids[at])
        ask = ~full & ((kinds > 1) & (low < high))[group]
        asked_for = gram[ask].astype(np.int64) << 8 | span[ask]
        out = _home_table([*_homes(FULL, ids[full], lo[full], span[full], bucket, homes), *_homes(ASK, ids[ask], lo[ask], asked_for, bucket, homes, "<u8")])
        del t, ids, gram, block, lo, span, order
        tidy()
        return out

    judged = stored(_source(docs).mapInArrow(send, "bucket long, ids binary, runs binary, gram binary, block binary, lo binary, span binary").groupBy("bucket").applyInArrow(judge, _HOME_SCHEMA), "judged")

    def asked(t: pa.Table) -> pa.Table:
        sizes = [len(unpack(x)) for x in t.column("ids").to_pylist()]
        ids, lo, more = _all(t, "ids"), _all(t, "lo"), _flat(t, "more", "<u8")
        bucket = np.repeat(t.column("bucket").to_numpy(), sizes)
        order = np.lexsort((lo, ids))
        ids, lo, more, bucket = ids[order], lo[order], more[order], bucket[order]
        cuts = _cuts(ids)
        return pa.table({
            "id": pa.array([int(ids[a]) for a, _ in cuts], pa.int64()), "lo": pa.array([pack(lo[a:z]) for a, z in cuts], pa.binary()),
            "more": pa.array([more[a:z].tobytes() for a, z in cuts], pa.binary()), "bucket": pa.array([bucket[a:z].astype("<u4").tobytes() for a, z in cuts], pa.binary()),
        })

    asks = stored(judged.where(f"kind = {ASK}").groupBy("home").applyInArrow(asked, "id long, lo binary, more binary, bucket binary"), "asks")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[int, list] = {}
            for i, text, lo, more, bucket in zip(*(b.column(c).to_pylist() for c in ("id", "text", "lo", "more", "bucket")), strict=True):
                wanted = np.frombuffer(more, "<u8")
                for s, n, g, k in zip(unpack(lo).tolist(), (wanted & np.uint64(255)).tolist(), (wanted >> np.uint64(8)).tolist(), np.frombuffer(bucket, "<u4").tolist(), strict=True):
                    rows.setdefault(k, []).append((i, s, g, text[s : s + n + LENGTH]))
            found = [(k, pack([r[0] for r in v]), pack([r[1] for r in v]), np.array([r[2] for r in v], "<u4").tobytes(), bytes([len(r[3]) for r in v]), b"".join([r[3] for r in v])) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64() if not k else pa.binary()) for k in range(6)], ["bucket", "ids", "lo", "gram", "size", "blocks"])
        tidy()

    def compare(t: pa.Table) -> pa.Table:
        """Suffixes of one bucket's blocks: a bit for each window that starts in a smaller document as well."""
        bucket = t.column("bucket")[0].as_py()
        ids, lo, gram, size, raw = _all(t, "ids"), _all(t, "lo"), _flat(t, "gram", "<u4"), _flat(t, "size", "u1").astype(np.int64), b"".join(t.column("blocks").to_pylist())
        end = np.cumsum(size)
        mask = np.zeros(len(ids), dtype=np.int64)
        order = np.argsort(gram, kind="stable")
        for part in _batches(gram[order], size[order]):
            own = order[part]
            least = least_documents([raw[z - n : z] for z, n in zip(end[own].tolist(), size[own].tolist(), strict=True)], ids[own])
            windows = size[own] - LENGTH + 1
            flags = np.concatenate(least) < np.repeat(ids[own], windows)
            bit = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            mask[own] = np.bincount(np.repeat(np.arange(len(own)), windows), flags * (1 << bit), len(own)).astype(np.int64)
        hit = mask > 0
        out = _home_table(_homes(MASK, ids[hit], lo[hit], mask[hit], bucket, homes))
        del t, raw, mask, ids, lo, gram, size
        tidy()
        return out

    texts = _by_document(_source(docs), asks, "inner")
    masks = texts.mapInArrow(fetch, "bucket long, ids binary, lo binary, gram binary, size binary, blocks binary").groupBy("bucket").applyInArrow(compare, _HOME_SCHEMA)

    def together(t: pa.Table) -> pa.Table:
        sizes = [len(unpack(x)) for x in t.column("ids").to_pylist()]
        ids, lo, more = _all(t, "ids"), _all(t, "lo"), _flat(t, "more", "<u4").astype(np.int64)
        kind = np.repeat(t.column("kind").to_numpy(), sizes)
        own, begin, end = [ids[kind == FULL]], [lo[kind == FULL]], [(lo + more)[kind == FULL] + LENGTH]
        m = kind == MASK
        for k in range(LENGTH - GRAM + 1):
            bit = m & ((more >> k) & 1 == 1)
            own.append(ids[bit])
            begin.append(lo[bit] + k)
            end.append(lo[bit] + k + LENGTH)
        own, begin, end = np.concatenate(own), np.concatenate(begin), np.concatenate(end)
        order = np.lexsort((begin, own))
        own, begin, end = own[order], begin[order], end[order]
        ids_, b_, e_ = [], [], []
        for a, z in _cuts(own):
            b, e = begin[a:z], np.maximum.accumulate(end[a:z])
            head = np.r_[True, b[1:] > e[:-1]]  # runs that touch are one
            ids_.append(int(own[a]))
            b_.append(pack(b[head]))
            e_.append(pack(e[np.r_[np.flatnonzero(head)[1:] - 1, len(b) - 1]]))
        return pa.table({"id": pa.array(ids_, pa.int64()), "begin": pa.array(b_, pa.binary()), "end": pa.array(e_, pa.binary())})

    return judged.where(f"kind = {FULL}").unionByName(masks).groupBy("home").applyInArrow(together, "id long, begin binary, end binary")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """docs as (id, text), and whether ids are present and differ; if not, an id is a row's place by (id, text)."""
    odd = docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if odd.isEmpty():
        return plain, True
    rows = stored(plain.distinct().repartitionByRange("id", "text").sortWithinPartitions("id", "text").select("id", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "numbered")
    return rows, False


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, text binary, kept binary, spans array<struct<begin, end>>) for each row: maximal removed runs, and the bytes that stay."""
    plain, whole = _numbered(docs, id_col, text_col)
    if whole:
        numbered, keep = plain, ["id"]
    else:
        # places grow with (id, text): partitions are ranges, and numbers ascend in and over them
        numbered, keep = plain.select(F.col("place").alias("id"), "text", F.col("id").alias("own")), ["id", "own"]
    cuts = stored(_covered(numbered.select("id", "text"), length), "cuts")
    text = numbered.select(*keep, F.col("text").cast("binary").alias("text"))
    joined = _by_document(text, cuts, "left")
    if not whole:
        joined = joined.withColumn("id", F.col("own")).drop("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, begins, ends, sizes = [], [], [], [0]
            for t, x, y in zip(*(b.column(c).to_pylist() for c in ("text", "begin", "end")), strict=True):
                t = t or b""
                begin, end = unpack(x or b""), unpack(y or b"")
                a = [0, *end.tolist()]
                z = [*begin.tolist(), len(t)]
                kept.append(b"".join([t[p:q] for p, q in zip(a, z, strict=True)]) if len(begin) else t)
                begins.append(begin)
                ends.append(end)
                sizes.append(sizes[-1] + len(begin))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (begins, ends)], ["begin", "end"])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)], ["id", "text", "kept", "spans"])

    out = joined.select("id", "text", "begin", "end").mapInArrow(run, "id long, text binary, kept binary, spans array<struct<begin:long,end:long>>")
    if not whole:  # equal rows were one: as many as there were
        times = docs.groupBy(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).cast("string").cast("binary").alias("own_text")).count()
        out = out.join(times, F.col("id").eqNullSafe(F.col("own_id")) & F.col("text").eqNullSafe(F.col("own_text"))).withColumn("count", F.explode(F.sequence(F.lit(1), F.col("count")))).select("id", "text", "kept", "spans")
    return out.withColumnRenamed("id", id_col)


def cut(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with what is covered cut out of its text; docs' columns."""
    plain, whole = _numbered(docs, id_col, text_col)
    own = F.col("id") if whole else F.col("place")
    key, begin, end, row_id, row_text = (fresh(f"suffix_{c}", docs) for c in ("key", "begin", "end", "id", "text"))
    cuts = stored(_covered(plain.select(own.alias("id"), "text"), LENGTH), "cuts").select(F.col("id").alias(key), F.col("begin").alias(begin), F.col("end").alias(end))
    if whole:
        joined = docs.join(cuts.hint("merge"), F.col(id_col) == F.col(key), "left").drop(key)
    else:  # a row is known by its id and text
        found = plain.select(F.col("id").alias(row_id), F.col("text").alias(row_text), F.col("place").alias(f"{key}_")).join(cuts.hint("merge"), F.col(f"{key}_") == F.col(key)).drop(f"{key}_", key)
        same = F.col(id_col).cast("long").eqNullSafe(F.col(row_id)) & F.col(text_col).cast("string").eqNullSafe(F.col(row_text))
        joined = docs.join(found.hint("merge"), same, "left").drop(row_id, row_text)
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, x, y in zip(*(b.column(c).to_pylist() for c in (at, b.num_columns - 2, b.num_columns - 1)), strict=True):
                if t is not None and x:
                    raw = t.encode()
                    t = b"".join([raw[p:q] for p, q in zip([0, *unpack(y).tolist()], [*unpack(x).tolist(), len(raw)], strict=True)]).decode("utf-8", "ignore")
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(b.num_columns - 2)], schema.names)
        tidy()

    return joined.mapInArrow(run, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that also start in a document with a smaller id."""
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        (F.coalesce(F.length("text"), F.lit(0)) - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
