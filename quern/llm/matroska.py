"""Media columns: texts as 8-bit PCM in Matroska files, and Matroska files as packet tables.

mux() stores a payload as one mono track of unsigned 8-bit samples: EBML header, segment,
info, tracks, clusters of laced SimpleBlocks, cues. parse() reads any such byte string: it walks
the elements with their variable-length ids and sizes, skips what it doesn't know, undoes all
four lacings and gives one packet for each frame with its track, timestamp and byte range.
Both work on one file at a time, in memory in proportion to that file.

Defined results: null and empty texts are a payload of 64 zero bytes; a null file has no packets;
repeated rows give repeated results; other columns are ignored whatever their names; an empty
table gives an empty table; broken files raise ValueError with the offset.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import prepare, table

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

#: Samples a second, samples in a frame, frames in a block, blocks in a cluster: 8 ms steps, 30.7 s clusters.
RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 30


# writing


def element_id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """An EBML size: the first set bit gives the width. All ones are kept for "unknown"."""
    width = width or max(1, -(-(value + 1).bit_length() // 7))
    if value >= (1 << 7 * width) - 1:
        raise ValueError(f"{value} doesn't fit in {width} bytes")
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, content: bytes) -> bytes:
    return element_id(number) + vint(len(content)) + content


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The part of a block after its flags: sizes of all frames but the last, then the frames."""
    if lacing == NO_LACING:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == FIXED_LACING:
        if len(set(sizes)) != 1:
            raise ValueError("frames of one size are needed")
    elif lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    else:
        head += vint(sizes[0])
        for before, s in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(s - before) < (1 << 7 * w - 1) - 1)
            head += vint(s - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def simple_block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + laced(frames, lacing))


_HEADER = element(
    EBML,
    unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2),
)
_INFO = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"quern") + element(WRITING_APP, b"quern"))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file with payload as the samples of track 1."""
    parts, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    span = FRAME * LACED * BLOCKS
    for start in range(0, len(payload), span):
        clock = start * 1000 // RATE
        blocks = []
        for lo in range(start, min(start + span, len(payload)), FRAME * LACED):
            piece = payload[lo : min(lo + FRAME * LACED, start + span)]
            frames = [piece[k : k + FRAME] for k in range(0, len(piece), FRAME)]
            lacing = NO_LACING if len(frames) == 1 else FIXED_LACING if len(frames[-1]) == FRAME else EBML_LACING
            blocks.append(simple_block(1, lo * 1000 // RATE - clock, frames, lacing))
        cluster = element(CLUSTER, unsigned(TIMESTAMP, clock) + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, clock) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# reading


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    rate: float = 0.0
    channels: int = 1
    bits: int = 0
    frame_ns: int = 0


@dataclass
class Media:
    """What a file holds: tracks, packets (track, timestamp ms, start, size, cluster's place), cues (ms, track, place)."""

    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[tuple[int, float, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    doc_type: str = ""

    def payload(self, data: bytes, track: int = 1) -> bytes:
        return b"".join([data[s : s + n] for t, _, s, n, _ in self.packets if t == track])


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, next place); -1 for the size "unknown"."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range. One of unknown size reaches to the end of the range."""
    while at < end:
        number, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {number:x} at {at} goes past {end}")
        yield number, at, stop
        at = stop


def _lacing(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, size) of each frame of a block's content."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED_LACING:
        if (end - at) % count:
            raise ValueError(f"frames at {at} are not of one size")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if lacing == XIPH_LACING:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            elif not k:
                size, at = read_vint(data, at)
            else:
                value, after = read_vint(data, at)
                if value < 0:  # all ones: the largest difference
                    value = (1 << 7 * (after - at)) - 1
                size, at = sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1), after
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frame sizes at {at} don't fit their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _track(data: bytes, at: int, end: int) -> Track:
    t = Track()
    for n, s, e in children(data, at, end):
        if n == TRACK_NUMBER:
            t.number = _number(data, s, e)
        elif n == CODEC_ID:
            t.codec = data[s:e].rstrip(b"\0").decode("ascii", "replace")
        elif n == DEFAULT_DURATION:
            t.frame_ns = _number(data, s, e)
        elif n == AUDIO:
            for m, a, b in children(data, s, e):
                if m == SAMPLING_FREQUENCY:
                    t.rate = struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]
                elif m == CHANNELS:
                    t.channels = _number(data, a, b)
                elif m == BIT_DEPTH:
                    t.bits = _number(data, a, b)
    return t


def _block(media: Media, data: bytes, at: int, end: int, clock: int, place: int) -> None:
    track, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    step = media.tracks[track].frame_ns / media.scale if track in media.tracks else 0.0
    for k, (start, size) in enumerate(_lacing(data, at + 3, end, flags >> 1 & 3)):
        media.packets.append((track, clock + relative + k * step, start, size, place))


def _cluster(media: Media, data: bytes, at: int, end: int, place: int) -> int:
    """Reads one cluster; gives the place after it, as one of unknown size ends where a top-level element begins."""
    clock = 0
    while at < end:
        begin = at
        number, at = read_vint(data, at, keep_marker=True)
        if number in (CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML):
            return begin
        size, at = read_vint(data, at)
        stop = end if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {number:x} at {at} goes past {end}")
        if number == TIMESTAMP:
            clock = _number(data, at, stop)
        elif number == SIMPLE_BLOCK:
            _block(media, data, at, stop, clock, place)
        elif number == BLOCK_GROUP:
            for n, s, e in children(data, at, stop):
                if n == BLOCK:
                    _block(media, data, s, e, clock, place)
        at = stop
    return at


def parse(data: bytes) -> Media:
    media, at = Media(), 0
    while at < len(data):
        number, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        end = len(data) if size < 0 else at + size
        if end > len(data):
            raise ValueError(f"element {number:x} at {at} is cut off")
        if number == EBML:
            media.doc_type = next((data[s:e].decode("ascii", "replace") for n, s, e in children(data, at, end) if n == DOC_TYPE), "")
        elif number == SEGMENT:
            base = at
            while at < end:
                place = at - base
                n, at = read_vint(data, at, keep_marker=True)
                size, at = read_vint(data, at)
                stop = end if size < 0 else at + size
                if stop > end:
                    raise ValueError(f"element {n:x} at {at} goes past {end}")
                if n == INFO:
                    media.scale = next((_number(data, s, e) for m, s, e in children(data, at, stop) if m == TIMESTAMP_SCALE), media.scale)
                elif n == TRACKS:
                    for m, s, e in children(data, at, stop):
                        if m == TRACK_ENTRY:
                            t = _track(data, s, e)
                            media.tracks[t.number] = t
                elif n == CLUSTER:
                    stop = _cluster(media, data, at, stop, place)
                elif n == CUES:
                    for m, s, e in children(data, at, stop):
                        clock, spots = 0, []
                        for q, a, b in children(data, s, e) if m == CUE_POINT else ():
                            if q == CUE_TIME:
                                clock = _number(data, a, b)
                            elif q == CUE_TRACK_POSITIONS:
                                spots.append({r: _number(data, x, y) for r, x, y in children(data, a, b)})
                        media.cues += [(clock, p.get(CUE_TRACK, 0), p.get(CUE_CLUSTER_POSITION, 0)) for p in spots]
                at = stop
        at = end
    return media


# columns


def payload_of(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of 64."""
    return text + b"\0" * ((-len(text)) % 64 or (0 if text else 64))


def feature(media: Media, samples: bytes) -> str:
    """Packets, clusters, milliseconds, and mean, deviation and zero crossings of the samples about their middle value."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    square = int(np.einsum("i,i", x, x, dtype=np.int64)) if n else 0
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    rate = media.tracks[1].rate if 1 in media.tracks else RATE
    return f"packets={len(media.packets)};clusters={len(media.cues)};ms={n * 1000 / rate:g};sum={total};squares={square};crossings={crossings}"


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): each text's payload as a Matroska file."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [mux(payload_of(t or b"")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(files, pa.binary())], ["id", "media"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, media binary").withColumnRenamed("id", id_col)


def packets(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet: id, packet number, track, codec, timestamp_ms, start, size, cluster (place in the segment)."""
    prepare(files.sparkSession)
    source = files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, packet long, track int, codec string, timestamp_ms double, start long, size long, cluster long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column("id").to_pylist(), []
            for i, data in zip(ids, b.column("media").to_pylist(), strict=True):
                media = parse(data or b"")
                rows += [(i, k, t, media.tracks[t].codec if t in media.tracks else "", ms, s, n, c) for k, (t, ms, s, n, c) in enumerate(media.packets)]
            types = [b.schema.field("id").type, pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "packet", "track", "codec", "timestamp_ms", "start", "size", "cluster"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def features(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, payload binary, feature string): track 1's samples read back from the stored bytes, and their features."""
    prepare(files.sparkSession)
    source = files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for data in b.column("media").to_pylist():
                media = parse(data or b"")
                samples = media.payload(data or b"")
                found.append((samples, feature(media, samples)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["id", "payload", "feature"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, payload binary, feature string").withColumnRenamed("id", id_col)


def stored_and_read(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, payload, feature): encode() and features() in one pass, as the file is needed beside its features."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            files = [mux(payload_of(t)) for t in texts]
            found = [(m := parse(f), m.payload(f)) for f in files]
            columns = [b.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary()), pa.array([s for _, s in found], pa.binary()), pa.array([feature(m, s) for m, s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "media", "payload", "feature"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, feature string").withColumnRenamed("id", id_col)


def op5_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as Matroska, read back, and described."""
    done = stored_and_read(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
