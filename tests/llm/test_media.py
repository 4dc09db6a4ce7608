import hashlib
import os
import random
import zlib

import pytest
from fixtures import ODD, documents

from quern.llm import matroska as mk


def test_payloads_come_back():
    for n in [0, 1, 63, 64, 65, 1024, 8192, 8256, 300_000, 1_000_000]:
        p = mk.payload_of(os.urandom(n))
        m = mk.parse(f := mk.mux(p))
        assert m.payload(f) == p and p and len(p) % 64 == 0
        assert m.doc_type == "matroska" and m.tracks[1].codec == "A_PCM/INT/LIT" and m.tracks[1].bits == 8
        starts = {c for *_, c in m.packets}
        assert {place for *_, place in m.cues} == starts
        assert [ms for _, ms, *_ in m.packets] == [k * 128.0 for k in range(len(m.packets))]


@pytest.mark.parametrize("lacing", [mk.NO_LACING, mk.XIPH_LACING, mk.FIXED_LACING, mk.EBML_LACING])
def test_every_lacing(lacing):
    r = random.Random(lacing)
    for _ in range(200):
        n = 1 if lacing == mk.NO_LACING else r.randint(2, 20)
        frames = [os.urandom(37 if lacing == mk.FIXED_LACING else r.choice([0, 1, 60, 63, 64, 65, 254, 255, 256, 510, 3000, 20000])) for _ in range(n)]
        d = mk.laced(frames, lacing)
        assert [d[s : s + k] for s, k in mk._lacing(d, 0, len(d), lacing)] == frames


def test_unknown_sizes_groups_and_void():
    cluster = mk.unsigned(mk.TIMESTAMP, 5) + mk.element(0xEC, b"void") + mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, mk.vint(1) + b"\0\1\0abc"))
    open_ended = lambda n, c: mk.element_id(n) + b"\x01" + b"\xff" * 7 + c
    data = mk._HEADER + open_ended(mk.SEGMENT, mk._INFO + mk._TRACKS + open_ended(mk.CLUSTER, cluster) + open_ended(mk.CLUSTER, cluster))
    m = mk.parse(data)
    assert m.payload(data) == b"abcabc" and [p[1] for p in m.packets] == [6.0, 6.0]


def test_broken_files():
    f = mk.mux(b"a" * 64)
    for bad in (f[:-3], b"\0" * 9, f[:5]):
        with pytest.raises(ValueError):
            mk.parse(bad)


def test_query_on_odd_texts(spark, tmp_path):
    documents(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in mk.op5_media_matroska(spark, str(tmp_path)).collect()}
    assert len(rows) == len(ODD)
    for k, t in enumerate(ODD):
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (rows[k].n_bytes, rows[k].payload_bytes) == (len(raw), len(p))
        assert rows[k].payload_sha256 == hashlib.sha256(p).hexdigest() and rows[k].tail_crc32 == zlib.crc32(p[-64:])
        assert rows[k].media_sha256 == hashlib.sha256(mk.mux(p)).hexdigest()
    assert rows[16][3:] == rows[17][3:]
    packets = mk.packets(mk.encode(documents(spark, ODD))).where("doc_id = 7").orderBy("packet").collect()
    assert [p["size"] for p in packets] == [1024, 1024, 960]
    assert mk.op5_media_matroska(spark, str(tmp_path)).where("false").count() == 0
