import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
def test_checksum(data):
    assert ogg.checksum(data) == slow_crc(data)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000) | st.sampled_from([0, 254, 255, 256, 510, 65025]), min_size=1, max_size=5), min_size=1, max_size=3))
def test_round_trip(sizes):
    streams = {}
    for s, lengths in enumerate(sizes):
        at, packets = 0, []
        for k, n in enumerate(lengths):
            at += n
            packets.append((bytes([(s + k) % 256]) * n, at))
        streams[s + 9] = packets
    got, bad = ogg.demux(ogg.mux(streams))
    assert not bad
    for s, packets in streams.items():
        assert got[s].packets == [p for p, _ in packets]
        assert got[s].begun and got[s].ended and not got[s].lost
        assert got[s].times(1, 0) == [g for _, g in packets]


@pytest.mark.parametrize("n", [1, 64, 4096, 4097, 8192, 200_000])
def test_store(n):
    payload = ogg.pad(bytes(i * 7 % 256 for i in range(n)))
    media = ogg.store(payload)
    back, streams = ogg.fetch(media)
    assert back == payload and len(streams) == 2
    ends = [s.times(ogg.RATE) for s in streams.values()]
    assert sum(t[-1] for t in ends if t) == len(payload) / ogg.RATE


def test_damage():
    payload = bytes(range(256)) * 1200
    media = bytearray(ogg.store(payload))
    media[len(media) // 2] ^= 1
    streams, bad = ogg.demux(bytes(media))
    assert bad == 1 and sum(s.lost for s in streams.values()) == 1
    with pytest.raises(ValueError):
        ogg.fetch(bytes(media))
    streams, bad = ogg.demux(b"junk OggS" + ogg.store(b"x" * 64))
    assert bad == 1 and len(streams) == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = ogg.query(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        payload = ogg.pad(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(ogg.store(payload)).hexdigest()


def test_edges(spark):
    s = "doc_id long, text string, media binary, id string"
    rows = [(1, None, None, None), (2, "", b"", ""), (None, "x", b"", ""), (3, "é" * 100_000, b"", "")]
    got = {r.id: r for r in ogg.read_media(ogg.store_texts(spark.createDataFrame(rows, s))).collect()}
    assert got[1].payload_bytes == 64 and got[1].media_sha256 == got[2].media_sha256
    assert got[3].n_bytes == 200_000 and got[None].n_bytes == 1
    assert ogg.read_media(ogg.store_texts(spark.createDataFrame([], s))).count() == 0
