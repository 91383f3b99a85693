"""Media columns: Ogg.

:func:`mux` writes packets of several logical streams into one physical stream of pages: lacing
values, continued packets, granule positions and page checksums. :func:`demux` reads any physical
stream back: it finds pages, verifies their checksums, reassembles packets from lacing values, tells
logical streams apart by serial number and derives times from granule positions. A damaged page is
skipped and counted; so is a packet that a missing page leaves incomplete.

:func:`store` keeps bytes as unsigned 8-bit samples: packets of :data:`PACKET` samples dealt in turn
to two logical streams. Serial numbers come from the content, so equal payloads give equal files.

Defined cases: a null text is empty; the payload is padded with zero bytes to a positive multiple of
64; repeated rows give equal values; a null id is carried; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import arrow, id_text, table

RATE, PACKET, CHANNELS = 8000, 4096, 2
CONTINUED, BEGIN, END = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sBBIQ")
MAGIC = b"\x7fu8pcm\0\0"
NO_GRANULE = -1

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04c11db7, most significant bit first, start and final value zero.

    It is zlib's CRC of the bits in reverse, without zlib's inversions.
    """
    crc = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: list[int], body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + bytes(lacing)
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages (granule, bytes) of one logical stream; packets are (data, granule at their end).

    The first packet has a page of its own. A page holds up to 255 lacing values; a packet that
    doesn't fit is continued. A page on which no packet ends has granule -1.
    """
    units: list[tuple[int, bytes, int, bool]] = []  # lacing value, data, granule where a packet ends, starts a packet
    pages: list[tuple[int, bytes]] = []
    sequence = 0

    def flush(last: bool) -> None:
        nonlocal sequence, units
        granule = next((g for _, _, g, _ in reversed(units) if g != NO_GRANULE), NO_GRANULE)
        flags = (0 if units and units[0][3] or not units else CONTINUED) | (BEGIN if sequence == 0 else 0) | (END if last else 0)
        pages.append((granule, _page(flags, granule, serial, sequence, [u[0] for u in units], b"".join(u[1] for u in units))))
        sequence, units = sequence + 1, []

    for k, (data, granule) in enumerate(packets):
        n = len(data) // 255
        for i in range(n + 1):
            if len(units) == 255:
                flush(False)
            part = data[255 * i : 255 * (i + 1)]
            units.append((len(part), part, granule if i == n else NO_GRANULE, i == 0))
        if k == 0 and len(packets) > 1:
            flush(False)
    flush(True)
    return pages


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: first pages first, then pages in the order of their granules."""
    paged = {s: paginate(s, p) for s, p in streams.items()}
    out = [p[0][1] for p in paged.values()]
    rest = []
    for at, pages in enumerate(paged.values()):
        reached = 0
        for k, (granule, data) in enumerate(pages[1:]):
            reached = max(reached, granule)
            rest.append((reached, at, k, data))
    return b"".join([*out, *(x[3] for x in sorted(rest, key=lambda x: x[:3]))])


@dataclass
class Logical:
    """A logical stream as read back. times: seconds at each packet's end, by granule."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    begun: bool = False
    ended: bool = False
    lost: int = 0
    _next: int | None = None
    _open: list[bytes] | None = None

    def take(self, flags: int, granule: int, sequence: int, lacing: bytes, body: bytes) -> None:
        if self._next is not None and sequence != self._next:
            self.lost += 1
            self._open = None
        elif self._open is not None and not flags & CONTINUED:
            self.lost += 1
            self._open = None
        self._next = (sequence + 1) & 0xFFFFFFFF
        self.pages += 1
        self.begun |= bool(flags & BEGIN)
        self.ended |= bool(flags & END)
        skipping = bool(flags & CONTINUED) and self._open is None
        at, done = 0, 0
        current = self._open or []
        for n in lacing:
            current.append(body[at : at + n])
            at += n
            if n < 255:
                if skipping:
                    skipping = False
                else:
                    self.packets.append(b"".join(current))
                    self.granules.append(NO_GRANULE)
                    done += 1
                current = []
        self._open = None if skipping or (not current and not (lacing and lacing[-1] == 255)) else current
        if done:
            self.granules[-1] = granule

    def times(self, rate: int, skip: int = 1) -> list[float | None]:
        """Seconds at the end of each packet after the first ``skip``; samples are bytes.

        A page's granule belongs to the last packet that ends on it; the others follow backwards.
        """
        out: list[float | None] = [None] * len(self.packets)
        at = None
        for k in range(len(self.packets) - 1, skip - 1, -1):
            if self.granules[k] != NO_GRANULE:
                at = self.granules[k]
            if at is not None:
                out[k] = at / rate
                at -= len(self.packets[k])
        return out[skip:]


def demux(data: bytes) -> tuple[dict[int, Logical], int]:
    """Logical streams by serial number in order of appearance, and the count of damaged places."""
    streams: dict[int, Logical] = {}
    bad, at, good_end = 0, 0, 0
    while True:
        at = data.find(b"OggS", at)
        if at < 0 or at + HEADER.size > len(data):
            break
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        body = at + HEADER.size + n
        lacing = data[at + HEADER.size : body]
        end = body + sum(lacing)
        whole = data[at:end]
        if version or len(lacing) < n or end > len(data) or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            at += 1
            continue
        bad += at != good_end
        streams.setdefault(serial, Logical(serial)).take(flags, granule, sequence, lacing, data[body:end])
        at = good_end = end
    return streams, bad + (good_end != len(data))


def store(payload: bytes) -> bytes:
    """The payload as 8-bit samples in an Ogg file of :data:`CHANNELS` logical streams."""
    serial = zlib.crc32(payload) & 0x7FFFFFF0
    streams = {}
    for c in range(CHANNELS):
        head = IDENT.pack(MAGIC, c, CHANNELS, RATE, len(payload))
        packets, granule = [(head, 0)], 0
        for k in range(c * PACKET, len(payload), CHANNELS * PACKET):
            part = payload[k : k + PACKET]
            granule += len(part)
            packets.append((part, granule))
        streams[serial + c] = packets
    return mux(streams)


def fetch(media: bytes) -> tuple[bytes, dict[int, Logical]]:
    """The payload and the streams of a file that :func:`store` made; raises ``ValueError`` if it is damaged."""
    streams, bad = demux(media)
    by_channel = {}
    for s in streams.values():
        if not s.packets or len(s.packets[0]) != IDENT.size or not (s.begun and s.ended) or s.lost:
            raise ValueError("incomplete logical stream")
        magic, channel, channels, _, total = IDENT.unpack(s.packets[0])
        if magic != MAGIC:
            raise ValueError("not stored by this module")
        by_channel[channel] = s
    if bad or not by_channel or sorted(by_channel) != list(range(channels)):
        raise ValueError("damaged file")
    parts = [None] * sum(len(s.packets) - 1 for s in by_channel.values())
    for c, s in by_channel.items():
        parts[c::channels] = s.packets[1:]
    payload = b"".join(parts)
    if len(payload) != total:
        raise ValueError("samples are missing")
    return payload, streams


def feature(payload: bytes, streams: dict[int, Logical]) -> str:
    """What the stored samples say: streams, pages, packets, seconds by granule, level and crossings."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    seconds = max((t for s in streams.values() for t in s.times(RATE)[-1:] if t is not None), default=0.0)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) - 1 for s in streams.values())}"
        f";seconds={seconds:.6f};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"
    )


def pad(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text's UTF-8 bytes, padded and stored."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(pad(r)) for r in raw], pa.binary())],
            ["id", "n_bytes", "media"],
        )

    return arrow(id_text(docs, id_col, text_col), each, "id long, n_bytes long, media binary", 256)


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, from their bytes alone; a damaged file fails the job."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for m in batch.column(2).to_pylist():
            payload, streams = fetch(m)
            rows.append(
                (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload, streams))
            )
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        cols = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["id", "n_bytes", *names])

    return arrow(
        media,
        each,
        "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
        256,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_texts(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
