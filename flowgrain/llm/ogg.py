"""Media columns in Ogg: pages with checksums, lacing, several logical streams and granule times.

Layout from the public container specification (RFC 3533). A physical stream holds pages of several
logical streams; a packet is cut into segments of 255 bytes and a shorter last one, and may go on over
pages; the granule position of a page is the stream's clock at the end of the last packet that ends on it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import python_batches, text_or_empty

PACKET, RATE = 576, 8000
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
AUDIO_MAGIC, MARK_MAGIC = b"\x80pcm8\0\0\0", b"\x80marks\0\0"


def checksum(page: bytes) -> int:
    """The container's CRC-32 (0x04C11DB7, not reflected, no inversion), by way of the reflected one."""
    reflected = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    raw = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + checksum(raw).to_bytes(4, "little") + raw[26:]


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; the first packet has a page of its own; packets go on over pages."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, going_on = bytearray(), [], -1, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule
        flags = (1 if started_inside else 0) | (2 if not out else 0) | (4 if last else 0)
        out.append((granule, page(serial, len(out), granule, flags, bytes(lacing), b"".join(body))))
        lacing, body, granule = bytearray(), [], -1

    started_inside = False
    for i, packet in enumerate(packets):
        at, left = 0, len(packet) // 255 + 1
        going_on = False
        while left:
            if len(lacing) == 255:
                flush(False)
                started_inside = going_on
            take = min(left, 255 - len(lacing))
            left -= take
            full = take if left else take - 1
            lacing += b"\xff" * full
            end = at + 255 * full if left else len(packet)
            if not left:
                lacing.append(len(packet) - at - 255 * full)
                granule = granules[i]
            body.append(packet[at:end])
            at, going_on = end, True
        if i == 0 or i == len(packets) - 1:
            flush(i == len(packets) - 1)
            started_inside = False
    return out


def multiplex(streams: list[list[tuple[int, bytes]]]) -> bytes:
    """First pages first, then all others by their granule positions."""
    first = [s[0][1] for s in streams]
    rest, clock = [], [0] * len(streams)
    for k, s in enumerate(streams):
        for n, (granule, raw) in enumerate(s[1:]):
            clock[k] = max(clock[k], granule)
            rest.append((clock[k], n, k, raw))
    return b"".join(first + [r[3] for r in sorted(rest, key=lambda r: r[:3])])


@dataclass
class Logical:
    """What one logical stream holds: packets, and for each the granule position of its end (-1 unknown).

    lost: the gaps in the page numbers and the packets that were cut off.
    """

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)
    _next: int = 0


def demultiplex(raw: bytes) -> tuple[dict[int, Logical], int]:
    """The logical streams by serial number, and how many damaged pages or stray runs were passed over.

    A page with a wrong checksum is left out; packets that run over a missing page are dropped and counted.
    """
    streams: dict[int, Logical] = {}
    at, bad = 0, 0
    while at + 27 <= len(raw):
        if raw[at : at + 4] != b"OggS":
            bad += 1
            at = raw.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(raw, at)
        lacing = raw[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        whole = raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : end]
        if version or len(lacing) < n or end > len(raw) or checksum(whole) != crc:
            bad += 1
            at = raw.find(b"OggS", at + 4)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, Logical())
        gap = number != s._next
        if gap or (s._open and not flags & 1):
            s._open, s.lost = [], s.lost + 1
        skip = bool(flags & 1) and not s._open
        s._next, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & 4)
        pos, size, done = at + 27 + n, 0, len(s.packets)
        for x in lacing:
            size += x
            if x < 255:
                if skip:
                    skip = False
                else:
                    s._open.append(raw[pos : pos + size])
                    s.packets.append(b"".join(s._open) if len(s._open) > 1 else s._open[0])
                    s.granules.append(-1)
                    s._open = []
                pos, size = pos + size, 0
        if size and not skip:
            s._open.append(raw[pos : pos + size])
        if len(s.packets) > done:
            s.granules[-1] = granule
        at = end
    return streams, bad


def end_times(stream: Logical, unit: int, rate: int = RATE) -> list[float]:
    """Seconds at which each packet ends; those between known positions are counted back at ``unit`` a packet."""
    out, known = [0.0] * len(stream.packets), None
    for i in range(len(stream.packets) - 1, -1, -1):
        known = stream.granules[i] if stream.granules[i] >= 0 else (None if known is None else max(0, known - unit))
        out[i] = float("nan") if known is None else known / rate
    return out


def store(payload: bytes, rate: int = RATE) -> bytes:
    """An Ogg file of two logical streams: 8-bit samples in packets of ``PACKET``, and a mark for each second."""
    serial = zlib.crc32(payload)
    n = len(payload) // PACKET
    audio = [AUDIO_MAGIC + struct.pack("<II", rate, PACKET), *(payload[i * PACKET : (i + 1) * PACKET] for i in range(n))]
    clock = [0, *range(PACKET, (n + 1) * PACKET, PACKET)]
    seconds = len(payload) // rate
    marks = [MARK_MAGIC + struct.pack("<I", rate), *(struct.pack("<I", k) for k in range(seconds + 1))]
    return multiplex([pages_of(serial, audio, clock), pages_of(serial ^ 0xFFFFFFFF, marks, [0, *(k * rate for k in range(seconds + 1))])])


def load(media: bytes) -> tuple[bytes, dict]:
    """The samples of a stored file and what was found on the way; raises where a page is damaged or missing."""
    streams, bad = demultiplex(media)
    audio = next((s for s in streams.values() if s.packets and s.packets[0].startswith(AUDIO_MAGIC)), None)
    marks = next((s for s in streams.values() if s.packets and s.packets[0].startswith(MARK_MAGIC)), None)
    if bad or audio is None or marks is None or audio.lost or not audio.ended:
        raise ValueError("damaged Ogg file")
    rate, unit = struct.unpack("<II", audio.packets[0][len(AUDIO_MAGIC) :])
    times = end_times(audio, unit, rate)
    return b"".join(audio.packets[1:]), {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(audio.packets) - 1, "marks": len(marks.packets) - 1, "seconds": times[-1]}


def features(samples: bytes, seen: dict) -> str:
    """A short description of the samples that were read back and of the file's structure."""
    x = np.frombuffer(samples, np.uint8)
    centred = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return f"streams={seen['streams']};pages={seen['pages']};packets={seen['packets']};marks={seen['marks']};seconds={seen['seconds']:.3f};mean={x.mean():.4f};rms={np.sqrt(np.mean(centred.astype(np.float64) ** 2)):.4f};crossings={crossings}"


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def pad(text: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of ``PACKET``."""
    return text + b"\xff" * (max(1, -(-len(text) // PACKET)) * PACKET - len(text))


def digests(texts: Iterable[bytes]) -> Iterator[tuple]:
    for text in texts:
        media = store(pad(text))
        samples, seen = load(media)
        yield (len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples, seen))


def op9(docs: DataFrame) -> DataFrame:
    """Store every text as an Ogg file, read it back and describe it; a null text is an empty one.

    Each row is handled alone: memory is that of one text, equal texts give equal values, repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = list(zip(*digests(x.as_buffer().to_pybytes() for x in b.column(1)), strict=True)) or [[]] * 7
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names)

    return python_batches(docs).select(F.col("doc_id").cast("bigint"), F.encode(text_or_empty(), "UTF-8").alias("text")).mapInArrow(run, SCHEMA)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): the Ogg files themselves, as a media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.record_batch([b.column(0).slice(i, 1), pa.array([store(pad(b.column(1)[i].as_buffer().to_pybytes()))], pa.binary())], ["doc_id", "media"])

    return python_batches(docs).select(F.col("doc_id").cast("bigint"), F.encode(text_or_empty(), "UTF-8").alias("text")).mapInArrow(run, "doc_id bigint, media binary")


def packets(media: DataFrame, unit: int = PACKET, rate: int = RATE) -> DataFrame:
    """A row for each packet of a column ``media``: doc_id, serial, packet, seconds at its end, data, bad pages of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, raw in zip(b.column(0), b.column(1), strict=True):
                streams, bad = demultiplex(raw.as_py() or b"")
                for serial, s in sorted(streams.items()):
                    n = len(s.packets)
                    yield pa.record_batch(
                        [pa.array([doc.as_py()] * n, pa.int64()), pa.array([serial] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(end_times(s, unit, rate), pa.float64()), pa.array(s.packets, pa.binary()), pa.array([bad] * n, pa.int32())],
                        ["doc_id", "serial", "packet", "seconds", "data", "bad_pages"],
                    )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id bigint, serial bigint, packet int, seconds double, data binary, bad_pages int")
