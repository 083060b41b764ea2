import hashlib
import random
import zlib

import pytest

from flowgrain.llm import ogg


def slow_checksum(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_the_containers():
    rng = random.Random(3)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("sizes", [[0], [254, 255, 256], [70_000, 0, 510, 65_025, 1], [255 * 255, 255 * 255 * 2 + 7, 3]])
def test_packets_come_back_from_two_streams(sizes):
    rng = random.Random(5)
    a = [rng.randbytes(n) for n in sizes]
    b = [rng.randbytes(n % 999) for n in sizes]
    raw = ogg.multiplex([ogg.pages_of(1, a, list(range(len(a)))), ogg.pages_of(2, b, list(range(len(b))))])
    streams, bad = ogg.demultiplex(raw)
    assert bad == 0 and streams[1].packets == a and streams[2].packets == b
    assert streams[1].ended and streams[1].lost == 0 and streams[1].granules[-1] == len(a) - 1


def test_a_damaged_page_is_found_and_the_rest_survives():
    payload = ogg.pad(random.Random(7).randbytes(200_000))
    raw = bytearray(ogg.store(payload))
    raw[100_000] ^= 1
    streams, bad = ogg.demultiplex(bytes(raw))
    assert bad == 1
    audio = streams[zlib.crc32(payload)]
    whole = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    assert audio.lost and set(audio.packets[1:]) <= set(whole) and len(audio.packets) > len(whole) - 90
    with pytest.raises(ValueError):
        ogg.load(bytes(raw))


def test_times_are_counted_back_from_known_positions():
    media = ogg.store(ogg.pad(b"x" * 60_000))
    streams, _ = ogg.demultiplex(media)
    audio = streams[zlib.crc32(ogg.pad(b"x" * 60_000))]
    assert audio.granules.count(-1) > 50
    assert ogg.end_times(audio, 576) == [i * 576 / 8000 for i in range(len(audio.packets))]


def test_query_is_a_lossless_round_trip(spark):
    texts = ["", None, "é" * 400, "a" * 576, "long " * 40_000, "a" * 576]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, feature string")
    rows = {r.doc_id: r for r in ogg.op9(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = ogg.pad(raw)
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(payload)) and len(payload) % 576 == 0 and payload
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[i].tail_crc32 == zlib.crc32(payload[-32:])
        media = ogg.store(payload)
        assert (rows[i].media_bytes, rows[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[3][1:] == rows[5][1:]
    back = ogg.packets(ogg.stored(df)).where("serial >= 0").collect()
    assert b"".join(r.data for r in sorted((r for r in back if r.doc_id == 4 and not r.data.startswith(b"\x80") and len(r.data) == 576), key=lambda r: r.packet)) == ogg.pad(("long " * 40_000).encode())
    assert ogg.op9(df.limit(0)).count() == 0
