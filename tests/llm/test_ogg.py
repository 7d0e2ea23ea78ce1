import hashlib
import random
import zlib

from gridloom.llm import ogg


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    r = random.Random(1)
    for n in (0, 1, 7, 300):
        data = r.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)


def test_round_trip_of_any_length():
    r = random.Random(2)
    for n in (64, 3968, 4000, 4032, 8000, 63_744, 63_808, 65_024, 400_000):
        payload = r.randbytes(n)
        back, seen = ogg.decode(ogg.encode(payload))
        assert back == payload and ";bad=0;streams=2;" in seen and f"samples={n}" in seen


def test_packets_across_pages_and_timestamps():
    items = [(b"h", 0), (b"x" * 70_000, 70_000), (b"", 70_000), (b"y" * 255, 70_255), (b"z" * 510, 70_765)]
    media = ogg.mux({5: items, 9: [(b"q", 0), (b"w" * 10, 10)]})
    pages = list(ogg.parse_pages(media))
    assert all(p.valid for p in pages) and {p.serial for p in pages} == {5, 9} and pages[0].flags & 2 and pages[1].flags & 2
    found = ogg.packets(pages)
    assert [p for p, _ in found[5]] == [p for p, _ in items] and found[5][-1][1] == 70_765 and found[9] == [(b"q", 0), (b"w" * 10, 10)]
    assert any(p.flags & 1 for p in pages) and sum(p.flags & 4 > 0 for p in pages) == 2


def test_damage_loses_only_what_it_touches(spark):
    media = bytearray(ogg.mux({1: [(bytes([k]) * 30_000, k * 10) for k in range(1, 9)]}))
    media[100_000] ^= 1
    pages = list(ogg.parse_pages(bytes(media)))
    assert sum(not p.valid for p in pages) == 1
    whole = [p for p, _ in ogg.packets(pages)[1]]
    assert 4 <= len(whole) < 8 and all(len(set(p)) == 1 and len(p) == 30_000 for p in whole)
    rows = ogg.probe(spark.createDataFrame([(1, bytes(media)), (2, None), (3, b"junk")], "id long, m binary"), "id", "m").collect()
    assert len(rows) == len(pages) and sum(not r.valid for r in rows) == 1


def test_texts(documents, awkward):
    docs = documents([(1, "héllo"), (2, "héllo"), (3, None), (4, "a" * 64), (5, "a" * 65)])
    rows = {r.doc_id: r for r in ogg.store_texts(docs, keep_media=True).collect()}
    padded = "héllo".encode().ljust(64, b"\0")
    assert rows[1].n_bytes == 6 and rows[1].payload_sha256 == hashlib.sha256(padded).hexdigest() and rows[1].tail_crc32 == zlib.crc32(padded)
    assert [rows[i].payload_bytes for i in range(1, 6)] == [64, 64, 64, 64, 128]
    assert rows[1].media_sha256 == rows[2].media_sha256 == hashlib.sha256(rows[1].media).hexdigest() and rows[1].media_bytes == len(rows[1].media)
    assert rows[3].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert ogg.store_texts(awkward).count() == 9 and ogg.store_texts(awkward.limit(0)).count() == 0
