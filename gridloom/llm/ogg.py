"""Ogg containers in a binary column: page checksums, packets from lacing values, streams and timestamps.

``mux`` writes logical streams of packets as interleaved pages; ``parse_pages`` verifies each page's checksum and
skips damaged bytes to the next capture pattern; ``packets`` joins lacing segments (across pages where a packet
continues) per logical stream and derives a packet's timestamp from the granule position of its page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, table

MAGIC = b"OggS"
#: Bytes of a data packet; 16 lacing values each, so that packets cross page ends.
PACKET = 4000
#: Samples a second of the 8-bit streams written here.
RATE = 8000
#: First bytes of a stream's header packet: name, version, sample rate, place among the streams, number of streams.
HEADER = struct.Struct("<8sBIHH")
HEADER_NAME = b"\x7fPCM8\0\0\0"
STREAMS = 2

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class Page(NamedTuple):
    serial: int
    sequence: int
    flags: int
    granule: int
    valid: bool
    lacing: bytes
    body: bytes


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no inversion: the reflected CRC of reversed bits."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", MAGIC, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:]


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """Pages of logical streams, by serial number: packets with the granule position at their end. First pages come first."""
    pages: list[tuple[bool, int, int, bytes]] = []
    for serial, items in streams.items():
        lacing, body, sequence, granule, continued, at = bytearray(), bytearray(), 0, -1, False, 0
        done: list[tuple[int, bytes, bytes, bool]] = []
        for k, (packet, end) in enumerate(items):
            values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
            at = 0
            for v in values:
                if len(lacing) == 255:
                    done.append((granule, bytes(lacing), bytes(body), continued))
                    lacing, body, granule, continued = bytearray(), bytearray(), -1, at > 0
                lacing.append(v)
                body += packet[at : at + v]
                at += v
            granule = end
            if k == 0:
                done.append((granule, bytes(lacing), bytes(body), continued))
                lacing, body, granule, continued = bytearray(), bytearray(), -1, False
        if lacing:
            done.append((granule, bytes(lacing), bytes(body), continued))
        last = 0
        for sequence, (granule, lac, bod, cont) in enumerate(done):
            flags = cont | 2 * (sequence == 0) | 4 * (sequence == len(done) - 1)
            last = max(last, granule)
            pages.append((sequence > 0, last, serial, _page(serial, sequence, flags, granule, lac, bod)))
    return b"".join(p[3] for p in sorted(pages, key=lambda p: p[:3]))


def parse_pages(media: bytes) -> Iterator[Page]:
    at = media.find(MAGIC)
    while 0 <= at and at + 27 <= len(media):
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            at = media.find(MAGIC, at + 1)
            continue
        whole = media[at:end]
        valid = checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == crc
        yield Page(serial, sequence, flags, granule, valid, lacing, whole[27 + n :])
        at = media.find(MAGIC, end if valid else at + 1)


def packets(pages: list[Page]) -> dict[int, list[tuple[bytes, int]]]:
    """Whole packets of each logical stream with the granule position known at their end (-1: unknown).

    Damaged pages count as lost; what continues over a lost page is dropped, as the format prescribes.
    """
    out: dict[int, list[tuple[bytes, int]]] = {}
    open_: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    for p in pages:
        if not p.valid:
            continue
        done = out.setdefault(p.serial, [])
        part = open_.get(p.serial)
        if expected.get(p.serial, p.sequence) != p.sequence or not p.flags & 1:
            part = None
        skip = bool(p.flags & 1) and part is None
        part, at, first = part or bytearray(), 0, len(done)
        for v in p.lacing:
            part += p.body[at : at + v]
            at += v
            if v < 255:
                if not skip:
                    done.append((bytes(part), -1))
                part, skip = bytearray(), False
        if len(done) > first and p.granule >= 0:
            done[-1] = (done[-1][0], p.granule)
        open_[p.serial] = part if p.lacing and p.lacing[-1] == 255 and not skip else None
        expected[p.serial] = p.sequence + 1
    return out


def encode(payload: bytes) -> bytes:
    """8-bit samples as Ogg: packets of PACKET samples dealt in turn to STREAMS logical streams."""
    streams: dict[int, list[tuple[bytes, int]]] = {s: [(HEADER.pack(HEADER_NAME, 1, RATE, s, STREAMS), 0)] for s in range(STREAMS)}
    ends = [0] * STREAMS
    for k, at in enumerate(range(0, len(payload), PACKET)):
        packet = payload[at : at + PACKET]
        ends[k % STREAMS] += len(packet)
        streams[k % STREAMS].append((packet, ends[k % STREAMS]))
    return mux(streams)


def decode(media: bytes) -> tuple[bytes, str]:
    """The samples back, and what was seen: pages, bad pages, streams, packets, samples and each stream's length in ms."""
    pages = list(parse_pages(media))
    by_place: dict[int, list[bytes]] = {}
    times, count = [], 0
    found = packets(pages)
    for serial in sorted(found):
        own = found[serial]
        if not own or len(own[0][0]) != HEADER.size or own[0][0][:8] != HEADER_NAME:
            continue
        _, _, rate, place, _ = HEADER.unpack(own[0][0])
        by_place[place] = [p for p, _ in own[1:]]
        count += len(own) - 1
        times.append(f"{max([0, *(g for _, g in own)]) * 1000 // rate}")
    turns = max(map(len, by_place.values()), default=0)
    payload = b"".join(by_place[s][k] for k in range(turns) for s in sorted(by_place) if k < len(by_place[s]))
    bad = sum(not p.valid for p in pages)
    return payload, f"pages={len(pages)};bad={bad};streams={len(by_place)};packets={count};samples={len(payload)};ms={'/'.join(times)}"


def probe(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row per page of each Ogg file in a binary column.

    Columns: key, page (from 0), serial, sequence, flags, granule, valid, packets (that end on the page), body_bytes.
    Null or empty media and media without a capture pattern give no rows; damaged pages have valid = false.
    """
    kind = media.schema[key].dataType.simpleString()

    def read(batches):
        for batch in batches:
            rows = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(k, i, p.serial, p.sequence, p.flags, p.granule, p.valid, sum(v < 255 for v in p.lacing), len(p.body)) for i, p in enumerate(parse_pages(bytes(m or b"")))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "page", "serial", "sequence", "flags", "granule", "valid", "packets", "body_bytes"])

    return media.select(key, column).mapInArrow(read, f"key {kind}, page int, serial long, sequence long, flags int, granule long, valid boolean, packets int, body_bytes long").withColumnRenamed("key", key)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Every text as an Ogg file, read back: the key, the digest of what came back, and ``media`` if asked for.

    A null text is empty. The payload is the UTF-8 text with zero bytes up to a positive multiple of 64. Texts of
    any length are stored whole; repeated rows give the same values; other columns are left aside.
    Rows that repeat are each read back, equal texts alike. An empty table gives an empty result.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if keep_media else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if keep_media else [])]

    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                rows = []
                for k in range(j - i):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    media = encode(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))
                    payload, seen = decode(media)
                    rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), seen, *([media] if keep_media else [])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))],
                    ["key", *names],
                )

    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def op6_ogg_media(spark, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
