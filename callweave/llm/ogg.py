"""Media columns in an Ogg container.

`ogg_encode` stores each text's padded UTF-8 bytes as 8-bit samples in a physical Ogg stream with two logical
streams: the samples, and a check track that holds the CRC-32 of each sample packet. `ogg_decode` reads such a
column: it verifies every page checksum, rebuilds packets from the lacing values (also those that run over
several pages), demultiplexes by serial number and derives times from granule positions.

Both are mapInArrow stages over single rows: no shuffle, memory bounded by one Arrow batch.

Defined cases: null text counts as empty; an empty text is stored as 64 zero bytes. Equal texts give equal media.
A stream with a damaged page, a gap in page numbers or a wrong check track raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RATE = 8000
BLOCK = 64
PACKET = 16384
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


def page_crc(*parts: bytes) -> int:
    """The container's checksum (polynomial 04C11DB7, most significant bit first, start 0).

    It is the mirror image of zlib's: feed bit-reversed bytes from state 0 and reverse the 32-bit result.
    """
    state = 0xFFFFFFFF
    for part in parts:
        state = zlib.crc32(part.translate(_REVERSED), state)
    return int.from_bytes((state ^ 0xFFFFFFFF).to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_crc(head, lacing, body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def _pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """One logical stream. packets: (data, granule position at its end). The first packet has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, flags, number = bytearray(), bytearray(), -1, FIRST, 0

    def flush(last: bool, into_packet: bool) -> None:
        nonlocal lacing, body, granule, flags, number
        out.append(_page(flags | (LAST if last else 0), granule, serial, number, bytes(lacing), bytes(body)))
        lacing, body, granule, flags, number = bytearray(), bytearray(), -1, CONTINUED if into_packet else 0, number + 1

    for k, (data, end) in enumerate(packets):
        values, at = [255] * (len(data) // 255) + [len(data) % 255], 0
        while values:
            room = 255 - len(lacing)
            take, values = values[:room], values[room:]
            n = sum(take)
            lacing += bytes(take)
            body += data[at : at + n]
            at += n
            if not values:
                granule = end
            if values or len(lacing) == 255 or k == 0 or k == len(packets) - 1:
                flush(last=not values and k == len(packets) - 1, into_packet=bool(values))
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The physical stream of a payload whose first n_bytes are the text."""
    serial = zlib.crc32(payload) & 0x7FFFFFFE
    cuts = range(0, len(payload), PACKET)
    samples = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in cuts]
    sound = _pages([(struct.pack("<8sIQ", b"\x01samples", RATE, n_bytes), 0), *samples], serial)
    track = _pages([(struct.pack("<8sI", b"\x01checks\0", len(samples)), 0), *((zlib.crc32(d).to_bytes(4, "little"), g) for d, g in samples)], serial + 1)
    mixed = [sound[0], track[0]]
    for i in range(1, max(len(sound), len(track))):
        mixed += sound[i : i + 1] + track[i : i + 1]
    return b"".join(mixed)


def demultiplex(media: bytes) -> dict[int, dict]:
    """serial -> packets (bytes), ends (granule position where the packet ends its page, else -1), pages, complete."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError(f"cut off page at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        size = sum(lacing)
        body = media[at + 27 + n : at + 27 + n + size]
        if len(body) != size or page_crc(media[at : at + 22], b"\0\0\0\0", media[at + 26 : at + 27], lacing, body) != crc:
            raise ValueError(f"page at byte {at} is damaged")
        s = streams.setdefault(serial, {"packets": [], "ends": [], "pages": 0, "open": None, "complete": False})
        if number != s["pages"] or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != (s["open"] is not None) or s["complete"]:
            raise ValueError(f"page {number} of stream {serial} is out of place")
        s["pages"] += 1
        s["complete"] = bool(flags & LAST)
        part, done = s["open"] or b"", 0
        start = 0
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                s["packets"].append(part + body[start : start + run])
                s["ends"].append(-1)
                part, start, run, done = b"", start + run, 0, done + 1
        s["open"] = part + body[start:] if run or (lacing and lacing[-1] == 255) else None
        if done:
            s["ends"][-1] = granule
        elif granule != -1:
            raise ValueError(f"page {number} of stream {serial} has a time but ends no packet")
        at += 27 + n + size
    if not all(s["complete"] and s["open"] is None for s in streams.values()):
        raise ValueError("a logical stream has no end")
    return streams


def decode(media: bytes) -> dict:
    """Payload, text length, times and features of a stream that encode() wrote."""
    streams = demultiplex(media)
    sound = next((s for s in streams.values() if s["packets"][0][:8] == b"\x01samples"), None)
    track = next((s for s in streams.values() if s["packets"][0][:8] == b"\x01checks\0"), None)
    if sound is None or track is None:
        raise ValueError("a logical stream is missing")
    _, rate, n_bytes = struct.unpack("<8sIQ", sound["packets"][0])
    data = sound["packets"][1:]
    if [zlib.crc32(d).to_bytes(4, "little") for d in data] != track["packets"][1:]:
        raise ValueError("the check track disagrees with the samples")
    payload = b"".join(data)
    if sound["ends"][-1] != len(payload):
        raise ValueError("the last granule position disagrees with the samples")
    wave = np.frombuffer(payload, np.uint8)
    high = wave >= 128
    feature = {
        "ms": sound["ends"][-1] * 1000 // rate, "packets": len(data), "pages": sum(s["pages"] for s in streams.values()), "sum": int(wave.sum(dtype=np.int64)),
        "peak": int(wave.max()), "crossings": int(np.count_nonzero(high[1:] != high[:-1])),
    }
    return {"payload": payload, "n_bytes": n_bytes, "feature": ";".join(f"{k}={v}" for k, v in feature.items())}


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(-len(raw) % BLOCK, 0 if raw else BLOCK)), len(raw)


def ogg_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): each row's text as an Ogg stream."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [encode(*padded(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=[id_col, "media"])

    schema = T.StructType([docs.schema[id_col], T.StructField("media", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(stage, schema)


def ogg_decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload, feature) read from an Ogg column; null media gives null results."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(m) if m is not None else {} for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x.get(k) for x in found], t) for k, t in (("n_bytes", pa.int64()), ("payload", pa.binary()), ("feature", pa.string())))],
                names=[id_col, "n_bytes", "payload", "feature"],
            )

    schema = T.StructType([media.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])
    return media.select(id_col, media_col).mapInArrow(stage, schema)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media, read it back, and report digests of both forms.

    The stored form and what is read back stay inside one Arrow stage, so no payload crosses to the JVM.
    """
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                media = encode(*padded(t))
                back = decode(media)
                p = back["payload"]
                rows.append((back["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), back["feature"]))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    types = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in zip(names[1:], types))])
    return docs.select(id_col, text_col).mapInArrow(stage, schema)
