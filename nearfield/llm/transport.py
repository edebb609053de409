"""Media columns: MPEG transport streams.

A payload of 8-bit samples is stored as one programme of a transport stream (ISO/IEC 13818-1): a programme
association table, a programme map table, and elementary packets of at most AU samples that carry a time
stamp each, every RAP_EVERY-th of them marked as a random-access point. Reading parses the tables, checks
the continuity counters, reassembles the elementary packets and lists time stamps with access points.

The streams are stored in a Parquet table in the shared folder, one row per document, and read back from
there. No step shuffles.

Edge cases: a null text is the empty text (one unit of spaces); equal texts give equal streams; very long
texts only make more packets; an empty table gives an empty result; repeated rows stay; a stream with a
broken sync byte, table or counter raises nothing, it is reported in the counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.common import stored, text_of

UNIT = 192
PACKET, PMT_PID, ES_PID, PROGRAM = 188, 0x100, 0x101, 1
AU = UNIT * 64
RATE, CLOCK = 48_000, 90_000
RAP_EVERY = 8
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in elementary packets
_PES_HEAD, _FIRST = 14, PACKET - 4 - 8 - 14


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 255, pts >> 14 & 255 | 1, pts >> 7 & 255, pts << 1 & 255 | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    data = np.frombuffer(payload, np.uint8)
    parts, counter = [TABLES], 0
    for unit, at in enumerate(range(0, len(data), AU)):
        chunk = data[at : at + AU]
        n = 1 + max(0, -(-(len(chunk) - _FIRST) // 184))
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        pts = at * CLOCK // RATE & (1 << 33) - 1
        out[0, 1] |= 0x40
        first = chunk[:_FIRST]
        pad = _FIRST - len(first)
        out[0, 3] |= 0x20
        out[0, 4], out[0, 5] = 7 + pad, (0x40 if unit % RAP_EVERY == 0 else 0) | 0x10
        out[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        length = len(chunk) + 8
        out[0, 12 + pad : 26 + pad] = np.frombuffer(bytes([0, 0, 1, STREAM_ID, length >> 8, length & 255, 0x84, 0x80, 5]) + _stamp(pts), np.uint8)
        out[0, 26 + pad :] = first
        if n > 1:
            rest = chunk[_FIRST:]
            whole = len(rest) // 184
            out[1 : 1 + whole, 4:] = rest[: whole * 184].reshape(whole, 184)
            if left := len(rest) - whole * 184:
                out[-1, 3] |= 0x20
                out[-1, 4] = 183 - left
                if left < 183:
                    out[-1, 5] = 0
                out[-1, PACKET - left :] = rest[whole * 184 :]
        parts.append(out.tobytes())
    return b"".join(parts)


def _sections(packets: np.ndarray, pid: int, pids: np.ndarray) -> list[bytes]:
    """Bodies of the valid sections that start in packets of a PID."""
    out = []
    for p in packets[(pids == pid) & (packets[:, 1] & 0x40 > 0)]:
        raw = p.tobytes()
        at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
        at += 1 + raw[at] if at < PACKET else 0
        end = at + 3 + ((raw[at + 1] & 15) << 8 | raw[at + 2]) if at + 3 <= PACKET else PACKET + 1
        if end <= PACKET and crc32_mpeg(raw[at:end]) == 0:
            out.append(raw[at + 8 : end - 4])
    return out


def demux(media: bytes) -> dict:
    """payload, pid, packets, elementary packets, errors of counters, time stamps and access points of a stream."""
    packets = np.frombuffer(media, np.uint8)[: len(media) // PACKET * PACKET].reshape(-1, PACKET)
    packets = packets[packets[:, 0] == 0x47]
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    found = {"payload": b"", "pid": -1, "packets": len(packets), "pes": 0, "cc_errors": 0, "pts": [], "rap": []}
    maps = [(b[i + 2] & 31) << 8 | b[i + 3] for b in _sections(packets, 0, pids) for i in range(0, len(b) - 3, 4) if b[i] << 8 | b[i + 1]]
    streams = [(b[5 + (k := (b[2] & 15) << 8 | b[3])] & 31) << 8 | b[6 + k] for m in maps for b in _sections(packets, m, pids) if len(b) >= 9]
    if not streams:
        return found
    own = packets[pids == streams[0]]
    found["pid"] = streams[0]
    has_af, has_data = own[:, 3] & 0x20 > 0, own[:, 3] & 0x10 > 0
    counters = own[has_data, 3] & 15
    found["cc_errors"] = int(((counters[1:] - counters[:-1]) & 15 != 1).sum())
    at = 4 + np.where(has_af, 1 + own[:, 4].astype(np.int32), 0)
    at[~has_data] = PACKET
    size = np.maximum(PACKET - at, 0)
    data = own[np.arange(PACKET) >= at[:, None]].tobytes()
    offsets = np.concatenate([[0], np.cumsum(size)])
    starts = np.flatnonzero(own[:, 1] & 0x40)
    parts = []
    for i, k in enumerate(starts):
        a, b = int(offsets[k]), int(offsets[starts[i + 1]] if i + 1 < len(starts) else offsets[-1])
        head = data[a : a + _PES_HEAD]
        if len(head) < 9 or head[:3] != b"\0\0\1":
            continue
        b = min(b, a + 6 + (head[4] << 8 | head[5])) if head[4] | head[5] else b
        if head[7] & 0x80 and len(head) == _PES_HEAD:
            pts = (head[9] >> 1 & 7) << 30 | head[10] << 22 | head[11] >> 1 << 15 | head[12] << 7 | head[13] >> 1
            found["pts"].append(pts)
            if has_af[k] and own[k, 4] and own[k, 5] & 0x40:
                found["rap"].append(pts)
        parts.append(data[a + 9 + head[8] : b])
    found["payload"], found["pes"] = b"".join(parts), len(parts)
    return found


def padded(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [x.encode() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.large_binary())], names=["doc_id", "n_bytes", "media"])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in batch.column("media"):
            media = media.as_py()
            x = demux(media)
            payload = x["payload"]
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(f"pid={x['pid']};packets={x['packets']};pes={x['pes']};cc_errors={x['cc_errors']};last_pts={x['pts'][-1] if x['pts'] else -1};access={'/'.join(map(str, x['rap']))}")
        types = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", "n_bytes", *out])


def encode_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the stored table of streams."""
    return stored(docs.select("doc_id", text_of(text_col).alias("text")).mapInArrow(_store, "doc_id bigint, n_bytes bigint, media binary"), "media")


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text as a transport stream, read it back, and describe it."""
    return encode_media(docs).mapInArrow(_load, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
