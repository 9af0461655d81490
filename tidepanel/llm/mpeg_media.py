"""MPEG audio media columns: storing a payload in MPEG-1 Layer III frames, and reading any such stream.

Stored form: an ID3v2 tag naming the unpadded length, an Info frame (frame and byte counts, seek table), then one frame
of 240 bytes (80 kbit/s, 48 kHz, mono, CRC-protected) for each 192 payload bytes. The frames' side information says that
no audio is coded, so they play as silence, and the payload stands in what the format calls ancillary data.

The reader skips ID3v2, ID3v1 and APE tags (bytes that read as an ID3v1 tag are none if a frame from before them ends with the stream), resynchronises on frame headers (a header counts if another fits at the next
frame's place, or the stream ends there), parses Xing, Info and VBRI tables, verifies each protected Layer III frame's
CRC-16 over header and side information, and gives exact durations (samples over rate) and each frame's offset.

Null texts are empty; an empty text is 192 spaces. Long texts are stored and read whole, one at a time. Columns besides doc_id
and text are not read. Equal texts give equal bytes. Repeated rows give a row each. A stream
without frames has 0 frames and 0 samples. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, stage, text_of

UNIT = 192  # payload bytes a frame
# Fixed values of the format: bit rates in kbit/s by index 1-14, for MPEG-1 layers I to III and for MPEG-2 and 2.5.
RATES_1 = {1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
RATES_2 = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits: MPEG-1, 2, 2.5


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def parse_header(b: bytes) -> Header | None:
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
    index, rate_index, padding = b[2] >> 4, b[2] >> 2 & 3, b[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    kbps = (RATES_1 if version == 3 else RATES_2)[layer][index - 1]
    rate = SAMPLE_RATES[version][rate_index]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * kbps * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
    return Header(version, layer, not b[1] & 1, kbps, rate, b[3] >> 6 == 3, size, samples)


def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005 from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for x in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ x]
    return crc


def _crc_row(i: int) -> int:
    c = i << 8
    for _ in range(8):
        c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


_CRC = [_crc_row(i) for i in range(256)]
_HEAD = bytes([0xFF, 0xFA, 0x64, 0xC4])  # MPEG-1 Layer III, protected, 80 kbit/s, 48 kHz, mono
_FRAME = parse_header(_HEAD)
_SIDE = bytes(_FRAME.side)
_FRONT = _HEAD + struct.pack(">H", crc16(_HEAD[2:] + _SIDE)) + _SIDE


def pad(text: bytes) -> bytes:
    return text + b" " * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def build(payload: bytes, n_bytes: int) -> bytes:
    """The stored form of a payload of whole units."""
    value = b"\x00n_bytes\x00%d" % n_bytes
    frame = b"TXXX" + _synchsafe(len(value)) + b"\x00\x00" + value
    tag = b"ID3\x04\x00\x00" + _synchsafe(len(frame)) + frame
    n = len(payload) // UNIT
    toc = bytes(min(255, (k * n // 100 + 1) * 256 // (n + 1)) for k in range(100))
    info = (_FRONT + b"Info" + struct.pack(">III", 7, n, (n + 1) * _FRAME.size) + toc).ljust(_FRAME.size, b"\0")
    frames = np.zeros((n, _FRAME.size), np.uint8)
    frames[:, : len(_FRONT)] = np.frombuffer(_FRONT, np.uint8)
    frames[:, len(_FRONT) : len(_FRONT) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + info + frames.tobytes()


@dataclass
class Stream:
    """What a stream holds: tags by name, the table's fields, and per frame its offset; checks that failed; bytes skipped."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    headers: list[Header] = field(default_factory=list)  # distinct, in order of first use
    samples: int = 0
    rate: int = 0
    bad_crc: int = 0
    checked: int = 0
    skipped: int = 0
    end: int = 0  # of the last frame
    kbps: set[int] = field(default_factory=set)


def _id3v2(b: bytes, at: int, out: Stream) -> int:
    size = b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9]
    k, end = at + 10, min(len(b), at + 10 + size)
    while k + 10 <= end and b[k]:
        raw = b[k + 4 : k + 8]
        length = int.from_bytes(raw, "big") if b[at + 3] == 3 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
        name, body = b[k : k + 4].decode("latin-1"), b[k + 10 : k + 10 + length]
        if name == "TXXX":
            key, _, value = body[1:].partition(b"\0")
            out.tags[f"TXXX:{key.decode('latin-1')}"] = value.decode("latin-1")
        elif name[0] == "T":
            out.tags[name] = body[1:].decode("latin-1").rstrip("\0")
        k += 10 + length
    return at + 10 + size + (10 if b[at + 5] & 16 else 0)


def _table(frame: bytes, h: Header) -> dict[str, int]:
    """A Xing, Info or VBRI table in the first frame."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, k, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"vbr": int(frame[at : at + 4] == b"Xing")}
        for bit, name, length in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                if name != "toc":
                    out[name] = int.from_bytes(frame[k : k + length], "big")
                k += length
        return out
    if frame[36:40] == b"VBRI":
        return {"vbr": 1, "quality": int.from_bytes(frame[44:46], "big"), "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return {}


def _crc_holds(frame: bytes, h: Header) -> bool:
    return crc16(frame[2:4] + frame[6 : 6 + h.side]) == int.from_bytes(frame[4:6], "big")


def _even(b: bytes, at: int, end: int, h: Header) -> int:
    """How many frames from `at` on repeat the first one's header, checksum and side information to the byte."""
    front = 4 + (2 + h.side) * (h.protected and h.layer == 3)
    n = (end - at) // h.size
    rows = np.frombuffer(b, np.uint8, n * h.size, at).reshape(n, h.size)
    differs = np.flatnonzero((rows[:, :front] != rows[0, :front]).any(1)) if n else np.zeros(0, int)
    return int(differs[0]) if len(differs) else n


def parse(b: bytes, id3v1: bool = True) -> Stream:
    out, at, end, first, offsets = Stream(), 0, len(b), True, []
    if id3v1 and b[-128:-125] == b"TAG" and len(b) >= 128:
        inside = parse(b, id3v1=False)
        if len(inside.offsets) and inside.offsets[-1] < end - 128 and inside.end == end:  # bytes of the last frame, no tag
            return inside
        end -= 128
        out.tags["TIT2"] = out.tags.get("TIT2", b[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    if b[end - 32 : end - 24] == b"APETAGEX":
        end -= int.from_bytes(b[end - 20 : end - 16], "little") + (32 if b[end - 9] & 128 else 0)
    while b[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(b, at, out)
    while at + 4 <= end:
        h = parse_header(b[at : at + 4])
        follows = h and at + h.size <= end and (at + h.size + 4 > end or parse_header(b[at + h.size : at + h.size + 4]))
        if not follows:
            step = b.find(b"\xff", at + 1, end)
            out.skipped += (step if step >= 0 else end) - at
            at = step if step >= 0 else end
            continue
        if h not in out.headers:
            out.headers.append(h)
        out.rate = out.rate or h.rate
        checks = h.protected and h.layer == 3
        if first:
            first = False
            out.table = _table(b[at : at + h.size], h)
            if out.table:  # the table's frame holds no audio
                if checks:
                    out.checked, out.bad_crc = 1, int(not _crc_holds(b[at : at + h.size], h))
                at += h.size
                continue
        n = max(1, _even(b, at, end, h))
        offsets.append(at + h.size * np.arange(n, dtype=np.int64))
        out.samples += n * h.samples
        out.end = at + n * h.size
        out.kbps.add(h.kbps)
        if checks:
            out.checked += n
            out.bad_crc += 0 if _crc_holds(b[at : at + h.size], h) else n
        at += n * h.size
    out.skipped += max(0, end - at)
    if offsets:
        out.offsets = np.concatenate(offsets)
    return out


def payload_of(b: bytes, s: Stream) -> bytes:
    """The ancillary units of the frames that build() wrote."""
    start, size, n = len(_FRONT), _FRAME.size, len(s.offsets)
    if not n:
        return b""
    if (np.diff(s.offsets) == size).all():
        rows = np.frombuffer(b, np.uint8, n * size, int(s.offsets[0])).reshape(n, size)
        return rows[:, start : start + UNIT].tobytes()
    return b"".join(b[k + start : k + start + UNIT] for k in s.offsets.tolist())


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            for k in range(0, len(texts), 256):
                media = [build(pad(t), len(t)) for t in texts[k : k + 256]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(media)), pa.array(media, pa.binary())], ["doc_id", "media"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {id_type}, media binary")


def read_media(media: DataFrame, with_offsets: bool = True) -> DataFrame:
    """From doc_id, media: sizes, sums, exact duration, seek offsets (frame k starts at offsets[k]) and the feature string."""
    id_type = media.schema["doc_id"].dataType.simpleString()
    # the duration is samples / sample_rate seconds, both exact
    fields = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, samples long, sample_rate int, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.column(1).to_pylist():
                b = b or b""
                s = parse(b)
                p = payload_of(b, s)
                n = len(s.offsets)
                shares = [k * n // 4 for k in range(4)] if n else []
                seek = "/".join(str(int(s.offsets[k])) for k in shares)
                text = f"mpeg{'/'.join(f'{h.version}.{h.layer}' for h in s.headers)};hz={s.rate};kbps={'/'.join(map(str, sorted(s.kbps)))};frames={n};samples={s.samples};table={s.table.get('frames', -1)};crc={s.checked - s.bad_crc}/{s.checked};skipped={s.skipped};seek={seek}"
                row = (int(s.tags.get("TXXX:n_bytes", -1)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(b), hashlib.sha256(b).hexdigest(), n, s.samples, s.rate, text)
                rows.append((*row, s.offsets) if with_offsets else row)
            names = fields.replace(", offsets array<long>", "").split(", ")[1:]
            kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
            cols = [pa.array([r[k] for r in rows], kinds[x.split()[1]]) for k, x in enumerate(names)]
            out = [batch.column(0), *cols] + ([pa.array([r[-1] for r in rows], pa.list_(pa.int64()))] if with_offsets else [])
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *(x.split()[0] for x in names)] + ["offsets"] * with_offsets)

    return media.select("doc_id", "media").mapInArrow(run, fields + ", offsets array<long>" * with_offsets)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Stores all texts, reads the stored bytes back: read_media()'s columns, exact durations and all frames' offsets among them."""
    return read_media(stage(encode_media(docs), "media"))
