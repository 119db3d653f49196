"""MPEG audio as a column: frames that carry a payload, and a reader that resynchronises, checks and measures them.

The stored form is an ID3v2.4 tag (which gives the payload's length and crc32), a frame with a variable-bitrate table (Xing),
and MPEG-1 layer III frames at 32 kHz protected by checksums. A frame's body behind the side information is its unit
of storage: the payload fills bodies in order, and the last frame takes the least bit rate that holds the rest.

The reader takes frames of all three layers and versions, tags at either end (ID3v2, ID3v1) and both kinds of table (Xing or
Info, VBRI). It trusts no length that is stored: it searches frame headers, accepts one if a further header (or the end) follows
where the frame ends, skips damaged bytes, cuts the payload only to a length that its crc32 confirms, and looks for frames
inside an ID3v2 tag behind whose alleged end none stands. Checksums are verified in layer III; the other layers' cover
allocations that would have to be decoded, so these frames count as unchecked. Any bytes can be read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import in_batches, table

# Fixed values of the format: bit rates (kbit/s) by index, for version 1 by layer and for versions 2 and 2.5 by layer; sampling
# rates (Hz) by index, by version (3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5); samples of a frame by version and layer.
BIT_RATES_1 = {
    1: [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    2: [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    3: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
}
BIT_RATES_2 = {
    1: [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    3: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
BIT_RATES = {3: BIT_RATES_1, 2: BIT_RATES_2, 0: BIT_RATES_2}
SAMPLE_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SAMPLES = {3: {1: 384, 2: 1152, 3: 1152}, 2: {1: 384, 2: 1152, 3: 576}, 0: {1: 384, 2: 1152, 3: 576}}

HEADER, SUM, SIDE = 4, 2, 32
RATE_INDEX = 2
OVERHEAD = HEADER + SUM + SIDE


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The format's checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ CRC16[(value >> 8) ^ byte]
    return value


def _crc_entry(k: int) -> int:
    value = k << 8
    for _ in range(8):
        value = ((value << 1) ^ 0x8005) & 0xFFFF if value & 0x8000 else value << 1
    return value


CRC16 = [_crc_entry(k) for k in range(256)]


_sums: dict[bytes, int] = {}


def checked(data: bytes) -> int:
    """crc16, kept for the few header and side information bytes that recur."""
    if data not in _sums:
        if len(_sums) > 10_000:
            _sums.clear()
        _sums[data] = crc16(data)
    return _sums[data]


@dataclass(frozen=True)
class Header:
    version: int
    protected: bool
    bit_rate: int
    sample_rate: int
    channels: int
    length: int
    samples: int
    layer: int = 3

    @property
    def side(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.channels == 1 else 32) if self.version == 3 else (9 if self.channels == 1 else 17)

    @property
    def body(self) -> int:
        return HEADER + (SUM if self.protected else 0) + self.side


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """The frame header in four bytes, or None if they aren't one. Free-format frames are not taken."""
    if raw not in _headers:
        if len(_headers) > 10_000:
            _headers.clear()
        _headers[raw] = _header(raw)
    return _headers[raw]


def _header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, sample = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or sample == 3 or raw[3] & 3 == 2:
        return None
    bits, hertz, padding = BIT_RATES[version][layer][rate] * 1000, SAMPLE_RATES[version][sample], raw[2] >> 1 & 1
    samples = SAMPLES[version][layer]
    length = (12 * bits // hertz + padding) * 4 if layer == 1 else samples // 8 * bits // hertz + padding
    out = Header(version, not raw[1] & 1, bits, hertz, 1 if raw[3] >> 6 == 3 else 2, length, samples, layer)
    return out if length > out.body else None


def _frame_head(rate: int) -> bytes:
    raw = bytes([0xFF, 0xFA, rate << 4 | RATE_INDEX << 2, 0x00])
    return raw + struct.pack(">H", crc16(raw[2:] + bytes(SIDE))) + bytes(SIDE)


HEADS = {rate: _frame_head(rate) for rate in range(1, 15)}
LENGTHS = {rate: 144 * BIT_RATES[3][3][rate] * 1000 // SAMPLE_RATES[3][RATE_INDEX] for rate in range(1, 15)}
LARGEST = LENGTHS[14] - OVERHEAD


def syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(unit - len(text)) if len(text) < unit else text + bytes(-len(text) % unit)


def encode(payload: bytes) -> bytes:
    """The stored form of a payload."""
    owner = b"payload\0" + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + syncsafe(len(owner)) + b"\0\0" + owner
    frames = [HEADS[14] + payload[i : i + LARGEST] for i in range(0, len(payload) - LARGEST + 1, LARGEST)]
    rest = payload[len(frames) * LARGEST :]
    if rest:
        rate = next(r for r in range(1, 15) if LENGTHS[r] - OVERHEAD >= len(rest))
        frames.append(HEADS[rate] + rest + bytes(LENGTHS[rate] - OVERHEAD - len(rest)))
    sizes = [len(f) for f in frames]
    total, at, passed, places = sum(sizes), 0, 0, []
    for percent in range(100):
        while at < len(sizes) and at * 100 < percent * len(sizes):
            passed += sizes[at]
            at += 1
        places.append(min(255, passed * 256 // max(1, total)))
    table_frame = HEADS[9] + b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(places)
    return b"".join([b"ID3\4\0\0", syncsafe(len(tag)), tag, table_frame, bytes(LENGTHS[9] - len(table_frame)), *frames])


@dataclass
class Audio:
    payload: bytes = b""
    frames: int = 0
    samples: int = 0
    sample_rate: int = 0
    bad_sums: int = 0
    unchecked: int = 0
    skipped: int = 0
    id3v1: bool = False
    table_frames: int | None = None
    table_bytes: int | None = None
    declared: tuple[int, int] | None = None
    offsets: list[int] = field(default_factory=list)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.sample_rate if self.sample_rate else 0

    @property
    def intact(self) -> bool:
        return self.declared == (len(self.payload), zlib.crc32(self.payload)) and self.table_frames == self.frames and not self.bad_sums and not self.skipped

    @property
    def feature(self) -> str:
        return f"frames={self.frames};samples={self.samples};rate={self.sample_rate};us={self.duration_us};bad={self.bad_sums};skipped={self.skipped};vbr={self.table_frames}/{self.table_bytes};intact={int(self.intact)}"


def vbr_table(body: bytes, xing: int, out: Audio) -> bool:
    """Reads the table of a first frame's bytes behind its header: Xing or Info at ``xing``, or VBRI at its fixed place. Fields that
    the flags announce but that lie beyond the frame are left out."""
    number = lambda at: int.from_bytes(body[at : at + 4], "big") if at + 4 <= len(body) else None
    if body[xing : xing + 4] in (b"Xing", b"Info"):
        flags, at = number(xing + 4) or 0, xing + 8
        if flags & 1:
            out.table_frames, at = number(at), at + 4
        if flags & 2:
            out.table_bytes = number(at)
        return True
    if body[32:36] == b"VBRI":
        out.table_bytes, out.table_frames = number(42), number(46)
        return True
    return False


def audio_start(media: bytes, out: Audio) -> int:
    """Where the frames begin: behind an ID3v2 tag, or behind its own header if no frame stands at its alleged end."""
    if media[:3] != b"ID3" or len(media) < 10:
        return 0
    end, at = 10 + _syncsafe(media[6:10]), 10
    while at + 10 <= min(end, len(media)) and media[at]:
        size = _syncsafe(media[at + 4 : at + 8])
        if media[at : at + 4] == b"PRIV" and media[at + 10 : at + 18] == b"payload\0" and size == 20 and at + 30 <= len(media):
            out.declared = struct.unpack(">QI", media[at + 18 : at + 30])
        at += 10 + size
    return end if end == len(media) or header(media[end : end + 4]) else 10


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def decode(media: bytes) -> Audio:
    """Reads stored bytes. ``offsets`` has the byte offset of each audio frame, by which a player seeks."""
    out = Audio()
    at, size = audio_start(media, out), len(media)
    if size >= 128 and media[size - 128 : size - 125] == b"TAG":
        size, out.id3v1 = size - 128, True
    parts, first = [], True
    while at < size:
        h = header(media[at : at + 4])
        follows = at + h.length if h else 0
        if not h or follows > size or (follows < size and not header(media[follows : follows + 4])):
            found = media.find(b"\xff", at + 1, size)
            found = size if found < 0 else found
            out.skipped += found - at
            at = found
            continue
        body = at + h.body
        if h.protected and h.layer != 3:
            out.unchecked += 1
        elif h.protected and int.from_bytes(media[at + 4 : at + 6], "big") != checked(media[at + 2 : at + 4] + media[at + 6 : body]):
            out.bad_sums += 1
        if not (first and vbr_table(media[at + HEADER : follows], h.body - HEADER, out)):
            out.frames += 1
            out.samples += h.samples
            out.sample_rate = h.sample_rate
            out.offsets.append(at)
            parts.append(media[body:follows])
        first, at = False, follows
    out.payload = b"".join(parts)
    if out.declared and out.declared[0] <= len(out.payload) and zlib.crc32(memoryview(out.payload)[: out.declared[0]]) == out.declared[1]:
        out.payload = out.payload[: out.declared[0]]
    return out


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces or adds ``media`` (binary): the text's UTF-8 bytes, padded by zeros to a positive multiple of 64, as MPEG
    audio. A null text counts as empty; other columns and repeated rows stay. A text column named ``media`` is replaced."""
    kept = [c for c in docs.columns if c == text or c.lower() != "media"]
    others = [c for c in kept if c.lower() != "media"]
    rows = docs.select(*kept)

    def make(batches):
        for batch in batches:
            media = [encode(padded((t or "").encode())) for t in batch.column(kept.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(kept.index(c)) for c in others), pa.array(media, pa.binary())], names=[*others, "media"])

    return in_batches(rows, make, docs.select(*others).withColumn("media", F.lit(b"")).schema)


MEASURES = "payload binary, duration_us long, sample_rate int, frames long, bad_sums long, skipped_bytes long, table_frames long, table_bytes long, intact boolean, seek_offsets array<long>, feature string"


def measure_media(frames: DataFrame, media: str = "media") -> DataFrame:
    """Adds what the bytes of a media column hold (MEASURES), replacing columns so named: the payload, the exact duration, the sampling rate
    of the last frame, counts of frames, failed checksums and skipped bytes, the table's values (null if it has none), and each
    frame's byte offset. Null media count as empty and have no frames; no bytes fail."""
    names = [c.split()[0] for c in MEASURES.split(", ")]
    kept = [c for c in frames.columns if c.lower() not in names]
    rows, at = frames.select(*kept), kept.index(media)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(MEASURES).fields])
    kinds = (pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64()), pa.string())

    def read(batches):
        for batch in batches:
            found = []
            for m in batch.column(at).to_pylist():
                a = decode(m or b"")
                found.append((a.payload, a.duration_us, a.sample_rate, a.frames, a.bad_sums, a.skipped, a.table_frames, a.table_bytes, a.intact, a.offsets, a.feature))
            made = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True) if found else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*kept, *names])

    return in_batches(rows, read, schema)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = measure_media(to_media(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).drop("text"))
    seek = F.crc32(F.array_join("seek_offsets", ",").cast("binary"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat("feature", F.lit(";seek="), seek.cast("string")).alias("feature"),
    )
