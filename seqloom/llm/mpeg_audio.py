"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

``parse`` reads any sequence of bytes: it skips an ID3v2 tag and finds frame headers of MPEG 1, 2 and 2.5 (layers I to
III, free bitrates too).  A frame that continues the stream, right behind a frame of the same format, is taken as it is.
Any other one (the first, one behind damage, one of another format) has to be confirmed: by a header of its
own format right behind it, by the end of the data, or by its own checksum.  So a stream may change its format, and what
comes before or between is skipped.  Variable-bitrate tables (Xing, Info or VBRI) are read where a format begins and are no
sound; checksums are verified; samples are counted per sample rate, so that durations are exact; and the offset of
every frame is kept to seek to.

``build`` stores a payload without loss as a layer III stream: one frame of 224 kbit/s at 48 kHz (672 bytes) for every
576 payload bytes, which are the frame's main data (two granules of 288 bytes); the first frame holds the table, an
ID3v2 tag the number of bytes without padding, and every frame is protected by its checksum.  Such a stream is valid
as a container; what it would sound like has no meaning.

Defined results for odd input: a null text counts as empty and gives one unit of padding; equal texts give equal bytes;
bytes without any frame parse to zero frames and no duration; cut or damaged frames are left out and counted in
``skipped`` bytes; equal and null ids stay separate rows; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.batches import map_texts
from seqloom.plans.durable import materialise

UNIT = 576
PAD = b"\xff"

#: Bitrates in kbit/s by (MPEG 1?, layer), sample rates of MPEG 1, and samples of a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
#: A part of a second that every sample rate divides.
TICKS = 14_112_000
#: The longest frame of a free bitrate that is looked for, in bytes.
FREE_MOST = 8192


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    bound: int
    #: Bytes of the frame; of a free bitrate (0) only those of its padding.
    size: int
    samples: int

    @property
    def form(self) -> tuple[str, int, int, bool]:
        """What frames of one stream have in common: version, layer, sample rate, and whether the bitrate is free."""
        return self.version, self.layer, self.rate, self.bitrate == 0

    @property
    def side_bytes(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, None if they are none."""
    if four not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[four] = _read_header(four)
    return _HEADERS[four]


def _read_header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate == 15 or rate == 3 or four[3] & 3 == 2:
        return None
    first = version == 3
    kbit = BITRATES[first, layer][bitrate]
    hertz = RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    padded = four[2] >> 1 & 1
    samples = SAMPLES[first, layer]
    size = (12000 * kbit // hertz + padded) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hertz + padded
    mode = four[3] >> 6
    bound = 4 * ((four[3] >> 4 & 3) + 1) if mode == 1 else 32
    return Header(VERSIONS[version], layer, not four[1] & 1, kbit, hertz, mode == 3, bound, size, samples)


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes | tuple[bytes, int]) -> int:
    """The checksum of MPEG audio frames: polynomial 8005 hex, begun with all ones; over whole bytes, or (bytes, number of bits)."""
    data, bits = data if isinstance(data, tuple) else (data, len(data) * 8)
    c = 0xFFFF
    for b in data[: bits // 8]:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    for i in range(bits // 8 * 8, bits):
        c = (c << 1 ^ (0x8005 if (c >> 15 ^ data[i // 8] >> 7 - i % 8) & 1 else 0)) & 0xFFFF
    return c


#: Layer II: bits of the allocation of each subband, for the five tables of the standards.
ALLOCATION_BITS = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def allocation_table(h: Header) -> tuple[int, ...]:
    """A layer II frame's table, by version, sample rate and bitrate of a channel."""
    if h.version != "1":
        return ALLOCATION_BITS["low"]
    each = h.bitrate // (1 if h.mono else 2)
    if each >= 56 and (h.rate == 48000 or each <= 80):
        return ALLOCATION_BITS["a"]
    if each >= 96:
        return ALLOCATION_BITS["b"]
    return ALLOCATION_BITS["d" if h.rate == 32000 else "c"]


def _covered_2(h: Header, frame: bytes) -> tuple[bytes, int]:
    """Layer II: two bytes of header, the allocations, and two bits of scale factor selection for each that isn't 0."""
    table, channels = allocation_table(h), 1 if h.mono else 2
    rest = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big")
    at = chosen = 0
    for k, bits in enumerate(table):
        shared = channels == 2 and k >= h.bound
        for _ in range(1 if shared else channels):
            at += bits
            if rest >> 512 - at & (1 << bits) - 1:
                chosen += 2 if shared else 1
    return frame[2:4] + frame[6:70], 16 + at + 2 * chosen


def covered(h: Header, frame: bytes) -> bytes | tuple[bytes, int] | None:
    """What a frame's checksum covers, for ``crc16``; None where a layer II frame is too short for it."""
    if h.layer == 3:
        return frame[2:4] + frame[6 : 6 + h.side_bytes]
    if h.layer == 1:
        return frame[2:4] + frame[6 : 6 + (16 if h.mono else (2 * h.bound + 32 - h.bound) // 2)]
    data, bits = _covered_2(h, frame)
    # no more than is covered, so that equal parts are equal
    return (data[: -(-bits // 8)], bits) if bits <= 8 * len(data) else None


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _to_syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def read_id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """(text frames, bytes of the tag) of an ID3v2.3 or 2.4 tag at the start."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b > 127 for b in data[6:10]):
        return {}, 0
    size = 10 + _syncsafe(data[6:10]) + (10 if data[5] & 0x10 else 0)
    tags, at, end = {}, 10, min(len(data), 10 + _syncsafe(data[6:10]))
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("latin-1")
        n = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\x00")
            if name == "TXXX":
                key, _, text = text.partition("\x00")
                name = f"TXXX:{key}"
            tags[name] = text
        at += 10 + n
    return tags, min(size, len(data))


def read_id3v1(data: bytes) -> dict[str, str]:
    """Title, artist, album and year of an ID3v1 tag at the end."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}
    tail = data[-128:]
    parts = {"title": tail[3:33], "artist": tail[33:63], "album": tail[63:93], "year": tail[93:97]}
    return {k: v.split(b"\x00")[0].decode("latin-1").rstrip() for k, v in parts.items()}


def read_vbr(h: Header, frame: bytes) -> dict[str, object] | None:
    """The variable-bitrate table (Xing, Info or VBRI) in a first frame."""
    if h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 62:
        version, delay, quality, size, frames, entries, scale, width, step = struct.unpack(">HHHIIHHHH", frame[40:62])
        parts = [frame[62 + k * width : 62 + (k + 1) * width] for k in range(entries)]
        toc = [int.from_bytes(part, "big") * scale for part in parts if width and len(part) == width]
        return {"kind": "VBRI", "version": version, "delay": delay, "quality": quality, "bytes": size, "frames": frames, "frames_per_entry": step, "sizes": toc}
    at = 4 + (2 if h.protected else 0) + h.side_bytes
    kind = frame[at : at + 4]
    if h.layer != 3 or kind not in (b"Xing", b"Info"):
        return None
    flags = int.from_bytes(frame[at + 4 : at + 8], "big")
    out: dict[str, object] = {"kind": kind.decode()}
    at += 8
    for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
        if flags & bit:
            part = frame[at : at + n]
            out[name] = part if name == "toc" else int.from_bytes(part, "big")
            at += n
    return out


@dataclass
class Stream:
    """What ``parse`` finds; offsets are of sound frames, the table's frame not among them."""

    offsets: np.ndarray
    headers: list[Header] = field(default_factory=list)
    #: Samples by sample rate, in order of appearance.
    rates: dict[int, int] = field(default_factory=dict)
    variable: bool = False
    skipped: int = 0
    checksums_good: int = 0
    checksums_bad: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    old_tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] | None = None

    @property
    def samples(self) -> int:
        return sum(self.rates.values())

    @property
    def rate(self) -> int:
        """Sample rate of the first frame, 0 without one."""
        return next(iter(self.rates), 0)

    @property
    def duration_us(self) -> int | None:
        """Exact duration in microseconds, rounded down; None without a frame."""
        return sum(n * (TICKS // r) for r, n in self.rates.items()) * 1_000_000 // TICKS if self.rates else None

    def seek(self, sample: int) -> int | None:
        """Byte offset of the frame that holds a sample."""
        return self._offset([h.samples for h in self.headers], sample)

    def seek_us(self, microseconds: int) -> int | None:
        """Byte offset of the frame that sounds at a time."""
        return self._offset([h.samples * (TICKS // h.rate) for h in self.headers], microseconds * TICKS // 1_000_000)

    def _offset(self, lengths: list[int], at: int) -> int | None:
        ends = np.cumsum(lengths)
        k = int(np.searchsorted(ends, at, side="right"))
        return int(self.offsets[k]) if 0 <= at and k < len(ends) else None


def _free_size(data: bytes, at: int, h: Header, end: int) -> int | None:
    """Bytes of a free-bitrate frame without padding: up to the next header of its form that a third one, or the end, confirms."""
    p = data.find(b"\xff", at + 24, min(end, at + FREE_MOST))
    while p >= 0:
        g = header(data[p : p + 4])
        if g is not None and g.form == h.form:
            size = p - at - h.size
            after = p + size + g.size
            third = header(data[after : after + 4])
            if after == end or (third is not None and third.form == h.form):
                return size
        p = data.find(b"\xff", p + 1, min(end, at + FREE_MOST))
    return None


def _sound_checksum(h: Header, frame: bytes, checked: dict[bytes | tuple[bytes, int], int]) -> bool | None:
    """Whether a frame's checksum holds; None if it has none that can be read."""
    if not h.protected or (part := covered(h, frame)) is None:
        return None
    if part not in checked:
        checked[part] = crc16(part)
    return checked[part] == int.from_bytes(frame[4:6], "big")


def parse(data: bytes) -> Stream:
    """Read a stream; see the module's text."""
    tags, at = read_id3v2(data)
    old = read_id3v1(data)
    end = len(data) - (128 if old else 0)
    out = Stream(np.zeros(0, np.int64), tags=tags, old_tags=old)
    offsets: list[int] = []
    checked: dict[bytes | tuple[bytes, int], int] = {}
    form, free, synced = None, None, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        goes_on = h is not None and synced and h.form == form
        if h is not None:
            base = 0
            if h.bitrate == 0:
                base = free if goes_on else _free_size(data, at, h, end)
            size = 0 if base is None else base + h.size
            if size < 8 or at + size > end:
                h = None
        if h is not None:
            frame = data[at : at + size]
            sound = _sound_checksum(h, frame, checked)
            if not goes_on and not sound and at + size != end:
                follow = header(data[at + size : at + size + 4])
                if follow is None or follow.form != h.form:
                    h = None
        if h is None:
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        out.checksums_good += sound is True
        out.checksums_bad += sound is False
        table = read_vbr(h, frame) if h.form != form else None
        form, free, synced = h.form, base, True
        if table is not None:
            out.vbr = out.vbr or table
        else:
            offsets.append(at)
            out.headers.append(h)
            out.rates[h.rate] = out.rates.get(h.rate, 0) + h.samples
        at += size
    out.skipped += max(0, end - at)
    out.offsets = np.array(offsets, np.int64)
    out.variable = len({h.bitrate for h in out.headers}) > 1
    return out


# ---- payloads

#: Header of the frames that are built: MPEG 1, layer III, checksum, 224 kbit/s, 48 kHz, mono.
HEAD = b"\xff\xfa\xc4\xc0"


def _side(granule_bits: int) -> bytes:
    """Side information of a mono frame: no bit reservoir, two granules of ``granule_bits`` bits, nothing else set."""
    bits = "0" * 18 + 2 * (f"{granule_bits:012b}" + "0" * 47)
    return int(bits, 2).to_bytes(17, "big")


def _frame(granule_bits: int) -> bytes:
    """Header, checksum and side information."""
    side = _side(granule_bits)
    return HEAD + crc16(HEAD[2:] + side).to_bytes(2, "big") + side


_H = _read_header(HEAD)
FRAME = _H.size
SOUND, SILENT = _frame(UNIT * 4), _frame(0)
BODY = len(SOUND)


def build(content: bytes) -> bytes:
    """A stream whose frames hold ``content``, padded with PAD to a positive multiple of UNIT."""
    payload = content.ljust(max(1, -(-len(content) // UNIT)) * UNIT, PAD)
    frames = len(payload) // UNIT
    text = b"\x03payload_bytes\x00" + str(len(content)).encode()
    entry = b"TXXX" + _to_syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _to_syncsafe(len(entry)) + entry
    toc = bytes(min(255, (k * frames // 100 + 1) * 256 // (frames + 1)) for k in range(100))
    table = b"Info" + struct.pack(">III", 15, frames, (frames + 1) * FRAME) + toc + struct.pack(">I", 0)
    body = np.zeros((frames, FRAME), np.uint8)
    body[:, :BODY] = np.frombuffer(SOUND, np.uint8)
    body[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(frames, UNIT)
    # an empty ID3v1 tag ends the stream, so that no payload can be taken for one
    return tag + (SILENT + table).ljust(FRAME, b"\x00") + body.tobytes() + b"TAG".ljust(128, b"\x00")


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream that ``build`` made."""
    return b"".join([data[o + BODY : o + BODY + UNIT] for o in stream.offsets.tolist()])


def content_size(stream: Stream) -> int | None:
    text = stream.tags.get("TXXX:payload_bytes", "")
    return int(text) if re.fullmatch("[0-9]+", text) else None


def encode_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text's UTF-8 as a stream."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array([build((t or "").encode()) for t in piece.column(1).to_pylist()], pa.binary())], names=[id_col, "media"])

    return map_texts(docs, [id_col, text_col], apply, f"`{id_col}` {kind}, media binary")


def read_audio(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, media, payload, n_bytes, n_frames, duration_us, sample_rate, seek_offsets, checksums_good, checksums_bad, skipped,
    feature) of each stream; payload and n_bytes only mean something for streams that ``encode_audio`` made."""
    kind = media.schema[id_col].dataType.simpleString()

    def apply(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in piece.column(1).to_pylist():
            s = parse(data or b"")
            feature = f"mpeg;frames={len(s.offsets)};us={s.duration_us};rate={s.rate};vbr={int(s.variable)};table={(s.vbr or {}).get('frames')};crc={s.checksums_good}/{s.checksums_bad};skipped={s.skipped}"
            rows.append((payload_of(data or b"", s), content_size(s), len(s.offsets), s.duration_us, s.rate, s.offsets.tolist(), s.checksums_good, s.checksums_bad, s.skipped, feature))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        names = ["payload", "n_bytes", "n_frames", "duration_us", "sample_rate", "seek_offsets", "checksums_good", "checksums_bad", "skipped", "feature"]
        return pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], names=[id_col, "media", *names])

    longs = "n_bytes long, n_frames long, duration_us long, sample_rate long, seek_offsets array<long>, checksums_good long, checksums_bad long, skipped long"
    return map_texts(media, [id_col, media_col], apply, f"`{id_col}` {kind}, media binary, payload binary, {longs}, feature string")


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(encode_audio(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mpeg-media", codec="zstd")
    return read_audio(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_frames",
        "duration_us",
        "seek_offsets",
    )
