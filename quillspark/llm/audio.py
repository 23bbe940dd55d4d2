"""Operator 7, media columns: MPEG audio.

``parse`` reads any MPEG-1/2/2.5 layer I-III stream: it reads ID3v2.2 to 2.4, ID3v1 and APE tags, finds frame headers again after
damage (a header counts where the last frame ended, or if another one, or the end, stands where it says that its frame ends), reads
Xing/Info and VBRI tables with their seek points, verifies the frame checksums of all three layers, and gives the exact duration and
the offset of every frame. Of the duration, the encoder's delay and padding are taken off where the table names them. ``store`` writes a
payload as such a stream, losslessly: layer III frames of silence whose unused main data holds the payload, each of the smallest bit
rate that has room, with header checksums, a tag with the payload's length and checksum, and a Xing table in the first frame.

Tags keep texts only: text frames by their id (of user-defined ones by their name), ID3v1 fields, and text items of APE tags by their
key; encrypted frames are left out, and so is a frame whose compressed or encoded text is damaged.

Nulls and edge cases: a null or empty payload text still gives one block of blanks; ids may be null or repeated, each row stands
for itself and equal texts give equal values; texts are stored whole at any length; bytes that are no MPEG audio parse to zero
frames. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

# Fixed values of the MPEG audio formats: kbit/s by (version 1 or 2, layer), index 1 to 14; sampling rates in Hz; samples a frame.
BIT_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
# Fixed values too: bits of the allocation of each layer II subband, by table; encoders whose delay and padding follow a Xing table.
ALLOCATIONS = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "half rate": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
ENCODERS = (b"LAME", b"Lavc", b"Lavf")


class Header(NamedTuple):
    version: int
    layer: int
    protected: bool
    kbps: int
    hz: int
    size: int
    samples: int
    side: int  # bytes of layer III side information


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames have no size of their own and don't count."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    id_bits, layer_bits, rate, hz_bits = word[1] >> 3 & 3, word[1] >> 1 & 3, word[2] >> 4, word[2] >> 2 & 3
    if id_bits == 1 or layer_bits == 0 or rate in (0, 15) or hz_bits == 3 or word[3] & 3 == 2:
        return None
    version, layer, padding = 1 if id_bits == 3 else 2, 4 - layer_bits, word[2] >> 1 & 1
    kbps, hz = BIT_RATES[version, layer][rate - 1], SAMPLE_RATES[id_bits][hz_bits]
    samples = SAMPLES[version, layer]
    size = (12 * kbps * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + padding
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else ((17 if mono else 32) if version == 1 else (9 if mono else 17))
    return Header(version, layer, not word[1] & 1, kbps, hz, size, samples, side)


def _shifted(crc: int, bits: int) -> int:
    for _ in range(bits):
        crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


_CRC = tuple(_shifted(byte << 8, 8) for byte in range(256))


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The frame checksum of the first ``bits`` (default: all): polynomial x^16 + x^15 + x^2 + 1, start of ones."""
    crc = 0xFFFF
    whole, rest = divmod(8 * len(data) if bits is None else bits, 8)
    for byte in data[:whole]:
        crc = (crc << 8 ^ _CRC[crc >> 8 ^ byte]) & 0xFFFF
    return _shifted(crc ^ (data[whole] >> 8 - rest << 16 - rest), rest) if rest else crc


def _allocation(h: Header, mono: bool) -> tuple[int, ...]:
    """The layer II table that holds for a bit rate and sampling rate."""
    each = h.kbps if mono else h.kbps // 2
    if h.version == 2:
        return ALLOCATIONS["half rate"]
    if 56 <= each and (h.hz == 48000 or each <= 80):
        return ALLOCATIONS["a"]
    if each > 80:
        return ALLOCATIONS["b"]
    return ALLOCATIONS["d" if h.hz == 32000 else "c"]


def protected_bits(frame: bytes, h: Header) -> int:
    """Bits behind the checksum that it covers: side information; allocations; or allocations and how scale factors are shared."""
    if h.layer == 3:
        return 8 * h.side
    mode = frame[3] >> 6
    channels = 1 if mode == 3 else 2
    shared = 4 * (1 + (frame[3] >> 4 & 3)) if mode == 1 else 32  # subbands from here on have one allocation for both channels
    if h.layer == 1:
        return 4 * (32 if channels == 1 else 32 + min(shared, 32))
    widths = [(w, 1 if channels == 1 or k >= shared else 2) for k, w in enumerate(_allocation(h, channels == 1))]
    total = sum(w * n for w, n in widths)
    left = 8 * 32
    value = int.from_bytes(frame[6 : 6 + left // 8].ljust(left // 8, b"\0"), "big")
    used = 0
    for width, n in widths:
        for _ in range(n):
            left -= width
            if value >> left & ((1 << width) - 1):
                used += channels if n == 1 else 1
    return total + 2 * used


class Audio(NamedTuple):
    offsets: list[int]  # of audio frames; the frame with the table isn't one
    sizes: list[int]
    duration: Fraction  # seconds, without the delay and padding that the table names
    checked: int  # frames with a checksum that was verified
    bad: int  # ... and was wrong
    skipped: int  # bytes between frames
    table: dict  # frames, bytes, toc, seek, delay, padding and kind, as far as the variable-bit-rate table has them
    tags: dict[str, str]
    headers: list[Header]


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(body: bytes) -> list[str]:
    """The strings of a text frame, whose first byte names their encoding."""
    encoding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else -1)
    if encoding is None:
        return []
    if encoding == "utf-16" and body[1:3] not in (b"\xff\xfe", b"\xfe\xff"):
        encoding = "utf-16-le"
    end = 2 if "16" in encoding else 1
    body = body[1:]
    if end == 2:
        body = body[: len(body) // 2 * 2]
    return [x.removeprefix("\ufeff") for x in body.decode(encoding, "replace").rstrip("\0").split("\0")]


def _plain(body: bytes, version: int, flags: int, unsynchronised: bool) -> bytes | None:
    """A frame's content without what its flags add; None if it can't be read."""
    group, squeezed, encrypted, counted = ((0x40, 0x08, 0x04, 0x01) if version >= 4 else (0x20, 0x80, 0x40, 0x80)) if version >= 3 else (0,) * 4
    if flags & encrypted:
        return None
    if version >= 4:
        body = body[bool(flags & group) + 4 * bool(flags & counted) :]
        if unsynchronised or flags & 0x02:
            body = body.replace(b"\xff\0", b"\xff")
    else:
        body = body[4 * bool(flags & counted) + bool(flags & group) :]
    try:
        return zlib.decompress(body) if flags & squeezed else body
    except zlib.error:
        return None


def _id3v2(data: bytes, tags: dict[str, str], start: int = 0) -> int:
    """Where the tag at ``start`` ends; its texts go to ``tags``, the first of each name."""
    head = data[start : start + 10]
    if head[:3] != b"ID3" or len(head) < 10 or max(head[6:10]) > 127:
        return start
    version, flags = head[3], head[5]
    end = min(len(data), start + 10 + _synchsafe(head[6:10]))
    tag = data[start + 10 : end]
    if flags & 0x80 and version < 4:
        tag = tag.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and version >= 3 and len(tag) >= 4:
        at = max(6, _synchsafe(tag[:4])) if version >= 4 else 4 + struct.unpack(">I", tag[:4])[0]
    id_len, head_len = (3, 6) if version < 3 else (4, 10)
    while at + head_len <= len(tag) and tag[at : at + id_len].strip(b"\0"):
        name, size = tag[at : at + id_len], tag[at + id_len : at + 2 * id_len]
        size = _synchsafe(size) if version >= 4 else int.from_bytes(size, "big")
        body = tag[at + head_len : at + head_len + size]
        at += head_len + size
        if name[:1] == b"T" and (body := _plain(body, version, 0 if version < 3 else tag[at - size - 1], bool(flags & 0x80))):
            parts = _text(body)
            if name in (b"TXXX", b"TXX") and len(parts) > 1:
                tags.setdefault(parts[0], "\0".join(parts[1:]))
            elif name not in (b"TXXX", b"TXX") and parts:
                tags.setdefault(name.decode("latin-1"), "\0".join(parts))
    return min(len(data), end + 10 * bool(flags & 0x10 and version >= 4))


def _id3v1(tag: bytes, tags: dict[str, str]) -> None:
    for name, start, end in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
        if value := tag[start:end].split(b"\0")[0].rstrip(b" "):
            tags.setdefault(name, value.decode("latin-1"))
    if tag[125] == 0 and tag[126]:
        tags.setdefault("track", str(tag[126]))


def _ape(data: bytes, end: int, tags: dict[str, str], least: int) -> int:
    """Where the APE tag that ends at ``end`` begins; ``end`` if there is none that begins at ``least`` or later."""
    foot = data[end - 32 : end] if end >= 32 else b""
    if foot[:8] != b"APETAGEX":
        return end
    size, items, flags = struct.unpack("<III", foot[12:24])
    start = end - size
    if size < 32 or start < least:
        return end
    at = start
    for _ in range(items):
        if at + 8 > end - 32:
            break
        n, kind = struct.unpack("<II", data[at : at + 8])
        stop = data.find(b"\0", at + 8, end - 32)
        if stop < 0 or stop + 1 + n > end - 32:
            break
        if kind >> 1 & 3 == 0:
            tags.setdefault(data[at + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + n].decode("utf-8", "replace"))
        at = stop + 1 + n
    return start - 32 if flags >> 31 and start - 32 >= least and data[start - 32 : start][:8] == b"APETAGEX" else start


def _table(frame: bytes, h: Header) -> dict:
    at = 4 + 2 * h.protected + h.side
    kind = frame[at : at + 4]
    if h.layer == 3 and kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        (flags,) = struct.unpack(">I", frame[at + 4 : at + 8])
        found, at = {"kind": kind.decode()}, at + 8
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and at + n <= len(frame):
                found[name] = frame[at : at + n] if n == 100 else struct.unpack(">I", frame[at : at + n])[0]
                at += n
        if frame[at : at + 4] in ENCODERS and at + 24 <= len(frame):
            both = int.from_bytes(frame[at + 21 : at + 24], "big")
            found |= {"encoder": frame[at : at + 9].rstrip(b"\0 ").decode("latin-1"), "delay": both >> 12, "padding": both & 0xFFF}
        return found
    if h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 54:
        size, frames = struct.unpack(">II", frame[46:54])
        found = {"kind": "VBRI", "bytes": size, "frames": frames}
        if len(frame) >= 62:
            entries, scale, width, each = struct.unpack(">4H", frame[54:62])
            if entries and 1 <= width <= 4 and 62 + entries * width <= len(frame):
                steps = [int.from_bytes(frame[i : i + width], "big") * scale for i in range(62, 62 + entries * width, width)]
                found |= {"seek": list(accumulate(steps)), "frames_per_entry": each}
        return found
    return {}


def _stated_end(data: bytes, at: int, end: int) -> int:
    """Where the audio ends by the count of bytes in the table of its first frame, or ``at``. What lies before is no tag, whatever it looks like."""
    h = header(data[at : at + 4])
    size = _table(data[at : at + h.size], h).get("bytes", 0) if h and at + h.size <= end else 0
    return at + size if at + size <= end else at


def parse(data: bytes) -> Audio:
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    while (after := _id3v2(data, tags, at)) > at:
        at = after
    stated = _stated_end(data, at, end)
    if data[-128:-125] == b"TAG" and end - stated >= 128:
        end -= 128
        _id3v1(data[end:], tags)
    end = max(at, _ape(data, end, tags, stated))
    offsets, sizes, headers = [], [], []
    samples: dict[int, int] = {}
    checked = bad = skipped = 0
    table: dict = {}
    expected = -1  # where the last frame ended
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        chained = after + 4 > end or header(data[after : after + 4]) or at == expected
        if not h or after > end or h.size < 4 + 2 * h.protected + h.side or not chained:
            sync = data.find(b"\xff", at + 1, end)
            skipped += (sync if sync >= 0 else end) - at
            at = sync if sync >= 0 else end
            continue
        if h.protected:
            bits = 8 * h.side if h.layer == 3 else protected_bits(data[at : at + 40], h)
            checked += 1
            bad += crc16(data[at + 2 : at + 4] + data[at + 6 : min(after, at + 6 + -(-bits // 8))], min(16 + bits, 8 * (h.size - 4))) != int.from_bytes(data[at + 4 : at + 6], "big")
        found = _table(data[at:after], h) if not headers and not table else {}
        if found:
            table = found
        else:
            offsets.append(at)
            sizes.append(h.size)
            headers.append(h)
            samples[h.hz] = samples.get(h.hz, 0) + h.samples
        at = expected = after
    skipped += max(0, end - at)
    duration = sum((Fraction(n, hz) for hz, n in samples.items()), Fraction(0))
    if headers:
        duration = max(Fraction(0), duration - Fraction(table.get("delay", 0) + table.get("padding", 0), headers[0].hz))
    return Audio(offsets, sizes, duration, checked, bad, skipped, table, tags, headers)


# What ``store`` writes: MPEG-1 layer III, 48 kHz, one channel, with checksum. A frame has 3 bytes for each kbit/s.
_HZ_BITS, _SIDE = 1, 17
_ROOM = tuple((144 * k * 1000 // 48000 - 4 - 2 - _SIDE, i + 1) for i, k in enumerate(BIT_RATES[1, 3]))


@lru_cache(64)
def _start(index: int) -> bytes:
    """Header, checksum and empty side information of a frame."""
    word = bytes((0xFF, 0xFA, index << 4 | _HZ_BITS << 2, 0xC0))
    return word + crc16(word[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


def _frame(part: bytes) -> bytes:
    room, index = next(x for x in _ROOM if x[0] >= len(part))
    return _start(index) + part + bytes(room - len(part))


def store(payload: bytes) -> bytes:
    """An MPEG audio stream that holds ``payload``."""
    most = _ROOM[-1][0]
    frames = [_frame(payload[i : i + most]) for i in range(0, len(payload), most)]
    size = sum(map(len, frames))
    toc, at, ends = bytearray(), 0, []
    for f in frames:
        ends.append(at)
        at += len(f)
    for percent in range(100):
        toc.append(ends[percent * len(frames) // 100] * 255 // size if frames else 0)
    table_room = _ROOM[7]  # the first frame; 120 bytes are needed
    table = b"Xing" + struct.pack(">III", 7, len(frames), size + table_room[0] + 4 + 2 + _SIDE) + bytes(toc)
    first = _start(table_room[1]) + table + bytes(table_room[0] - len(table))
    body = b"".join(b"TXXX" + bytes((0, 0, n >> 7, n & 127)) + b"\0\0" + text for text, n in ((b"\0" + k + b"\0" + v, len(k) + len(v) + 2) for k, v in ((b"payload_bytes", b"%d" % len(payload)), (b"payload_crc32", b"%d" % zlib.crc32(payload)))))
    tag = b"ID3\4\0\0" + bytes((len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127)) + body
    return tag + first + b"".join(frames) + b"TAG" + bytes(125)


def payload_of(data: bytes, audio: Audio | None = None) -> bytes:
    """What ``store`` was given. A wrong length or checksum is an error."""
    audio = audio or parse(data)
    out = b"".join(data[at + 6 + _SIDE : at + n] for at, n in zip(audio.offsets, audio.sizes, strict=True))
    out = out[: int(audio.tags["payload_bytes"])]
    if len(out) != int(audio.tags["payload_bytes"]) or zlib.crc32(out) != int(audio.tags["payload_crc32"]) or audio.bad:
        raise ValueError("the stored payload is damaged")
    return out


def feature(audio: Audio) -> str:
    """Frames, exact duration in seconds as a fraction, checksums, bit rates, the table's count, and a digest of the frame offsets."""
    rates = sorted({h.kbps for h in audio.headers})
    offsets = zlib.crc32(struct.pack(f"<{len(audio.offsets)}Q", *audio.offsets))
    return f"frames={len(audio.offsets)};seconds={audio.duration};checked={audio.checked};bad={audio.bad};skipped={audio.skipped};kbps={'/'.join(map(str, rates))};table={audio.table.get('frames', 0)};offsets={offsets}"


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 192) -> DataFrame:
    """A row a document: doc_id, n_bytes, media (the stream that holds the UTF-8 text, with blanks up to a multiple of ``block``)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.slice(i, 256)
                texts = [t or b"" for t in some.column(1).to_pylist()]
                media = [store(t + b" " * (-len(t) % block or (0 if t else block))) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(build, f"doc_id {kind}, n_bytes long, media binary")


def parsed(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Any MPEG audio column: ``keep``, frames, exact duration (numerator and denominator), bad checksums, frame offsets and tags."""
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.slice(i, 256)
                got = [parse(m or b"") for m in some.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(keep)], pa.array([len(a.offsets) for a in got], pa.int64()), pa.array([a.duration.numerator for a in got], pa.int64()), pa.array([a.duration.denominator for a in got], pa.int64()), pa.array([a.bad for a in got], pa.int64()), pa.array([a.offsets for a in got], pa.list_(pa.int64())), pa.array([list(a.tags.items()) for a in got], pa.map_(pa.string(), pa.string()))],
                    [*keep, "frames", "duration_num", "duration_den", "bad_checksums", "frame_offsets", "tags"],
                )

    return media.select(*keep, media_col).mapInArrow(read, f"{kinds}, frames long, duration_num long, duration_den long, bad_checksums long, frame_offsets array<long>, tags map<string,string>")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the media column, reads it back and computes each row's digests and feature from the stored bytes."""
    ws = Workspace(docs.sparkSession, "audio")
    stored = ws.save(media_table(docs, id_col, text_col), "media")
    kind = stored.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for i in range(0, len(batch), 256):
                some, rows = batch.slice(i, 256), []
                for media in some.column(2).to_pylist():
                    audio = parse(media)
                    payload = payload_of(media, audio)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
