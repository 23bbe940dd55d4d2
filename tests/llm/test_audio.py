"""Operator 7: exact round trips, resynchronisation, tables and checksums."""

import hashlib
import random
import struct
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import audio

FRAME = audio._frame(b"x" * 100)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_payload_round_trip(payload):
    data = audio.store(payload)
    got = audio.parse(data)
    assert audio.payload_of(data, got) == payload
    assert got.skipped == got.bad == 0 and got.table["frames"] == len(got.offsets)
    assert got.duration == Fraction(1152 * len(got.offsets), 48000)
    assert all(data[at] == 0xFF for at in got.offsets)


def test_long_payload_with_sync_words():
    payload = b"\xff\xfa\xff\xfb" * 200_000
    assert audio.payload_of(audio.store(payload)) == payload


TAGS = (b"APETAGEX" + struct.pack("<III", 80, 64, 0) + bytes(12), b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 1 << 31) + bytes(8), b"TAG" + b"t" * 125, b"ID3\4\0\0\0\0\0\x7f" + bytes(40), b"Xing" + struct.pack(">III", 3, 1, 99), bytes(36) + b"VBRI" + bytes(40))


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(TAGS), st.integers(0, 3), st.sampled_from(audio._ROOM), st.integers(-2, 2), st.booleans())
def test_payload_is_never_a_tag(tag, frames, room, off, repeat):
    """What looks like a tag stands at the end of any frame, of any size, or near it."""
    size = max(0, frames * audio._ROOM[-1][0] + room[0] + off - len(tag))
    payload = (b"a" * size + tag) * (1 + repeat)
    data = audio.store(payload)
    got = audio.parse(data)
    assert audio.payload_of(data, got) == payload and got.skipped == got.bad == 0 and set(got.tags) == {"payload_bytes", "payload_crc32"}


def test_text_that_ends_like_a_tag(spark):
    text = "a" * 21_664 + "APETAGEX" + struct.pack("<III", 80, 64, 0).decode() + "\0" * 12
    row = audio.media_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_bytes, row.payload_sha256) == (21_696, hashlib.sha256(text.encode()).hexdigest())


def test_resynchronises_after_junk():
    got = audio.parse(b"junk\xff\xfbmore" + FRAME * 3 + b"\xff\xff noise \xff" + FRAME * 2)
    assert len(got.offsets) == 5 and got.skipped > 0 and got.bad == 0


def test_finds_wrong_checksums():
    damaged = bytearray(FRAME * 3)
    damaged[len(FRAME) + 10] ^= 1
    got = audio.parse(bytes(damaged))
    assert (got.checked, got.bad) == (3, 1)


def test_other_versions_and_layers():
    def stream(word, n):
        h = audio.header(bytes(word))
        return h, (bytes(word) + bytes(h.size - 4)) * n

    for word, size, samples, hz in (((0xFF, 0xFB, 0x90, 0x00), 417, 1152, 44100), ((0xFF, 0xFD, 0x84, 0x00), 384, 1152, 48000), ((0xFF, 0xFF, 0x44, 0x00), 128, 384, 48000), ((0xFF, 0xF3, 0x40, 0x00), 104, 576, 22050), ((0xFF, 0xE3, 0x40, 0x00), 208, 576, 11025)):
        h, data = stream(word, 4)
        assert (h.size, h.samples, h.hz) == (size, samples, hz)
        assert audio.parse(data).duration == Fraction(4 * samples, hz)
    assert all(audio.header(bytes(w)) is None for w in ((0xFF, 0xEB, 0x90, 0), (0xFF, 0xFB, 0xF0, 0), (0xFF, 0xFB, 0x00, 0), (0xFF, 0xFB, 0x9C, 0), (0xFF, 0xF9, 0x90, 0)))


def test_tables_and_tags():
    vbri = bytearray(audio.header(b"\xff\xfb\x90\x00").size)
    vbri[:4] = b"\xff\xfb\x90\x00"
    vbri[36:40] = b"VBRI"
    vbri[46:54] = (1234).to_bytes(4, "big") + (7).to_bytes(4, "big")
    got = audio.parse(bytes(vbri) + (b"\xff\xfb\x90\x00" + bytes(413)) * 2 + b"TAG" + b"A title".ljust(125, b"\0"))
    assert got.table == {"kind": "VBRI", "bytes": 1234, "frames": 7} and got.tags["title"] == "A title" and len(got.offsets) == 2


def test_not_audio():
    for data in (b"", b"\xff", b"plain text" * 100, b"ID3\4\0\0\0\0\0\0", b"\xff" * 500):
        assert audio.parse(data).offsets == []


TEXTS = [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "é" * 1000, "word " * 40000, "a"]


def test_digests(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (None, "a")], "doc_id long, text string").withColumn("media", df_lit())
    rows = audio.media_digests(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        raw = (TEXTS[r.doc_id] if r.doc_id is not None else "a") or ""
        raw = raw.encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(audio.store(payload)).hexdigest() and "bad=0;skipped=0" in r.feature
    assert len({r.media_sha256 for r in rows}) == len(set(TEXTS)) - 1
    assert audio.media_digests(df.limit(0)).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_parsed_column(spark):
    df = spark.createDataFrame([(1, audio.store(b"y" * 2000)), (2, b"no"), (3, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in audio.parsed(df).collect()}
    assert got[1].frames == 3 and Fraction(got[1].duration_num, got[1].duration_den) == Fraction(3 * 1152, 48000) and got[1].tags["payload_bytes"] == "2000"
    assert got[2].frames == got[3].frames == 0


def plain_crc(bits: str) -> int:
    """The frame checksum, a bit at a time."""
    crc = 0xFFFF
    for bit in bits:
        top = crc >> 15 ^ int(bit)
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


def as_bits(data: bytes) -> str:
    return "".join(f"{b:08b}" for b in data)


def test_checksums_of_layers_one_and_two():
    # header bytes 1 to 3, widths of the allocations as (bits, channels that have one of their own, channels that it holds for)
    two, joint, one = (2, 1), (1, 2), (1, 1)
    low, high = [4] * 11 + [3] * 12 + [2] * 4, [4] * 11 + [3] * 12 + [2] * 7
    cases = [
        ((0xFE, 0x44, 0xC0), [(4, one)] * 32, 0),  # layer I, one channel
        ((0xFE, 0x44, 0x00), [(4, two)] * 32, 0),
        ((0xFE, 0x44, 0x50), [(4, two)] * 8 + [(4, joint)] * 24, 0),  # shared from subband 8
        ((0xFC, 0x84, 0x00), [(w, two) for w in low], 2),  # layer II, 48 kHz, 128 kbit/s
        ((0xFC, 0xA0, 0x00), [(w, two) for w in high], 2),  # 44.1 kHz, 192 kbit/s
        ((0xFC, 0x84, 0x70), [(w, two if k < 16 else joint) for k, w in enumerate(low)], 2),
        ((0xFC, 0x10, 0xC0), [(w, one) for w in [4] * 2 + [3] * 6], 2),  # 32 kbit/s
        ((0xFC, 0x18, 0xC0), [(w, one) for w in [4] * 2 + [3] * 10], 2),  # ... at 32 kHz
        ((0xF4, 0x84, 0xC0), [(w, one) for w in [4] * 4 + [3] * 7 + [2] * 19], 2),  # half rate
    ]
    rng = random.Random(5)
    for word, allocations, sharing in cases:
        head = bytes((0xFF, *word))
        h = audio.header(head)
        frames = b""
        for _ in range(4):
            bits, used = "", 0
            for width, (own, holds) in allocations:
                for _ in range(own):
                    value = rng.choice((0, rng.randrange(1 << width)))
                    bits += f"{value:0{width}b}"
                    used += holds * (value > 0)
            bits += "".join(rng.choice("01") for _ in range(sharing * used))
            crc = plain_crc(as_bits(head[2:]) + bits)
            body = as_bits(crc.to_bytes(2, "big")) + bits
            body = int(body.ljust(-(-len(body) // 8) * 8, "1"), 2).to_bytes(-(-len(body) // 8), "big")
            assert len(head + body) <= h.size
            frames += (head + body).ljust(h.size, b"\x55")
        got = audio.parse(frames)
        assert (len(got.offsets), got.checked, got.bad) == (4, 4, 0), word
        damaged = bytearray(frames)
        damaged[h.size + 6] ^= 0x10
        assert audio.parse(bytes(damaged)).bad == 1, word


def test_delay_padding_and_seek_points():
    size = audio.header(b"\xff\xfb\x90\x00").size
    frame = b"\xff\xfb\x90\x00" + bytes(size - 4)
    xing = (b"\xff\xfb\x90\x00" + bytes(32) + b"Xing" + struct.pack(">II", 1, 3) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")).ljust(size, b"\0")
    got = audio.parse(xing + frame * 3)
    assert (got.table["delay"], got.table["padding"]) == (576, 1000) and got.duration == Fraction(3 * 1152 - 1576, 44100)
    vbri = (b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + struct.pack(">3HII4H3H", 1, 0, 0, 4 * size, 3, 3, 2, 2, 1, 5, 6, 7)).ljust(size, b"\0")
    assert audio.parse(vbri + frame * 3).table["seek"] == [10, 22, 36]


def synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def test_tags_of_all_versions():
    frames = FRAME * 2

    def tagged(version, body, flags=0, behind=b""):
        return audio.parse(b"ID3" + bytes((version, 0, flags)) + synchsafe(len(body)) + body + behind + frames)

    def v4(name, body, flags=0):
        return name + synchsafe(len(body)) + bytes((0, flags)) + body

    def v3(name, body, flags=0):
        return name + struct.pack(">I", len(body)) + bytes((0, flags)) + body

    utf16 = b"\1" + "Zoë".encode("utf-16")
    got = tagged(3, v3(b"TPE1", utf16) + v3(b"TIT2", b"\0" + b"T\xeftle") + bytes(20))
    assert got.tags == {"TPE1": "Zoë", "TIT2": "Tïtle"} and len(got.offsets) == 2 and got.skipped == 0
    got = tagged(4, v4(b"TALB", b"\3" + "Ünder\0two".encode()) + v4(b"TXXX", b"\2" + "ключ\0знач".encode("utf-16-be")) + v4(b"APIC", b"\0\0\0"))
    assert got.tags == {"TALB": "Ünder\0two", "ключ": "знач"}
    assert tagged(2, b"TT2" + (6).to_bytes(3, "big") + b"\0short").tags == {"TT2": "short"}
    # unsynchronised as a whole, and a frame; extended headers; a footer; compressed, grouped and encrypted frames; broken lengths
    assert tagged(3, v3(b"TIT2", b"\0\xff\xe0x").replace(b"\xff", b"\xff\0"), 0x80).tags == {"TIT2": "ÿàx"}
    assert tagged(4, v4(b"TIT2", b"\0\xff\0\xe0x", 2)).tags == {"TIT2": "ÿàx"}
    assert tagged(3, struct.pack(">I", 6) + bytes(6) + v3(b"TIT2", b"\0x"), 0x40).tags == {"TIT2": "x"}
    got = tagged(4, synchsafe(6) + b"\1\0" + v4(b"TIT2", b"\0x"), 0x50, b"3DI" + bytes(7))
    assert got.tags == {"TIT2": "x"} and got.skipped == 0
    packed = zlib.compress(b"\0packed")
    assert tagged(3, v3(b"TIT2", struct.pack(">I", 7) + packed, 0x80)).tags == {"TIT2": "packed"}
    assert tagged(4, v4(b"TIT2", b"g" + synchsafe(7) + packed, 0x49) + v4(b"TPE1", b"\0hidden", 4)).tags == {"TIT2": "packed"}
    assert tagged(3, v3(b"TIT2", b"\0abcnot packed", 0x80) + v3(b"TPE1", b"")).tags == {}
    assert len(tagged(3, b"TIT2" + b"\x7f\xff\xff\xff\0\0\0x").offsets) == 2

    item = struct.pack("<II", 5, 0) + b"Artist\0" + b"Bj\xc3\xb6r"
    foot = lambda flags: b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, flags) + bytes(8)
    one = b"TAG" + b"A".ljust(30, b"\0") + b"B".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\7\0"
    got = audio.parse(frames + foot(1 << 31 | 1 << 29) + item + foot(1 << 31) + one)
    assert got.tags == {"Artist": "Björ", "title": "A", "artist": "B", "year": "1999", "comment": "note", "track": "7"}
    assert len(got.offsets) == 2 and got.skipped == 0


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([2, 3, 4]), st.integers(0, 255), st.binary(max_size=60))
def test_any_tag_bytes_are_survived(version, flags, body):
    assert audio.parse(b"ID3" + bytes((version, 0, flags)) + synchsafe(len(body)) + body + FRAME * 3) is not None
    assert audio.parse(FRAME + b"APETAGEX" + body) is not None
