"""Operator 3: bundles as any reader of the formats sees them, and the whole operator against a plain rule."""

import hashlib

import pytest
import zstandard

from quillspark.llm import warc


def test_bundle_reads_by_frame_and_as_one_stream():
    b = warc.Bundle(frame_bytes=1000)
    payloads = {f"<urn:page:{i}>": (b"<html>%d" % i) * (i * 7) for i in range(60)}
    places = {name: b.add(name, warc.make_record(i, f"http://x/ {i}\r\n", p, hashlib.sha256(p).hexdigest(), None)) for i, (name, p) in enumerate(payloads.items())}
    data = b.tobytes()
    r = warc.Reader(data)
    assert len(r.frames) > 5 and {x[0]: x[1:] for x in r.index[1:]} == places
    for name in payloads:
        got = r.record(name)
        assert got.payload == payloads[name] and got.headers["WARC-Record-ID"] == name
    assert [x.payload for x in r.records()][1:] == list(payloads.values())
    stream = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).readall() for _ in range(1))
    assert stream.count(b"WARC/1.1\r\n") == 61 and b"http://x/%200%0D%0A" in stream


def test_damage_is_seen():
    b = warc.Bundle()
    b.add("<urn:page:1>", warc.make_record(1, None, b"x" * 5000, hashlib.sha256(b"x" * 5000).hexdigest(), None))
    data = bytearray(b.tobytes())
    data[30] ^= 255
    with pytest.raises(zstandard.ZstdError):
        list(warc.Reader(bytes(data)).records())


def test_operator(spark):
    html = [None, "", "short", "short", "long page é " * 20, "long page é " * 20, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "z" * 2_000_000, "long page é " * 20]
    rows = [(i * 3 % 37, f"http://h/{i}" if i % 4 else None, h, i) for i, h in enumerate(html)] + [(None, "u", "y" * 100, 0), (None, "u", "y" * 100, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(4)
    first = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        back = i is not None and h in first and i > first[h]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if back else "response", first[h] if back else None))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in warc.round_trip(df, bundle_bytes=1000).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.round_trip(df.limit(0)).count() == 0
