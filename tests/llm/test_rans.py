"""Operator 2: exact round trips, random access, damage, and the whole operator against the library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import rans
from quillspark.llm.tokens import vocabulary
from quillspark.llm.workspace import Workspace


def coded(ids, n=50_257):
    table = rans.Table.of(np.bincount(ids, minlength=n))
    assert int(table.freq.sum()) in (0, 1 << rans.BITS)
    return table, rans.encode_file(np.asarray(ids, np.uint16), [1, None], np.array([len(ids) - 1, 1]), 77, table)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 16_384, 16_385, 65_536, 65_537, 200_001])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(50_256, rng.zipf(1.3, n))
    table, data = coded(ids)
    f = rans.File(data)
    assert (f.first, f.n, f.doc_ids, f.lengths.tolist()) == (77, n, [1, None], [n - 1, 1])
    assert f.ids(table).tolist() == ids.tolist()
    for a, b in rng.integers(0, n + 1, (20, 2)):
        assert f.ids(table, min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()


def test_size_is_near_the_entropy():
    ids = np.minimum(50_256, np.random.default_rng(1).zipf(1.5, 300_000))
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(coded(ids)[1]) < 1.06 * entropy + 20_000


def test_one_id_and_damage():
    table, data = coded(np.full(5000, 7))
    assert set(rans.File(data).ids(table)) == {7}
    table, data = coded(np.arange(40_000) % 999)
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.File(bytes(broken)).ids(table)


def test_operator(spark):
    texts = [None, "", "Hello world", "a  b\n\nc\td", "é" * 3000, "# # #", "same", "same", "word " * 30_000]
    rows = [*enumerate(texts), (None, "null id"), (3, "again")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    plain = Tokenizer.from_file(vocabulary(rans.VOCABULARY))
    want, at = [], 0
    ties = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]])):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in rans.round_trip(df, file_ids=5000).orderBy("start").collect()]
    assert got == want
    assert rans.round_trip(df.limit(0)).count() == 0


def test_files_keep_their_names(spark):
    ws = Workspace(spark, "test")
    df = spark.createDataFrame([(i, "word " * 50) for i in range(40)], "doc_id long, text string")
    table = rans.write_ids(df, ws.path("files"), ws, file_ids=500)
    assert rans.read_ids(spark, ws.path("files"), table).count() == 40
