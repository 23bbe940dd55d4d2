"""Operator 5, removal of repeated passages, by fixed-block anchors.

A window of 35 words holds a whole block of 18 words wherever it starts, if blocks stand at every 18th word of a document. So the
blocks of all documents are indexed, and every rolling window of 18 words is probed against them: each chunk of documents sends
the distinct hashes of its windows, marked where they are blocks, to the partition of their range, and gets back those that are
blocks and occur elsewhere too. Hits are then extended: the windows of 35 words around them are compared in the same manner,
by 96-bit hashes of their words, and runs of windows that occur again are the maximal repeats. A passage that is in very many
documents is one value a chunk, never a group of rows, and no pairs of documents are made. Words count as equal if their 64-bit
hashes are. Hashes are keyed, with keys drawn for each run: two unlike words are taken for one another under one in 2^64 keys, two
unlike windows of unlike words under one in 2^93, whatever the words are.

Documents are kept once, in a table in buckets by chunk, so that later passes meet the answers without moving texts again. A
chunk is part of an input partition.

Nulls and edge cases: a null or blank text has no words, and its digest is that of the empty string; texts shorter than a window
lose nothing; ids may be null or repeated, each row is a document of its own, and rows that repeat whole lose every window; windows
that overlap themselves count as repeats; words are bytes between blanks, compared as they are. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_table
from .words import Hashing, word_hashes
from .workspace import Workspace, shuffle_partitions

WINDOW = 35

#: Bytes of text whose windows' hashes meet in one group.
RANGE_BYTES = 16 << 20
_ANSWER = "chunk long, keys binary"


def _pack(keys: np.ndarray, extra: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, with 32 more bits and two flags each."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = max((i + 1 for i in range(8) if gaps[i].any()), default=1)
    more = extra.astype("<u4").tobytes() if extra.any() else b""
    head = np.array([len(keys), width, bool(more)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + gaps[:width].tobytes() + np.packbits(flags & 1).tobytes() + np.packbits(flags >> 1).tobytes() + more)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, width, more = map(int, np.frombuffer(raw, "<u4", 3))
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(raw, np.uint8, n * width, 12).reshape(width, n).T
    at, bits = 12 + n * width, -(-n // 8)
    one, two = (np.unpackbits(np.frombuffer(raw, np.uint8, bits, at + i * bits), count=n) for i in (0, 1))
    extra = np.frombuffer(raw, "<u4", n, at + 2 * bits) if more else np.zeros(n, np.uint32)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), extra, one | two << 1


def _bucket(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Ranges of equal width of keys of ``bits`` bits."""
    top = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    return (top * np.uint64(buckets)) >> np.uint64(32)


class _Chunk:
    """Word hashes of a chunk's documents, and which windows lie within one document."""

    def __init__(self, table: pa.Table, hashing: Hashing):
        self.hashing = hashing
        self.texts = [t or b"" for t in table.column("text").to_pylist()]
        self.words, self.counts = word_hashes(self.texts, hashing)
        ends = np.cumsum(self.counts)
        self.starts = ends - self.counts
        self.left = np.repeat(ends, self.counts) - np.arange(len(self.words))  # words to the end of the document
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, self.counts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows within documents, and their hashes."""
        (at,) = np.nonzero(self.left >= length)
        return at, self.hashing.windows(self.words, length)[at] if len(at) else np.zeros(0, np.uint64)


def _questions(chunk: int, keys: np.ndarray, extra: np.ndarray, marked: np.ndarray, buckets: int, bits: int) -> pa.Table:
    """Distinct keys by bucket; flag 1: twice or more in this chunk, flag 2: marked."""
    order = np.lexsort((extra, keys)) if extra.any() else np.argsort(keys, kind="stable")
    keys, extra, marked = keys[order], extra[order], marked[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (extra[1:] != extra[:-1])
    (first,) = np.nonzero(new)
    n = np.diff(np.append(first, len(keys)))
    flags = (n > 1).astype(np.uint8) | np.logical_or.reduceat(marked, first).astype(np.uint8) << 1 if len(first) else np.zeros(0, np.uint8)
    keys, extra = keys[first], extra[first]
    limits = np.searchsorted(_bucket(keys, buckets, bits), np.arange(buckets + 1))
    rows = [(b, _pack(keys[i:j], extra[i:j], flags[i:j])) for b, (i, j) in enumerate(zip(limits, limits[1:], strict=False)) if i < j]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary())})


def _answers(table: pa.Table) -> pa.Table:
    """Of all chunks' keys in a bucket: those that occur twice or more and are marked somewhere, to each chunk that has them."""
    chunks = table.column("chunk").to_pylist()
    parts = [_unpack(k.as_py()) for k in table.column("keys")]
    keys, extra, flags = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((extra, keys)) if extra.any() else np.argsort(keys, kind="stable")
    k, e = keys[order], extra[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
    (first,) = np.nonzero(new)
    n = np.add.reduceat(1 + (flags[order] & 1).astype(np.int64), first)
    good = (n > 1) & np.bitwise_or.reduceat(flags[order] >> 1, first).astype(bool)
    hit = np.zeros(len(keys), bool)
    hit[order] = np.repeat(good, np.diff(np.append(first, len(k))))
    rows, at = [], 0
    for chunk, part in zip(chunks, parts, strict=True):
        mine = hit[at : at + len(part[0])]
        at += len(mine)
        if mine.any():
            rows.append((chunk, _pack(part[0][mine], part[1][mine], part[2][mine])))
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary())})


def _known(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(k.as_py())[:2] for k in answers.column("keys")]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    keys, extra = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((extra, keys))
    return keys[order], extra[order]


def _among(keys: np.ndarray, extra: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (key, extra) are known."""
    found = np.zeros(len(keys), bool)
    if not len(known[0]):
        return found
    at, open_ = np.searchsorted(known[0], keys), np.arange(len(keys))
    while len(open_):  # again only for different windows with one key
        i = at[open_]
        inside = i < len(known[0])
        open_, i = open_[inside], i[inside]
        same = known[0][i] == keys[open_]
        open_, i = open_[same], i[same]
        right = known[1][i] == extra[open_]
        found[open_[right]] = True
        open_ = open_[~right]
        at[open_] += 1
    return found


class _Passes:
    """The three passes over a chunk. Instances go to the tasks."""

    def __init__(self, window: int, buckets: int, bits: int):
        self.window, self.block, self.buckets, self.bits = window, (window + 1) // 2, buckets, bits
        self.hashing = Hashing()

    def _blocks(self, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
        at, keys = chunk.windows(self.block)
        return at, keys >> np.uint64(64 - self.bits)

    def probe(self, key: tuple, table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, self.hashing)
        at, keys = self._blocks(chunk)
        return _questions(key[0].as_py(), keys, np.zeros(len(keys), np.uint32), chunk.place[at] % self.block == 0, self.buckets, self.bits)

    def _long(self, chunk: _Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        first, second = (self.hashing.windows(chunk.words, self.window, salt)[at] for salt in (0, 1))
        return first, (second >> np.uint64(32)).astype(np.uint32)

    def extend(self, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary())})
        chunk = _Chunk(table, self.hashing)
        at, keys = self._blocks(chunk)
        hits = np.zeros(len(chunk.words) + 1, np.int64)
        hits[at + 1] = _among(keys, np.zeros(len(keys), np.uint32), _known(answers))
        hits = np.cumsum(hits)
        (at,) = np.nonzero(chunk.left >= self.window)
        at = at[hits[at + self.window - self.block + 1] > hits[at]]
        keys, extra = self._long(chunk, at)
        return _questions(key[0].as_py(), keys, extra, np.ones(len(keys), bool), self.buckets, 64)

    def remove(self, key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["row", "n_words", "n_removed", "spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary()]
        if not table.num_rows:
            return pa.table([pa.array([], table.schema.field("doc_id").type), *(pa.array([], k) for k in kinds)], ["doc_id", *names])
        chunk = _Chunk(table, self.hashing)
        known = _known(answers)
        gone = np.zeros(len(chunk.words) + 1, np.int64)
        if len(known[0]):
            (at,) = np.nonzero(chunk.left >= self.window)
            at = at[_among(*self._long(chunk, at), known)]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + self.window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        rows = []
        for row, text, start, n in zip(table.column("row").to_pylist(), chunk.texts, chunk.starts.tolist(), chunk.counts.tolist(), strict=True):
            mask = gone[start : start + n]
            words = text.split()
            if n and mask.any():
                words = list(compress(words, (~mask).tolist()))
                spans = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
            else:
                spans = []
            kept = b" ".join(words)
            rows.append((row, n, n - len(words), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pa.table([table.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])


def _asked(questions: DataFrame) -> DataFrame:
    return questions.groupBy("bucket").applyInArrow(_answers, _ANSWER)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row a document: doc_id, row, n_words, n_removed, spans (starts and ends of removed runs of words, in turn), kept_sha256 and kept."""
    spark = docs.sparkSession
    ws = Workspace(spark, "repeats")
    text = F.col(text_col).cast("binary")
    chunks = chunk_table(docs, ws, {"doc_id": F.col(id_col), "text": text, "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // RANGE_BYTES))
    # enough bits that windows seldom share one by chance; those that do are told apart when they are extended
    passes = _Passes(window, buckets, min(64, max(33, math.ceil(math.log2(total + 2)) + 12)))

    by_chunk = chunks.select("chunk", "doc_id", "row", "text").groupBy("chunk")
    questions = chunks.select("chunk", "text").groupBy("chunk").applyInArrow(lambda key, table: passes.probe(key, table), "bucket long, chunk long, keys binary")
    hits = ws.save(_asked(questions), "hits")
    longer = chunks.select("chunk", "text").groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lambda key, table, answers: passes.extend(key, table, answers), "bucket long, chunk long, keys binary")
    repeated = ws.save(_asked(longer), "repeated")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    return by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(lambda key, table, answers: passes.remove(key, table, answers), f"doc_id {kind}, row long, n_words long, n_removed long, spans array<long>, kept_sha256 string, kept binary")


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of what is kept."""
    return remove_repeats(docs, id_col, text_col).select("doc_id", "n_words", "n_removed", "kept_sha256")
