"""Operator 2, token ids in binary files, coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus and scaled to 2^18, serves all files. A file holds consecutive documents in
the order of their ids. Its ids are cut into blocks; a block is coded by 64 interleaved states, lane i taking ids i, i + 64, and so on, each
state in [2^31, 2^63) and emitting 32-bit words. States and word offset are noted every 256 steps, so that decoding can start
there: all such segments of a file are decoded side by side, or only those that a range of ids needs. Words, ids and the index
of documents have checksums.

Layout of a file, little-endian: ``_HEAD``; the documents (deflated: ids, which are null, lengths); per block ``_BLOCK``; per
segment the word offset (u32) and 64 states (u64); the words of all blocks (u32).

Nulls and edge cases: a null text is empty, which leaves the end id alone; a null document id stands before all others; repeated
ids are documents of their own, in the order of their texts' hashes; long texts are stored whole, a file then grows beyond its usual
size; an empty table gives no file and an empty result. Document ids are integers. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import write_file
from .tokens import encoder_of
from .workspace import Workspace

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Ids after which a file ends, at the end of a document.
FILE_IDS = 1 << 20
BLOCK_IDS = 1 << 16
LANES = 64
SEGMENT_STEPS = 256
BITS = 18
_LOW = np.uint64(1 << 31)

_MAGIC = b"qsRANS1\n"
_HEAD = struct.Struct("<8sIIQQQQII")  # magic, table crc, documents crc, first id, ids, documents, bytes of documents, blocks, segments
_BLOCK = struct.Struct("<IIII")  # ids, words, crc of words, crc of ids


class Table(NamedTuple):
    """Scaled frequencies, what stands before each id, and the id of each of the 2^18 slots."""

    freq: np.ndarray
    before: np.ndarray
    slot: np.ndarray
    crc: int

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Every id that occurs keeps a share; what rounding leaves goes to, or comes from, the most frequent."""
        counts = np.asarray(counts, np.int64)
        if np.count_nonzero(counts) > 1 << (BITS - 1):
            raise ValueError("too many different ids for the table")
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(object) * (1 << BITS) // max(1, int(counts.sum()))).astype(np.int64)), 0)
        for i in np.argsort(-freq, kind="stable"):
            excess = int(freq.sum()) - (1 << BITS)
            if not excess or not freq[i]:
                break
            freq[i] = max(1, freq[i] - excess)
        before = np.concatenate([[0], np.cumsum(freq)[:-1]]) if len(freq) else freq
        return cls(freq.astype(np.uint64), before.astype(np.uint64), np.repeat(np.arange(len(freq)), freq).astype(np.uint32), zlib.crc32(freq.astype("<u4").tobytes()))

    def tobytes(self) -> bytes:
        raw = self.freq.astype("<u4").tobytes()
        return struct.pack("<II", len(self.freq), self.crc) + zlib.compress(raw)


def _encode(ids: np.ndarray, table: Table) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """Of blocks of one size (block, step, lane): words; word offset and states of each segment."""
    n, steps, lanes = ids.shape
    x = np.full((n, lanes), _LOW)
    words, emits = np.empty((steps, n, lanes), "<u4"), np.empty((steps, n, lanes), bool)
    starts = []
    shift, low, bits = np.uint64(63 - BITS), np.uint64(32), np.uint64(BITS)
    for s in range(steps - 1, -1, -1):
        f = table.freq[ids[:, s]]
        emit = x >= (f << shift)
        words[s], emits[s] = x, emit
        x = np.where(emit, x >> low, x)
        q = x // f
        x = (q << bits) + (x - q * f) + table.before[ids[:, s]]
        if s % SEGMENT_STEPS == 0:
            starts.append(x)
    words, emits = words.transpose(1, 0, 2), emits.transpose(1, 0, 2)
    each = emits.sum(axis=2)
    offsets = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(each, axis=1)], axis=1)[:, :steps:SEGMENT_STEPS]
    states = np.stack(starts[::-1], axis=1)
    return [words[b][emits[b]].tobytes() for b in range(n)], list(offsets), list(states)


def _decode(x: np.ndarray, at: np.ndarray, words: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """Ids of segments of one length, from their states and word offsets."""
    out = np.empty((len(x), steps, LANES), np.uint32)
    mask, bits, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    words = np.concatenate([words, np.zeros(1, words.dtype)]).astype(np.uint64)
    for s in range(steps):
        slot = x & mask
        got = table.slot[slot]
        out[:, s] = got
        x = table.freq[got] * (x >> bits) + slot - table.before[got]
        need = x < _LOW
        n = np.cumsum(need, axis=1)
        x = np.where(need, (x << low) | words[np.where(need, at[:, None] + n - 1, 0)], x)
        at = at + n[:, -1]
    return out


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, first: int, table: Table) -> bytes:
    usual = int(np.argmax(table.freq))
    blocks: list[tuple[int, bytes, np.ndarray, np.ndarray]] = []
    whole = len(ids) // BLOCK_IDS
    for part, n in ((ids[: whole * BLOCK_IDS], whole), (ids[whole * BLOCK_IDS :], 1)):
        if not len(part):
            continue
        padded = np.concatenate([part, np.full(-len(part) % (n * LANES), usual, part.dtype)]).reshape(n, -1, LANES).astype(np.int64)
        for i, (w, o, s) in enumerate(zip(*_encode(padded, table), strict=True)):
            blocks.append((zlib.crc32(part[i * BLOCK_IDS : (i + 1) * BLOCK_IDS].astype("<u4").tobytes()), w, o, s))
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.asarray(lengths, "<u8").tobytes(), 1)
    heads = b"".join(_BLOCK.pack(min(BLOCK_IDS, len(ids) - i * BLOCK_IDS), len(w) // 4, zlib.crc32(w), crc) for i, (crc, w, _, _) in enumerate(blocks))
    segments = b"".join(struct.pack("<I", int(o)) + s.astype("<u8").tobytes() for _, _, offsets, states in blocks for o, s in zip(offsets, states, strict=True))
    n_segments = sum(len(o) for _, _, o, _ in blocks)
    head = _HEAD.pack(_MAGIC, table.crc, zlib.crc32(docs), first, len(ids), len(doc_ids), len(docs), len(blocks), n_segments)
    return head + docs + heads + segments + b"".join(w for _, w, _, _ in blocks)


class File:
    """A file's parts; ``ids`` decodes a range of its ids."""

    def __init__(self, data: bytes):
        magic, self.table_crc, docs_crc, self.first, self.n, n_docs, docs_size, n_blocks, n_segments = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a file of this format")
        at = _HEAD.size
        docs = data[at : at + docs_size]
        if zlib.crc32(docs) != docs_crc:
            raise ValueError("the index of documents is damaged")
        docs = zlib.decompress(docs)
        null = np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(docs, "<i8", n_docs), null, strict=True)]
        self.lengths = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        at += docs_size
        self.blocks = [_BLOCK.unpack_from(data, at + i * _BLOCK.size) for i in range(n_blocks)]
        at += n_blocks * _BLOCK.size
        kind = np.dtype([("offset", "<u4"), ("states", "<u8", LANES)])
        self.segments = np.frombuffer(data, kind, n_segments, at)
        self.words = np.frombuffer(data, "<u4", -1, at + n_segments * kind.itemsize)

    def ids(self, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file. Whole blocks are checked against their checksums."""
        if table.crc != self.table_crc:
            raise ValueError("another frequency table")
        stop = self.n if stop is None else min(stop, self.n)
        wanted: dict[int, list[tuple[int, int, int]]] = {}  # by number of steps: segment, word offset, place of its first id
        word = segment = 0
        span = SEGMENT_STEPS * LANES
        for b, (n, n_words, crc, _) in enumerate(self.blocks):
            steps = -(-n // LANES)
            touched = False
            for k in range(-(-steps // SEGMENT_STEPS)):
                place = b * BLOCK_IDS + k * span
                if place < stop and place + span > start:
                    touched = True
                    wanted.setdefault(min(SEGMENT_STEPS, steps - k * SEGMENT_STEPS), []).append((segment, word + int(self.segments["offset"][segment]), place))
                segment += 1
            if touched and zlib.crc32(self.words[word : word + n_words].tobytes()) != crc:
                raise ValueError("a block's words are damaged")
            word += n_words
        out = np.zeros(self.n, np.uint32)
        for steps, some in wanted.items():
            at, offsets, places = map(list, zip(*some, strict=True))
            for place, got in zip(places, _decode(self.segments["states"][at].astype(np.uint64), np.array(offsets), self.words, steps, table), strict=True):
                flat = got.reshape(-1)[: min(self.n, (place // BLOCK_IDS + 1) * BLOCK_IDS) - place]
                out[place : place + len(flat)] = flat
        for b, (n, _, _, crc) in enumerate(self.blocks):
            if start <= b * BLOCK_IDS and b * BLOCK_IDS + n <= stop and zlib.crc32(out[b * BLOCK_IDS : b * BLOCK_IDS + n].astype("<u4").tobytes()) != crc:
                raise ValueError("a block's ids are damaged")
        return out[start:stop]


def _tokenised(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, file_ids: int, added_tokens: bool) -> DataFrame:
    """A row for each file to be: its documents in order, their ids, and the number of ids before them in the partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, added_tokens)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, before, number = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, ids = [], [], []
        total = 0

        def row():
            nonlocal before, number, total
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "before": pa.array([before], pa.int64()), "n": pa.array([total], pa.int64()), "width": pa.array([encoder.dtype.itemsize], pa.int32()), "doc_ids": pa.array([list(doc_ids)], pa.list_(pa.int64())), "lengths": pa.array([list(lengths)], pa.list_(pa.int64())), "ids": pa.array([b"".join(ids)], pa.binary()), "counts": pa.array([zlib.compress(np.bincount(np.frombuffer(b"".join(ids), encoder.dtype)).astype("<u4").tobytes(), 1)], pa.binary())})
            before, number, total = before + total, number + 1, 0
            for x in (doc_ids, lengths, ids):
                x.clear()
            return out

        for batch in batches:
            texts = (t for i in range(0, len(batch), 256) for t in batch.column(1).slice(i, 256).to_pylist())
            for d, got in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                n = len(got) // encoder.dtype.itemsize + 1
                doc_ids.append(d)
                lengths.append(n)
                ids.append(got + end)
                total += n
                if total >= file_ids:
                    yield row()
        if doc_ids:
            yield row()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # ids that repeat, or are null, are many rows of one id: the text's hash parts them, and a number those that repeat whole
    ordered = ordered.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text").drop("tie", "row")
    return ordered.mapInArrow(encode, "part int, number int, before long, n long, width int, doc_ids array<long>, lengths array<long>, ids binary, counts binary")


def _ids_of(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def _table_of(rows: DataFrame) -> Table:
    """Counts of all ids. The driver gets a row for each id that occurs, at most the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                here = np.frombuffer(zlib.decompress(raw.as_py()), "<u4")
                counts = np.pad(counts, (0, max(0, len(here) - len(counts))))
                counts[: len(here)] += here
        (at,) = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at.astype(np.int64)), "n": pa.array(counts[at])})

    found = rows.select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return Table.of(counts)


def write_ids(docs: DataFrame, folder: str, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, file_ids: int = FILE_IDS, added_tokens: bool = True) -> Table:
    """Tokenise ``docs``, write their ids as files in ``folder`` and return the frequency table, which is also written beside them."""
    spark = docs.sparkSession
    rows = ws.save(_tokenised(docs, id_col, text_col, vocabulary, end_id, file_ids, added_tokens), "ids")
    table = _table_of(rows)
    shared = spark.sparkContext.broadcast(table)  # as large as the vocabulary
    # a row for each partition of the exchange
    starts = rows.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                data = encode_file(_ids_of(r["ids"], r["width"]), r["doc_ids"], np.array(r["lengths"]), r["part_start"] + r["before"], shared.value)
                write_file(folder, f"{r['part']:06d}-{r['number']:06d}.rans", data)
                yield pa.RecordBatch.from_pydict({"size": pa.array([len(data)], pa.int64())})

    rows.drop("counts").join(F.broadcast(starts), "part").mapInArrow(write, "size long").agg(F.sum("size")).first()
    write_file(f"{folder}-table", "table.freq", table.tobytes())
    return table


def read_ids(spark: SparkSession, folder: str, table: Table, checksums_only: bool = False) -> DataFrame:
    """A row a document from the files: doc_id, start, n_tokens, ids_crc32, and its ids as little-endian unsigned 32-bit integers."""
    shared = spark.sparkContext.broadcast(table)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(folder).select("content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                f = File(data.as_py())
                ids, ends = f.ids(shared.value).astype("<u4"), np.cumsum(f.lengths)
                starts = ends - f.lengths
                each = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": pa.array(f.doc_ids, pa.int64()), "start": pa.array(f.first + starts), "n_tokens": pa.array(f.lengths), "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())}
                yield pa.RecordBatch.from_pydict(out if checksums_only else out | {"ids": pa.array([x.tobytes() for x in each], pa.binary())})

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * (not checksums_only))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Writes the files and returns from them, for each document: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ids")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    table = write_ids(docs, ws.path("files"), ws, id_col, text_col, **how)
    ws.drop("ids")
    return read_ids(spark, ws.path("files"), table, checksums_only=True)
