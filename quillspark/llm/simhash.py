"""Operator 12, document fingerprints by SimHash.

Terms are the runs of 1 to ``WIDTH`` words of a text; a term weighs
1 + log2 of the number of its occurrences, in sixteenths. Each term's hash votes
on every bit, for it or against it, with the term's weight, and the fingerprint has the bits that won. Two fingerprints agree in a bit
with probability 1 - angle / pi of their weighted term vectors, so ``likeness``, the cosine of pi times the share of bits that differ,
estimates the cosine of those vectors. Words are hashed with fixed keys, so fingerprints of different runs can be compared; a run of
words is hashed from the hashes of its words, in order. Terms are summed up in slices, so a text of any length takes bounded memory
besides itself and its distinct terms.

All fingerprints within a Hamming radius are found by permuted block tables: the bits are cut into blocks, of which ``radius`` may hold
all the bits that differ, so each choice of the other blocks is a table under whose key every pair within the radius meets. Equal
fingerprints are one, with a count. A pair is counted only in the first table where it meets, so what is returned is a number of
neighbours for each fingerprint and no pair is ever written. A key with many fingerprints is dealt into blocks of rows, each two of
which meet in one place.

Nulls and edge cases: a null text is empty; a text without words has no votes, and its fingerprint is all zeros, like that of any other
without words and no one else's by design; ids may be null or repeated; rows are ordered by id, then by the digest of the text, and
nulls come last in descending order; a table of one row is followed by itself; an empty table gives an empty result. Texts are used whole. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Hashing, mixed, word_hashes
from .workspace import Workspace, shuffle_partitions

BITS, WIDTH = 128, 2
#: Bits that may differ between fingerprints that count as near, and blocks of the tables.
RADIUS, BLOCKS = 3, 4
#: Words whose terms are voted on at once, and rows of one key that are compared in one task.
_SLICE, _ROWS = 1 << 16, 4096
_KEYS = Hashing(b"fingerprints of documents".ljust(32))


def terms(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 1 to ``WIDTH`` words."""
    out, run = [mixed(words)], words
    for n in range(1, min(WIDTH, len(words))):
        run = mixed(run[:-1] * _KEYS.shingle[n] + words[n:])
        out.append(run)
    return np.concatenate(out)


def fingerprint(words: np.ndarray) -> bytes:
    """``BITS`` bits, from the hashes of a text's words."""
    if not len(words):
        return bytes(BITS // 8)
    found, counts = np.unique(terms(words), return_counts=True)
    votes = np.zeros(BITS)
    for at in range(0, len(found), _SLICE):
        hashes, weights = found[at : at + _SLICE], np.rint(16 + 16 * np.log2(counts[at : at + _SLICE]))  # whole numbers, so that sums are exact
        for k in range(BITS // 64):
            value = mixed(hashes ^ _KEYS.shingle[8 + k])
            bits = np.unpackbits(value.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[64 * k : 64 * k + 64] += 2 * (weights @ bits.astype(np.float64)) - weights.sum()
    return np.packbits(votes > 0, bitorder="little").tobytes()


def fingerprints(texts: list[bytes]) -> list[bytes]:
    words, counts = word_hashes(texts, _KEYS)
    return [fingerprint(w) for w in np.split(words, np.cumsum(counts)[:-1])] if texts else []


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the cosine of the angle for which so many bits differ, and 0 for a right angle or more."""
    differ = (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()
    return max(0.0, math.cos(math.pi * differ / (8 * len(a)))) if differ else 1.0


def edited_text(text: str, donor: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``donor``."""
    half = len(text) // 2
    return text[: len(text) - half] + donor[:half]


def _rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows of batches, no more than so many bytes of text at once."""
    out, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            values = tuple(x.as_py() for x in row)
            out.append(values)
            size += len(values[-1])
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


def _edited(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (id, own, text) in order; a row that is not a part's own is only there for the one before it."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    waiting = None  # (id, text, fingerprint)
    for rows in _rows(batches, 4 << 20):
        prints = fingerprints([r[2].encode() for r in rows])
        pairs = []
        for (id_, own, text), print_ in zip(rows, prints, strict=True):
            if waiting:
                pairs.append((*waiting, text, print_))
            waiting = (id_, text, print_) if own else None
        if not pairs:
            continue
        changed = [edited_text(p[1], p[3]).encode() for p in pairs]
        edited = fingerprints(changed)
        columns = ([p[0] for p in pairs], [len(p[1]) for p in pairs], [sha256(t).hexdigest() for t in changed], [p[2].hex() for p in pairs], [e.hex() for e in edited], [likeness(p[2], e) for p, e in zip(pairs, edited, strict=True)], [likeness(p[2], p[4]) for p in pairs])
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """part, own, id and text of all rows: each part is a range of the order, and has the first row of the next part too, as not its own.

    The limits are the least rows of the parts of a range sort of ids and hashes alone, so as many as there are parts. Texts are moved once.
    """
    parts = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # ~id descends as id ascends
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).isNull().alias("none"), F.bitwise_not(F.coalesce(F.col(id_col), F.lit(0)).cast("long")).alias("down"), F.xxhash64(text).alias("tie"), text.alias("text"))
    order = ["none", "down", "tie"]
    sorted_ = rows.select(*order).repartitionByRange(parts, *order)
    limits = sorted({tuple(r.first) for r in sorted_.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*order)).alias("first")).collect()})

    @F.arrow_udf("array<int>")
    def parts_of(none: pa.Array, down: pa.Array, tie: pa.Array) -> pa.Array:
        found = []
        for key in zip(none.to_pylist(), down.to_pylist(), tie.to_pylist(), strict=True):
            part = bisect_right(limits, key) - 1
            found.append([part, (part or len(limits)) - 1] if limits[part] == key else [part])
        return pa.array(found, pa.list_(pa.int32()))

    dealt = rows.withColumn("parts", parts_of(*order)).select(*order, "id", "text", F.posexplode("parts").alias("other", "part"))
    return dealt.repartitionById(max(1, len(limits)), "part").sortWithinPartitions("part", "other", *order).select("id", (F.col("other") == 0).alias("own"), "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its id under the name of ``id_col``, n_chars, edited_sha256, fingerprint and edited_fingerprint (hexadecimal), near_edited, near_next.

    The edited text has its last half replaced by the beginning of the next document, in descending order of ids, the first after the last.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)
    found = _in_order(docs, id_col, text_col).mapInArrow(lambda b: _edited(b, arrow_kind), f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", id_col)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each document under the name of ``id_col``, and its fingerprint (hexadecimal)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([p.hex() for p in fingerprints([t or b"" for t in some.column(1).to_pylist()])], pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


class Tables:
    """Permuted block tables: each is named by the blocks that its key has, in order."""

    def __init__(self, radius: int, blocks: int):
        if blocks <= radius or (BITS // 8) % blocks:
            raise ValueError("there must be more blocks than bits that may differ, each of whole bytes")
        self.radius, self.width = radius, BITS // 8 // blocks
        self.kept = list(combinations(range(blocks), blocks - radius))

    def keys(self, fingerprint: Column) -> Column:
        """The key of a fingerprint (bytes) in each table."""
        part = lambda b: F.substring(fingerprint, b * self.width + 1, self.width)
        return F.array(*(F.struct(F.lit(t).alias("table"), F.concat(*map(part, kept)).alias("key")) for t, kept in enumerate(self.kept)))

    def pairs(self, table: int, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Which rows of ``many`` are within the radius of ``one`` and meet it in no earlier table."""
        differ = many ^ one
        near = np.bitwise_count(differ.view(np.uint64)).sum(axis=1) <= self.radius
        (at,) = np.nonzero(near)
        same = ~differ[at].reshape(len(at), many.shape[1] // self.width, self.width).any(axis=2)
        for kept in self.kept[:table]:
            near[at[same[:, kept].all(axis=1)]] = False
        return near


def _neighbours(batches: Iterator[pa.RecordBatch], tables: Tables) -> Iterator[pa.RecordBatch]:
    """Rows (table, key, i, j, block, fingerprint, n), sorted by group -> fingerprint, near: what a group adds to each."""

    def counted(name: tuple, rows: list[tuple]) -> pa.RecordBatch:
        table, _, i, j = name
        prints = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
        block, n = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], np.int64)
        near = np.zeros(len(rows), np.int64)
        for x in range(len(rows)):
            others = np.arange(x + 1, len(rows)) if i == j else np.flatnonzero(block == j) if block[x] == i else ()
            if len(others):
                found = others[tables.pairs(table, prints[x], prints[others])]
                near[x] += n[found].sum()
                near[found] += n[x]
        (some,) = np.nonzero(near)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in some], pa.binary()), pa.array(near[some], pa.int64())], ["fingerprint", "near"])

    name, rows = None, []
    for batch in batches:
        for *key, block, print_, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tuple(key) != name:
                if len(rows) > 1:
                    yield counted(name, rows)
                name, rows = tuple(key), []
            rows.append((block, print_, n))
    if len(rows) > 1:
        yield counted(name, rows)


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint and n_near for each distinct value of ``fingerprint`` (hexadecimal): the other rows within ``radius`` bits, equal ones included."""
    ws = Workspace(prints.sparkSession, "simhash")
    tables = Tables(radius, blocks)
    distinct = ws.save(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).select(F.unhex("fingerprint").alias("fingerprint"), "n"), "distinct")
    keyed = distinct.select("fingerprint", "n", F.inline(tables.keys(F.col("fingerprint"))))
    sizes = keyed.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / _ROWS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    met = keyed.join(sizes, ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    group = ["table", "key", "i", "j"]
    found = met.repartition(*group).sortWithinPartitions(*group).select(*group, "block", "fingerprint", "n").mapInArrow(lambda b: _neighbours(b, tables), "fingerprint binary, near long")
    near = ws.save(found.groupBy("fingerprint").agg(F.sum("near").alias("near")), "near")
    every = distinct.join(near, "fingerprint", "left").select(F.lower(F.hex("fingerprint")).alias("fingerprint"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_near"))
    return every


def edits_and_neighbours(docs: DataFrame) -> DataFrame:
    """``fingerprint_edits`` of documents, with n_near: how many others have a fingerprint within ``RADIUS`` bits."""
    ws = Workspace(docs.sparkSession, "fingerprints")
    found = ws.save(fingerprint_edits(docs), "edits")
    return found.join(near_counts(found.select("fingerprint")), "fingerprint").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
