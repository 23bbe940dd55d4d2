"""Operator 10, near-duplicates by MinHash and a multi-index Hamming join.

A document's set holds its distinct shingles of ``shingle`` words, by default 2. Documents with equal sets form a class, of which one goes on. Its signature
is 40 MinHash values of 16 bits; two sets of similarity s differ in each with probability 1 - s. All pairs of classes whose
signatures differ in at most 19 places share, by the pigeonhole principle, one of ten chunks of 4 values up to one error; so a
class is indexed under each chunk with each one value left out, 40 keys. A pair at similarity 0.8 exceeds 19 differences
with probability 2e-5.

Pairs under one key are not all made. Each key's least class is its centre; all others are compared with it, the closest
centre of each class is confirmed on the full sets, and components are formed. Only where one key still holds several components
are further pairs compared, between different ones, and without those that distances to the centre rule out (signature distance is
a metric: x and y can't be within 19 if their distances to the centre differ by more). Large keys are dealt into blocks; signatures
meet there first, sets only of rows that have a candidate, and only a forest of links leaves a block. All pairs that the signatures
allow are confirmed on full sets, unless their classes are in one component already. So a hot group of copies or near copies costs a
number of comparisons in proportion to its size.

Sets are compared by 64-bit hashes of their shingles, and equal sets are known by two more 64-bit sums. Hashes are keyed, with keys
drawn for each run: two unlike shingles have one hash under about one in 2^62 keys, whatever their words are.

Nulls and edge cases: a text without words, empty or null, has an empty set, is linked with nothing and is kept; a text of fewer words than a shingle
has its whole sequence of words as one; ids may be null or repeated: each row counts for itself, a component's id is its smallest
non-null id (null if there is none), and ``kept_row`` marks just one row of each component; texts are used whole. An empty table
gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import chunk_table
from .graph import components, forest_roots
from .words import Hashing, mixed, word_hashes
from .workspace import Workspace

PERCENT = 80
SHINGLE = 2
CHUNKS, CHUNK_VALUES, CHUNK_ERRORS = 10, 4, 1
VALUES = CHUNKS * CHUNK_VALUES
#: Signatures that differ in up to so many places are all found: with more, each chunk could have more errors than are allowed.
MOST_DIFFERENT = CHUNKS * (CHUNK_ERRORS + 1) - 1

#: Rows of a key that are compared in one task, and their shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 16_384, 4 << 20

_rng = np.random.Generator(np.random.PCG64(1_997))
_MULTIPLY = _rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, np.uint64)


def shingle_hashes(texts: list[bytes | None], hashing: Hashing, width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes. A-Z count as a-z."""
    words, counts = word_hashes([(t or b"").lower() for t in texts], hashing)
    ends = np.cumsum(counts)
    shingles = words
    for k in range(1, width):
        shingles = mixed(shingles[:-1] * hashing.shingle[k] + words[k:])
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(shingles[end - n : end - width + 1]))
        elif n:
            h = words[end - n : end]
            out.append(mixed(reduce(lambda a, b: mixed(a * hashing.shingle[n]) + b, (h[i : i + 1] for i in range(n))) + np.uint64(n)))
        else:
            out.append(words[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit MinHash values for each set; none may be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), "<u2")
    for i in range(VALUES):
        out[:, i] = mixed(np.minimum.reduceat(every * _MULTIPLY[i] + _ADD[i], starts)) >> np.uint64(48)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """For each signature, a key for each chunk and each place in it that is left out."""
    values = signature.astype(np.uint64).reshape(len(signature), CHUNKS, CHUNK_VALUES)
    keys = []
    for out in range(CHUNK_VALUES):
        key = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(CHUNK_VALUES) + np.uint64(out)
        for i in range(CHUNK_VALUES):
            if i != out:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i])
        keys.append(key)
    return np.concatenate(keys, axis=1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], width: int, hashing: Hashing) -> Iterator[pa.RecordBatch]:
    """row, doc_id, chunk, number of shingles, two hashes of the set, signature."""
    for batch in batches:
        for i in range(0, len(batch), 512):
            some = batch.slice(i, 512)
            sets = shingle_hashes(some.column(2).to_pylist(), hashing, width)
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            one, two = (pa.array([int(mixed(s + c).sum().view(np.int64)) if len(s) else None for s in sets], pa.int64()) for c in hashing.sets)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(3), pa.array([len(s) for s in sets], pa.int64()), one, two, pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())], ["row", "doc_id", "chunk", "n", "h1", "h2", "signature"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 2048):
            some = batch.slice(i, 2048)
            keys = keys_of(np.frombuffer(b"".join(some.column(1).to_pylist()), "<u2").reshape(-1, VALUES))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(some.column(0).to_numpy(), keys.shape[1]))], ["key", "row"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, VALUES) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a != b).sum(axis=1).astype(np.int32)), batch.column(4)], ["a", "b", "d", "sizes"])


def _confirmed(batches: Iterator[pa.RecordBatch], width: int, hashing: Hashing) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        for i in range(0, len(batch), 256):
            some = batch.slice(i, 256)
            a, b, text_a, text_b = (c.to_pylist() for c in some.columns)
            texts = dict(zip([*a, *b], [*text_a, *text_b], strict=True))
            sets = dict(zip(texts, shingle_hashes(list(texts.values()), hashing, width), strict=True))
            good = []
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                good.append(100 * both >= PERCENT * (len(sets[x]) + len(sets[y]) - both))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"]).filter(pa.array(good))


def _chosen(key: tuple, texts: pa.Table, rows: pa.Table) -> pa.Table:
    wanted = set(rows.column("row").to_pylist())
    return texts.select(["row", "text"]).filter(pa.array([r in wanted for r in texts.column("row").to_pylist()], pa.bool_()))


def _chosen_sets(key: tuple, texts: pa.Table, rows: pa.Table, width: int, hashing: Hashing) -> pa.Table:
    some = _chosen(key, texts, rows)
    sets = shingle_hashes(some.column("text").to_pylist(), hashing, width) if some.num_rows else []
    return pa.table({"row": some.column("row"), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})


class _Block:
    """Rows of one key, or of two of its blocks, of which no two in one component are compared."""

    def __init__(self, key: int, cross: bool):
        self.key, self.cross = key, cross
        self.rows: list[tuple] = []

    def _pairs(self, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """A place and those it may be linked with by signature, size and distance to the centre. ``root`` may change meanwhile."""
        d, block, n = np.array([r[2:5] for r in self.rows]).T
        signature = np.frombuffer(b"".join(r[5] for r in self.rows), "<u2").reshape(len(d), -1)
        keys = keys_of(signature)
        names, counts = np.unique(root, return_counts=True)
        (others,) = np.nonzero(root != names[counts.argmax()])  # two of the largest component need no comparison
        done = np.zeros(len(d), bool)
        for i in others.tolist():
            done[i] = True
            fits = ~done & (root != root[i]) & (np.abs(d - d[i]) <= MOST_DIFFERENT) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
            if self.cross:
                fits &= block != block[i]
            (at,) = np.nonzero(fits)
            at = at[(signature[at] != signature[i]).sum(axis=1) <= MOST_DIFFERENT]
            # a pair with several keys is compared under the first of them
            at = at[(keys[at] == keys[i]).argmax(axis=1) == (keys[i] == self.key).argmax()]
            if len(at):
                yield i, at

    def _roots(self) -> np.ndarray:
        return np.array([r[1] for r in self.rows])

    def candidates(self) -> list[int]:
        """Rows that may have a link here."""
        root = self._roots()
        found = np.zeros(len(root), bool)
        if len(root) > 1 and (root != root[0]).any():
            for i, at in self._pairs(root):
                found[i] = found[at] = True
        return [r[0] for r, f in zip(self.rows, found, strict=True) if f]

    def links(self) -> list[tuple[int, int]]:
        """A forest that connects all that links between components connect; the last value of a row is its set."""
        root, out = self._roots(), []
        if len(root) < 2 or (root == root[0]).all():
            return out
        sets = [np.frombuffer(r[6], np.uint64) for r in self.rows]
        n = np.array([len(s) for s in sets])
        for i, at in self._pairs(root):
            # a few at once: what the first of them connects needs no comparison any more
            for part in np.array_split(at, -(-len(at) // 64)):
                part = part[root[part] != root[i]]
                if not len(part):
                    continue
                every = np.concatenate([sets[j] for j in part])
                place = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
                both = np.add.reduceat((sets[i][place] == every).astype(np.int64), np.concatenate([[0], np.cumsum(n[part])[:-1]]))
                for j in part[100 * both >= PERCENT * (n[part] + n[i] - both)].tolist():
                    if root[j] != root[i]:
                        a, b = self.rows[i][0], self.rows[j][0]
                        out.append((min(a, b), max(a, b)))
                        root[root == root[j]] = root[i]
        return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Rows sorted by key, i and j, the numbers of the two blocks."""
    name, block = None, None
    for batch in batches:
        for key, i, j, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, i, j) != name:
                if block:
                    yield block
                name, block = (key, i, j), _Block(key, i != j)
                block.name = name
            block.rows.append(tuple(values))
    if block:
        yield block


def _block_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _by_block(batches):
        if found := block.candidates():
            key, i, j = ([x] * len(found) for x in block.name)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "row": pa.array(found, pa.int64())})


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _by_block(batches):
        if found := block.links():
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _attached(key: tuple, kept: pa.Table, found: pa.Table) -> pa.Table:
    """What was found for a chunk's rows, with the columns that are kept of them."""
    kept, found = (t.sort_by("row").drop_columns([*{"chunk", "row"} & set(t.column_names)]) for t in (kept, found))
    for name in kept.column_names:
        found = found.append_column(name, kept.column(name))
    return found


class _Join:
    """The steps on classes, each of which is named by the least row with its set."""

    def __init__(self, ws: Workspace, chunks: DataFrame, classes: DataFrame, width: int, hashing: Hashing):
        self.ws, self.chunks, self.classes, self.width, self.hashing = ws, chunks, classes, width, hashing

    def with_distance(self, pairs: DataFrame) -> DataFrame:
        """a, b, their distance d, and whether their numbers of shingles allow a link."""
        side = lambda x: self.classes.select(F.col("row").alias(x), F.col("signature").alias(f"s_{x}"), F.col("n").alias(f"n_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("sizes", F.expr(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"))
        return both.select("a", "b", "s_a", "s_b", "sizes").mapInArrow(_distances, "a long, b long, d int, sizes boolean")

    def _per_chunk(self, rows: DataFrame, choose, schema: str) -> DataFrame:
        """What ``choose`` makes of the texts of ``rows``, in the chunks where they are kept."""
        rows = rows.join(self.classes.select("row", "chunk"), "row")
        return self.chunks.select("chunk", "row", "text").groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(choose, schema)

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b), those that are links. Texts are taken from their chunks, and moved only if they are in a pair."""
        pairs = self.ws.save(pairs, f"{name}-pairs")
        rows = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        texts = self.ws.save(self._per_chunk(rows, _chosen, "row long, text binary"), f"{name}-texts")
        side = lambda x: texts.select(F.col("row").alias(x), F.col("text").alias(f"t_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")
        return self.ws.save(both.mapInArrow(partial(_confirmed, width=self.width, hashing=self.hashing), "a long, b long"), f"{name}-links")

    def links(self) -> DataFrame:
        """Links between classes that connect all that similar sets connect."""
        ws = self.ws
        keyed = self.classes.select("row", "signature").mapInArrow(_keys, "key long, row long")
        centres = keyed.groupBy("key").agg(F.min("row").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        members = ws.save(keyed.join(centres, "key").where("row <> centre"), "members")

        stars = ws.save(self.with_distance(members.select(F.col("centre").alias("a"), F.col("row").alias("b")).distinct()), "stars")
        near = stars.where(F.col("sizes") & (F.col("d") <= MOST_DIFFERENT))
        best = near.groupBy("b").agg(F.expr("min(struct(d, a))").alias("m")).select(F.col("m.a").alias("a"), "b")
        first = self.confirm(best, "first")

        label = forest_roots(first, ws, "first")  # a centre is less than the one class that it is the closest of
        of = lambda df, x: df.join(label.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}")), x, "left").withColumn(f"r_{x}", F.coalesce(f"r_{x}", x))
        left = of(of(near.join(best, ["a", "b"], "left_anti"), "a"), "b").where("r_a <> r_b").select("a", "b")

        # members of a key that may be near a member of another component; pairs with the centre have been compared
        stars = stars.select(F.col("a").alias("centre"), F.col("b").alias("row"), "d")
        at = of(of(members, "centre"), "row").join(stars, ["centre", "row"]).withColumn("outside", F.col("r_row") != F.col("r_centre"))
        at = ws.save(at.select("key", "row", "r_row", "d", "outside"), "placed")
        limits = at.where("outside").groupBy("key").agg(F.min("d").alias("from"))
        size = at.join(limits, "key").where(F.col("outside") | (F.col("d") >= F.col("from") - MOST_DIFFERENT))
        several = size.groupBy("key").agg(F.min("r_row").alias("low"), F.max("r_row").alias("high")).where("low < high").select("key")
        facts = self.classes.select("row", "n", "signature")
        open_ = ws.save(size.join(several, "key").select("key", "row", "r_row", "d").join(self.classes.select("row", "n"), "row"), "open")
        # rows of a large key are dealt into blocks, and each two blocks meet in one place
        blocks = open_.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        dealt = open_.drop("n").join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        dealt = dealt.join(facts, "row").select("key", "i", "j", "row", "r_row", "d", "block", "n", "signature")
        met = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        # signatures meet first; the sets follow only of rows that have a candidate there
        able = ws.save(met(dealt).mapInArrow(_block_candidates, "key long, i int, j int, row long"), "able")
        width, hashing = self.width, self.hashing

        def chosen_sets(key: tuple, texts: pa.Table, rows: pa.Table) -> pa.Table:
            return _chosen_sets(key, texts, rows, width, hashing)

        sets = ws.save(self._per_chunk(able.select("row").distinct(), chosen_sets, "row long, shingles binary"), "able-sets")
        full = dealt.join(able, ["key", "i", "j", "row"]).join(sets, "row")
        more = met(full).select("key", "i", "j", "row", "r_row", "d", "block", "n", "signature", "shingles").mapInArrow(_block_links, "a long, b long")
        second = ws.save(self.confirm(left, "second").unionByName(more), "second")
        return label.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(second)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id, kept (doc_id is component_id), kept_row (one row a component).

    ``keep`` names further columns of ``docs`` to carry along; they come back under their own names with a leading ``in_``.
    """
    spark = docs.sparkSession
    ws, hashing = Workspace(spark, "neardup"), Hashing()
    chunks = chunk_table(docs, ws, {"doc_id": F.col(id_col), "text": F.col(text_col).cast("binary"), **{f"in_{c}": F.col(c) for c in keep if c != text_col}})
    kind = chunks.schema["doc_id"].dataType.simpleString()
    sets = chunks.select("row", "doc_id", "text", "chunk").mapInArrow(partial(_sets, width=shingle, hashing=hashing), f"row long, doc_id {kind}, chunk long, n long, h1 long, h2 long, signature binary")
    sets = ws.save(sets, "sets")
    named = sets.where("h1 is not null").groupBy("h1", "h2", "n").agg(F.expr("min(struct(row, chunk, signature))").alias("one"))
    classes = ws.save(named.select("h1", "h2", "n", "one.*"), "classes")
    links = _Join(ws, chunks, classes.select("row", "n", "chunk", "signature"), shingle, hashing).links()
    roots = components(links, ws, "all")

    placed = sets.select("row", "doc_id", "chunk", "n", "h1", "h2").join(classes.select("h1", "h2", "n", F.col("row").alias("class")), ["h1", "h2", "n"], "left")
    placed = placed.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class", "row"))
    placed = ws.save(placed.select("row", "doc_id", "chunk", "n", "root"), "placed-rows")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.expr("min(struct(doc_id is null, doc_id, row))").alias("first"))
    found = placed.join(least, "root").select("chunk", "row", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("first.row")).alias("kept_row"))
    found = ws.save(found, "found")
    ws.keep("found")
    if not keep:
        ws.drop("chunks")
        return found.drop("chunk", "row")
    # texts stay in their chunks, and what was found comes to them
    rest = [F.col("text").cast("string").alias(f"in_{c}") if c == text_col else F.col(f"in_{c}") for c in keep]
    schema = T.StructType([f for f in found.schema.fields if f.name not in ("chunk", "row")] + chunks.select(*rest).schema.fields)
    return chunks.select("chunk", "row", *rest).groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_attached, schema)


def dedup_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    return near_duplicates(docs, id_col, text_col, shingle=shingle).drop("kept_row")
