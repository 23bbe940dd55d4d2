"""Operator 6, exact top-k by inner product over norm-sorted, SVD-rotated vectors.

Vectors become integers. They are rotated onto the right singular vectors of the whole table (from the sum of their outer
products, d x d numbers), so that the first places hold most of their length, and cut into blocks by descending length. A stated
query set meets them in blocks: a task has some queries and a share of the blocks, goes through these from the longest vectors
on, stops where |q| * |v| cannot reach the scores it has, and within a block computes partial sums over the first places only; by
Cauchy-Schwarz the rest adds at most the product of the residual lengths, and pairs that can't reach the k-th score so far are
dropped. Scores of all others are exact. Each task's best k of a query are merged at the end.

Every row stands for itself: rows that share an id are candidates each, also of one another, and queries each, with ranks of their own.

Nulls and edge cases: vectors that are null, or hold a null or a non-finite component, and vectors without an id take no part; shorter vectors count as padded with zeros; ties go to the smaller id; a
query with fewer than k candidates has fewer rows; components and scores beyond 64 bits are cut off there. An empty table gives an empty result.
Ids are integers. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, shuffle_partitions

K = 5
QUERY_EVERY = 50
SCALE = 256
BLOCK = 1024
QUERIES = 2048
#: Bytes of vectors that a task holds besides its queries.
SHARE_BYTES = 32 << 20
_EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, id, v (whole numbers as doubles), norm2."""
    number = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = table.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), number.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A row for each list, padded with zeros."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]))
    out = np.zeros((len(lists), width))
    if len(values):
        row = np.repeat(np.arange(len(lists)), ends)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(ends) - ends, ends)] = values
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, largest first. The driver gets ``width`` squared sums."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.schema.names == ["v"]:
                m = _matrix(batch.column(0), width)
                total += m.T @ m
            else:
                for data in batch.column(0):
                    total += np.frombuffer(data.as_py(), "<f8").reshape(width, width)
        yield pa.RecordBatch.from_pydict({"x": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    # one matrix a task, then few sums of them: the driver gets eight
    some = vectors.select("v").mapInArrow(products, "x binary").repartition(8).mapInArrow(products, "x binary").collect()
    gram = sum((np.frombuffer(r.x, "<f8").reshape(width, width) for r in some), np.zeros((width, width)))
    _, basis = np.linalg.eigh(gram)
    return np.ascontiguousarray(basis[:, ::-1])


def _names(rows: pa.RecordBatch | pa.Table) -> pa.Array:
    """Ids and numbers of the rows, by two."""
    two = np.stack([rows.column("id").to_numpy(), rows.column("row").to_numpy()], axis=1)
    return pa.array([two.astype("<i8").tobytes()], pa.binary())


def _blocks(size: int, width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), size):
                some = batch.slice(i, size)
                m = _matrix(some.column(2), width)
                yield pa.RecordBatch.from_pydict({"top": pa.array([math.sqrt(float((m * m).sum(axis=1).max()))]), "ids": _names(some), "data": pa.array([m.astype("<f8").tobytes()], pa.binary())})

    return cut


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row, as 64-bit integers."""
    if len(q) and max(1.0, np.abs(q).max()) * max(1.0, np.abs(v).max()) * q.shape[1] >= _EXACT:
        most = (1 << 63) - 1
        return np.array([max(-most - 1, min(most, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(q, v, strict=True)], np.int64)
    return np.einsum("ij,ij->i", q, v).astype(np.int64)


class Best:
    """The best ``k`` of each query so far: ``least`` is the score to reach, minus infinity while there are fewer."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query = self.id = self.score = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """``ids`` of the candidates; ties go to the smaller."""
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, ~score, query))
        query, ids, score = query[order], ids[order], score[order]
        starts = np.searchsorted(query, query)
        rank = np.arange(len(query)) - starts
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        keep = rank < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]


def search(q_rows: np.ndarray, q: np.ndarray, blocks: list[tuple[float, np.ndarray, np.ndarray]], basis: np.ndarray, k: int) -> Best:
    """The best ``k`` of ``blocks`` (length of the longest, ids with row numbers, vectors) for each query, its own row left out."""
    best = Best(len(q), k)
    first = max(1, basis.shape[0] // 4)
    length = np.sqrt((q * q).sum(axis=1))
    head = q @ basis[:, :first]
    rest = np.sqrt(np.maximum(0, length**2 - (head * head).sum(axis=1)))
    for top, names, v in sorted(blocks, key=lambda b: -b[0]):
        ids, rows = names.T
        slack = 1e-9 * length * top + 1e-6  # rounding never drops a pair
        (open_,) = np.nonzero(length * top + slack >= best.least)
        if not len(open_):
            break
        v_head = v @ basis[:, :first]
        v_rest = np.sqrt(np.maximum(0, (v * v).sum(axis=1) - (v_head * v_head).sum(axis=1)))
        least = best.least[open_]
        bound = head[open_] @ v_head.T + rest[open_, None] * v_rest + slack[open_, None]
        possible = (bound >= least[:, None]) & (q_rows[open_, None] != rows)
        if np.isinf(least).any() or possible.mean() > 0.1:
            score = q[open_] @ v.T
            score[q_rows[open_, None] == rows] = -np.inf
            if score.shape[1] > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            possible &= score + slack[open_, None] >= least[:, None]
        at, i = np.nonzero(possible)
        best.add(open_[at], ids[i], _exact(q[open_[at]], v[i]))
    return best


def top_k(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query: Column | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; the queries are the rows that fulfil ``query``, a condition on ``id``."""
    spark = table.sparkSession
    ws = Workspace(spark, "topk")
    query = F.col("id") % QUERY_EVERY == 0 if query is None else query
    vectors = ws.save(vectors_of(table, id_col, vector_col), "vectors")
    n, width, n_queries = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if(query)).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    basis = spark.sparkContext.broadcast(rotation(vectors, width))

    kinds = "top double, ids binary, data binary"
    shares = max(shuffle_partitions(spark), -(-n * width * 8 // SHARE_BYTES))
    groups = -(-n_queries // QUERIES)
    longest_first = vectors.repartitionByRange(F.desc("norm2")).sortWithinPartitions(F.desc("norm2"))
    blocks = ws.save(longest_first.select("row", "id", "v").mapInArrow(_blocks(BLOCK, width), kinds).withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares))), "blocks")
    asked = vectors.where(query).select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("set"))

    def gathered(key: tuple, rows: pa.Table) -> pa.Table:
        m = _matrix(rows.column("v").combine_chunks(), width)
        return pa.table({"set": pa.array([key[0].as_py()], pa.int64()), "ids": _names(rows), "data": pa.array([m.astype("<f8").tobytes()], pa.binary())})

    # the stated query set, in sets of some thousand, goes to every share of the blocks, and the blocks to every set
    sets = ws.save(asked.groupBy("set").applyInArrow(gathered, "set long, ids binary, data binary"), "sets")
    sets = sets.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("share", F.col("share").cast("long"))
    blocks = blocks.withColumn("share", F.col("share").cast("long")).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("set", F.col("set").cast("long"))

    def array(data, kind: str) -> np.ndarray:
        return np.frombuffer(data.as_py(), kind)

    def meet(key: tuple, queries: pa.Table, some: pa.Table) -> pa.Table:
        best, asking = Best(0, k), np.zeros((0, 2), np.int64)
        pairs = lambda data: array(data, "<i8").reshape(-1, 2)
        if queries.num_rows and some.num_rows:
            asking, q = pairs(queries["ids"][0]), array(queries["data"][0], "<f8").reshape(-1, width)
            best = search(asking[:, 1], q, [(t.as_py(), pairs(i), array(d, "<f8").reshape(-1, width)) for t, i, d in zip(some["top"], some["ids"], some["data"], strict=True)], basis.value, k)
        names = asking[best.query]
        return pa.table({"query_id": pa.array(names[:, 0]), "row": pa.array(names[:, 1]), "vec_id": pa.array(best.id, pa.int64()), "score": pa.array(best.score, pa.int64())})

    found = sets.groupBy("set", "share").cogroup(blocks.groupBy("set", "share")).applyInArrow(meet, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
