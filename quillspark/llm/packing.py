"""Operator 4, best-fit packing by bin completion.

A document is its ids and an end id, cut into pieces of ``capacity`` only where it is longer. Packing depends on lengths alone,
so the driver gets a histogram of at most ``capacity`` rows, whatever the corpus, and solves that: around the largest length left
it enumerates undominated fillings, branches over them, prunes by the waste that a better packing may still have, and starts from
the best-fit-decreasing packing as incumbent. The answer is a list of patterns with the number of their uses. While a lower bound is
not met, the search goes on in rounds (``ROUNDS``) that follow more and more of the branches; the last follows all of them, and every
number of uses of a pattern, so that what it ends with is the fewest. A round stops after ``EFFORT`` combinations; only then, with the
bound still not met, may there be a better packing than the one given (bin packing has no fast exact way). Pieces find their
place by their rank among the pieces of their length: a running number in the task that cut them, plus the pieces of that length
in earlier tasks, as a distributed prefix sum. No piece is compared with another, and no group of them meets in a task.

Nulls and edge cases: a null text is empty, which leaves the end id alone; ids may be null or repeated, each row is a document of
its own (``row`` tells rows of one id apart); long texts are cut, never shortened; an empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import encoder_of
from .workspace import Workspace

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Combinations of lengths that a round of the search tries before it ends with the best packing so far.
EFFORT = 60_000
#: What a round follows: lengths that may come next in a bin, fillings with waste, combinations for the fillings of one bin, and whether
#: a pattern is also used fewer times than it could be. None is all.
ROUNDS = ((24, 8, 1_000, False), (96, 32, 10_000, False), (None, None, None, True))

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), longest first


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Each length, longest first, goes to the fullest bins that it fits; equal bins are handled at once."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    free: list[int] = []  # sorted keys of open_bins

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in open_bins:
                insort(free, room)
            open_bins.setdefault(room, []).append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(free, length)
            room = free[at] if at < len(free) else capacity
            pattern, n = open_bins[room].pop() if at < len(free) else ((), left)
            if at < len(free) and not open_bins[room]:
                del open_bins[room]
                free.pop(at)
            each = min(room // length, left)
            uses = min(n, left // each) if pattern else left // each
            put(room - each * length, (*pattern, (length, each)), uses)
            if pattern:
                put(room, pattern, n - uses)
            left -= uses * each
    out: dict[Pattern, int] = {}
    for same in open_bins.values():
        for pattern, n in same:
            out[pattern] = out.get(pattern, 0) + n
    return out


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound. For each limit: lengths over half the capacity need bins of their own; those of at least the limit that are
    not, need what room is left beside the former, where it is large enough to hold them at all, and bins beyond it."""
    if not counts:
        return 0
    n = np.zeros(capacity + 2, np.int64)
    for k, c in counts.items():
        n[k] += c
    size = n * np.arange(capacity + 2)
    n_to, size_to = (np.concatenate([[0], np.cumsum(x)]) for x in (n, size))  # totals of lengths below
    half = capacity // 2 + 1  # the least length over half
    limits = np.arange(1, capacity // 2 + 1)
    alone = n_to[-1] - n_to[capacity - limits + 1]
    pairs, pair_size = n_to[capacity - limits + 1] - n_to[half], size_to[capacity - limits + 1] - size_to[half]
    small = size_to[half] - size_to[limits]
    bounds = alone + pairs + np.maximum(0, -(-(small - (pairs * capacity - pair_size)) // capacity))
    return int(max(bounds.max(initial=0), n_to[-1] - n_to[half], -(-int(size.sum()) // capacity)))


class _Search:
    def __init__(self, counts: dict[int, int], capacity: int, nexts: int | None, wasteful: int | None, tries: int | None, fewer: bool):
        self.capacity = capacity
        self.counts = dict(counts)
        self.nexts, self.wasteful, self.tries, self.fewer = nexts, wasteful, tries, fewer
        self.effort = EFFORT
        self.lengths = sorted(k for k, n in counts.items() if n)

    def take(self, pattern: Pattern, uses: int) -> None:
        for k, n in pattern:
            self.counts[k] -= n * uses
            if not self.counts[k]:
                del self.lengths[bisect_left(self.lengths, k)]

    def give(self, pattern: Pattern, uses: int) -> None:
        for k, n in pattern:
            if not self.counts[k]:
                insort(self.lengths, k)
            self.counts[k] += n * uses

    def _below(self, room: int) -> int:
        """The largest length left that is at most ``room``, or 0."""
        at = bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else 0

    def _dominated(self, first: int, filling: list[int], slack: int) -> bool:
        """Whether one longer document could stand for one or two of the filling, so that another filling is at least as good."""
        kinds = sorted(set(filling))
        self.effort -= len(kinds) ** 2 // 64
        spare = lambda k: k and self.counts[k] > filling.count(k) + (k == first)
        for i, a in enumerate(kinds):
            if (x := self._below(a + slack)) > a and spare(x):
                return True
            for b in kinds[i if filling.count(a) > 1 else i + 1 :]:
                if (x := self._below(a + b + slack)) >= a + b and spare(x):
                    return True
        return False

    def fillings(self) -> Iterator[tuple[Pattern, int]]:
        """Bins around the largest length left and their uses: those without waste as they are found, then undominated others by waste."""
        first = self.lengths[-1]
        others: list[tuple[int, Pattern]] = []
        tries = 0
        found = False
        stack: list[tuple[int, int, list[int]]] = [(self.capacity - first, first, [])]
        while stack and (self.tries is None or tries < self.tries) and self.effort > 0:
            room, most, chosen = stack.pop()
            tries += 1
            self.effort -= 1
            used = lambda k: chosen.count(k) + (k == first)  # noqa: B023, E731
            if room == 0 or (room <= most and self.counts.get(room, 0) > used(room)):
                filling = [*chosen, room] if room else chosen
                if not self._dominated(first, filling, 0):
                    found = True
                    yield from self._uses(self._pattern(first, filling))
                if not room or self.nexts is not None:
                    continue
                most = room - 1
            at = bisect_right(self.lengths, min(room, most)) - 1
            more = []
            while at >= 0 and (self.nexts is None or len(more) < self.nexts):
                k = self.lengths[at]
                if self.counts[k] > used(k):
                    more.append((room - k, k, [*chosen, k]))
                at -= 1
            self.effort -= (len(more) + len(chosen)) // 8
            stack += reversed(more)
            if not more and not self._fits(first, room, chosen) and not self._dominated(first, chosen, room):
                others.append((room, self._pattern(first, chosen)))
        if not others and not found:
            others.append((0, self._greedy(first)))
        for _, p in sorted(others)[: self.wasteful]:
            yield from self._uses(p)

    def _fits(self, first: int, room: int, chosen: list[int]) -> bool:
        """Whether a length that is left still fits."""
        return any(self.counts[k] > chosen.count(k) + (k == first) for k in self.lengths[: bisect_right(self.lengths, room)])

    def _uses(self, pattern: Pattern) -> Iterator[tuple[Pattern, int]]:
        most = min(self.counts[k] // n for k, n in pattern)
        yield from ((pattern, n) for n in range(most, 0 if self.fewer else most - 1, -1))

    def _greedy(self, first: int) -> Pattern:
        """The filling that takes the longest that fits, again and again."""
        room, chosen, most = self.capacity - first, [], first
        while k := self._below(min(room, most)):
            if self.counts[k] > chosen.count(k) + (k == first):
                chosen.append(k)
                room -= k
            else:
                most = k - 1
        return self._pattern(first, chosen)

    @staticmethod
    def _pattern(first: int, filling: list[int]) -> Pattern:
        every = [first, *filling]
        return tuple((k, every.count(k)) for k in sorted(set(every), reverse=True))


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and uses that pack ``counts`` (length: how many) into as few bins as the search finds."""
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("lengths must be between 1 and the capacity")
    best, bound = best_fit_decreasing(counts, capacity), least_bins(counts, capacity)
    for limits in ROUNDS:
        if sum(best.values()) > bound:
            best = _better(_Search(counts, capacity, *limits), best, bound)
    return list(best.items())


def _better(search: _Search, best: dict[Pattern, int], bound: int) -> dict[Pattern, int]:
    """The best packing that a round finds, or ``best`` if it finds none with fewer bins."""
    capacity, bins, total = search.capacity, sum(best.values()), sum(k * n for k, n in search.counts.items())
    path: list[tuple[Pattern, int, int]] = []
    options = [search.fillings()]
    wasted, full = 0, False
    while options and (search.effort > 0 or not full):
        pattern, uses = next(options[-1], (None, 0))
        if pattern is None:
            options.pop()
            if path:
                last, uses, waste = path.pop()
                search.give(last, uses)
                wasted -= waste
            continue
        waste = uses * (capacity - sum(k * n for k, n in pattern))
        if wasted + waste > (bins - 1) * capacity - total:
            full = full or search.effort <= 0  # no packing this way is better than the incumbent
            continue
        search.take(pattern, uses)
        path.append((pattern, uses, waste))
        wasted += waste
        if search.lengths:
            options.append(search.fillings())
            continue
        full, bins, best = True, sum(u for _, u, _ in path), {}
        for p, u, _ in path:
            best[p] = best.get(p, 0) + u
        if bins == bound:
            break
        options.append(iter(()))  # goes back over the last choice
    return best


class Plan:
    """Where the pieces of each length go, as sorted intervals of their ranks."""

    SHIFT = 44

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows, given, sequence = [], {}, 0
        for pattern, uses in patterns:
            offset = 0
            for length, each in pattern:
                rank = given.get(length, 0)
                rows.append((length << self.SHIFT | rank, rank, sequence, offset, each))
                given[length] = rank + each * uses
                offset += length * each
            sequence += uses
        rows.sort()
        self.key, self.rank, self.sequence, self.offset, self.each = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << self.SHIFT) | rank, "right") - 1
        n = rank - self.rank[at]
        return self.sequence[at] + n // self.each[at], self.offset[at] + n % self.each[at] * length


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int, with_ids: bool, added_tokens: bool = False) -> DataFrame:
    """A row a piece, with the task that cut it and its number there among the pieces of its length."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, added_tokens)
        part, row, seen = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            texts = (t for i in range(0, len(batch), 256) for t in batch.column(1).slice(i, 256).to_pylist())
            ids = batch.column(0)
            out: list[tuple] = []
            size = 0

            def table(out=out, ids=ids):
                at, piece, start, length, crc, rank, rows, tokens = zip(*out, strict=True)
                columns = [ids.take(pa.array(at)), pa.array(rows, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64())]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    columns, names = [*columns, pa.array(tokens, pa.binary())], [*names, "ids"]
                return pa.RecordBatch.from_arrays(columns, names)

            for at, got in enumerate(encoder.encode(texts)):
                all_ids = np.frombuffer(got + end, encoder.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(all_ids), capacity)):
                    some = all_ids[start : start + capacity]
                    raw = some.tobytes()
                    out.append((at, piece, start, len(some), zlib.crc32(raw), int(seen[len(some)]), row, raw if with_ids else b""))
                    seen[len(some)] += 1
                    size += len(raw)
                row += 1
                if size > 16 << 20:
                    yield table(out)
                    out.clear()
                    size = 0
            if out:
                yield table(out)

    schema = f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """A row a piece: doc_id, row, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves as little-endian
    unsigned 32-bit integers with ``with_ids``. Sorted by (sequence_id, offset), the ids of a sequence stand in a row.

    ``row`` numbers the documents: unique with ``doc_id`` unless whole rows repeat, and then too.
    With ``added_tokens``, strings such as <|endoftext|> become their tokens, as in the library; else they are ordinary text.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "pack")
    cut = ws.save(pieces(docs, id_col, text_col, vocabulary, end_id, capacity, with_ids, added_tokens), "pieces")
    counts = ws.save(cut.groupBy("part", "length").count(), "counts")
    histogram = dict(counts.groupBy("length").agg(F.sum("count")).collect())  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(Plan(pack_lengths(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(starts.hint("merge"), ["part", "length"])  # a row for each task and length: not to be broadcast
    columns = ["doc_id", "row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    ranked = ranked.select(*(c for c in columns if c != "row"), (F.col("part").cast("long") * (1 << 40) + F.col("row")).alias("row"), "rank", "before")
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
