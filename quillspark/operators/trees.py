"""Trees of sentences, over flat buffers: many sentences at once, each given as the place of every token's head.

Heads are followed by pointer doubling, so the deepest tree takes a logarithm of its depth in steps; what is no tree is an error.
Spans are joined along the tree from the bottom up. The border between two neighbouring tokens is decided just once, at their lowest
common ancestor: below it the two are in different subtrees, and above it both spans can only have grown. So borders are taken
deepest ancestor first, from the left within an ancestor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Trees:
    """``sizes`` of sentences, and the heads of all their tokens, one sentence after the other."""

    def __init__(self, sizes: np.ndarray, heads: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        if ((heads < 0) | (heads >= np.repeat(self.sizes, self.sizes))).any():
            raise ValueError("a head must be a token of its sentence")
        self.sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)
        parent = self.starts[self.sentence] + heads.astype(np.int64)
        root = parent == np.arange(n)
        counts = np.bincount(self.sentence[root], minlength=len(self.sizes))
        if (counts[self.sizes > 0] != 1).any():
            raise ValueError(f"a sentence must have one root, not {counts[(self.sizes > 0) & (counts != 1)][0]}")
        #: The token 1, 2, 4, ... heads up from each, and no further than the root.
        self.up = [parent]
        self.depth = (~root).astype(np.int64)
        while not root[self.up[-1]].all():
            if 1 << len(self.up) > 2 * n:
                raise ValueError("the heads of a sentence go round in a circle")
            above = self.up[-1]
            self.depth = self.depth + self.depth[above]
            self.up.append(above[above])

    def heights(self) -> np.ndarray:
        """Tokens on each sentence's longest path from the root down; 0 for no token."""
        out = np.zeros(len(self.sizes), np.int64)
        np.maximum.at(out, self.sentence, self.depth + 1)
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lowest common ancestors."""
        a, b = np.where(self.depth[a] >= self.depth[b], a, b), np.where(self.depth[a] >= self.depth[b], b, a)
        ahead = self.depth[a] - self.depth[b]
        for k, above in enumerate(self.up):
            a = np.where(ahead >> k & 1, above[a], a)
        for above in reversed(self.up):
            apart = above[a] != above[b]
            a, b = np.where(apart, above[a], a), np.where(apart, above[b], b)
        return np.where(a == b, a, self.up[0][a])

    def begins(self, lengths: np.ndarray, most: int | None) -> np.ndarray:
        """Whether a span begins with a token, spans being joined along the tree as long as both fit. ``lengths`` are those of the tokens."""
        n = len(lengths)
        new = np.ones(n, bool)
        # a sentence that fits is one span, whatever its tree
        fits = np.ones(len(self.sizes), bool) if most is None else np.bincount(self.sentence, weights=lengths, minlength=len(self.sizes)) <= most
        inner = np.arange(n) != self.starts[self.sentence] if n else np.zeros(0, bool)
        whole = fits[self.sentence]
        new[inner & whole] = False
        (right,) = np.nonzero(inner & ~whole)
        order = np.lexsort((right, -self.depth[self._common(right - 1, right)]))
        at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        # of the span that ends, or begins, at a place: where it begins, or ends
        begin_of, end_of = list(range(-1, n)), list(range(1, n + 1))
        for p in right[order].tolist():
            begin, end = begin_of[p], end_of[p]
            if at[end] - at[begin] <= most:
                new[p] = False
                end_of[begin], begin_of[end] = end, begin
        return new


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and all values of a list column."""
    values = column.flatten()
    if column.null_count or values.null_count:
        raise ValueError("a head must be a token of its sentence")
    return pc.list_value_length(column).to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False)


def begins_of(lengths: pa.Array, heads: pa.Array, most: int | None) -> pa.Array:
    """For each sentence (a list of lengths and one of heads), the places where its spans begin."""
    (sizes, flat), (_, heads_flat) = _lists(lengths), _lists(heads)
    trees = Trees(sizes, heads_flat)
    new = trees.begins(flat, most)
    places = np.arange(len(flat)) - trees.starts[trees.sentence] if len(flat) else flat
    ends = np.cumsum(np.bincount(trees.sentence[new], minlength=len(sizes))) if len(flat) else np.zeros(len(sizes), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(places[new], pa.int32()))


def heights_of(heads: pa.Array) -> pa.Array:
    return pa.array(Trees(*_lists(heads)).heights(), pa.int32())


# Folds of texts in order, each given by its length, or by ``~`` of it where nothing can be joined to it from behind.


def _sizes(lengths: np.ndarray) -> np.ndarray:
    return np.where(lengths < 0, ~lengths, lengths)


def _begins(lengths: list[int], most: int, opened: int) -> list[int]:
    """The places of texts that are not joined to what is before them; ``opened`` is how long that is before the first (0: nothing)."""
    out, long = [], opened or most + 1
    for i, n in enumerate(lengths):
        size = n if n >= 0 else ~n
        long += size
        if long > most:
            out.append(i)
            long = size
        if n < 0:
            long = most + 1
    return out


def spans_of(lengths: pa.Array, opened: pa.Array, most: int) -> pa.Array:
    """For each list of ``lengths``, the spans of texts joined from the left as long as both fit, as ``folds.PIECES``."""
    sizes, flat = _lists(lengths)
    starts, found = np.cumsum(sizes) - sizes, []
    for start, size, long in zip(starts.tolist(), sizes.tolist(), opened.to_pylist(), strict=True):
        found.append(np.array(_begins(flat[start : start + size].tolist(), most, long), np.int64) + start)
    first = np.concatenate([np.zeros(0, np.int64), *found])
    row = np.repeat(np.arange(len(sizes)), [len(f) for f in found])
    ends = np.concatenate([[0], np.cumsum(_sizes(flat), dtype=np.int64)])
    base = ends[starts]
    last = np.append(first[1:], 0)
    closing = np.append(row[1:] != row[:-1], True)[: len(row)]
    last = np.where(closing, (starts + sizes)[row], last[: len(row)])
    as_int = lambda x: pa.array(x, pa.int32())
    fields = [as_int(first - starts[row]), as_int(ends[first] - base[row]), as_int(ends[last] - base[row]), as_int(np.zeros(len(first), np.int32))]
    return pa.ListArray.from_arrays(as_int(np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])), pa.StructArray.from_arrays(fields, ["i", "at", "end", "cut"]))


def spans_of_lines(lengths: pa.Array, counts: pa.Array, lines: pa.Array, most: int) -> pa.Array:
    """As ``spans_of``, of spans of sentences in order: how many each has, and its line. Nothing is joined over a line's end."""
    sizes, flat = _lists(lengths)
    (n, counts_flat), (_, of_line) = _lists(counts), _lists(lines)
    row = np.repeat(np.arange(len(n)), n)
    closing = np.append((of_line[1:] != of_line[:-1]) | (row[1:] != row[:-1]), True)[: len(row)]
    last = np.cumsum(counts_flat)[closing] - 1
    flat = flat.astype(np.int32)
    flat[np.unique(last[last >= 0])] ^= -1
    places = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return spans_of(pa.ListArray.from_arrays(places, pa.array(flat)), pa.array(np.zeros(len(sizes), np.int32)), most)


def _ends(lengths: list[int], most: int, opens: range) -> list[tuple[int, int]]:
    places = _begins(lengths, most, 0)
    count = {place: k for k, place in enumerate(places)}
    whole = int(_sizes(np.array(lengths[places[-1] :])).sum()) if places else 0
    open_at_end = 0 if not lengths or lengths[-1] < 0 or whole > most else whole
    out = []
    for long in opens:
        n, long = 0, long or most + 1
        for i, length in enumerate(lengths):
            size = length if length >= 0 else ~length
            long += size
            if long > most:
                if i in count:  # from here on it is as if nothing had been open
                    n += len(places) - count[i]
                    long = open_at_end
                    break
                n, long = n + 1, size
            if length < 0:
                long = most + 1
        else:
            long = 0 if long > most else long
        out.append((long, n))
    return out


def ends_of(lengths: pa.Array, first: pa.Array, most: int) -> pa.Array:
    """How such folds end, for each length from 0 to ``most`` that may be open before: ``open``, how long the last span is that is open (0: none), and ``n``, how many began.

    Nothing is open before a list that is the ``first``. Folds that differ in what was open soon begin a span at the same text, and are the same from there.
    """
    found = [_ends(texts, most, range(1 if is_first else most + 1)) for texts, is_first in zip(lengths.to_pylist(), first.to_pylist(), strict=True)]
    sizes = np.array([0, *map(len, found)]).cumsum()
    flat = np.array([pair for pairs in found for pair in pairs], np.int32).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["open", "n"]))
