"""Words of many texts as arrays of 64-bit hashes, and hashes of runs of words, for tasks.

All hashes are keyed, and the keys are drawn at random for each run of an operator (``Hashing``), so that no one can make words
that collide. A word of at most 64 bytes is hashed twice to 32 bits by multilinear hashing: its length and its 32-bit pieces times
64-bit keys, summed, of which the upper half counts. For any two different words, whatever they are, just one in 2^64 keys gives
both the same 64 bits. Longer words get a keyed BLAKE2. A run of words is hashed by joining the hashes of its halves in the same
manner, with keys of their own for each length. Hashes are the same in all tasks of a run and differ from run to run.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

#: Words are runs of other bytes than these.
BLANKS = b" \t\n\r\x0b\x0c"
#: Bytes that are hashed at once, but for a longer word.
_SLICE = 2 << 20
_LONG = 64
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
#: Masks of the first 0 to 8 bytes of eight, little-endian.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashing:
    """The keys of a run. The driver draws them, and they go to the tasks with the functions that use them."""

    def __init__(self, seed: bytes | None = None):
        self.seed = seed or os.urandom(32)
        rng = np.random.Generator(np.random.PCG64(int.from_bytes(self.seed, "little")))
        keys = lambda *shape: rng.integers(0, (1 << 64) - 1, shape, np.uint64, endpoint=True)
        self.word = keys(2, 2 + _LONG // 4)
        self.pair = keys(2, 2, 16, 2, 5)  # by salt, doubling or joining, number of doublings
        self.shingle = keys(64) | np.uint64(1)
        self.sets = keys(2)

    def words(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each word; ``buffer`` has eight bytes to spare at its end."""
        lengths = ends - starts
        one, two = (k[0] + k[1] * lengths.astype(np.uint64) for k in self.word)
        eights = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
        (open_,) = np.nonzero(lengths <= _LONG)
        for at in range(0, _LONG, 8):
            if at:
                open_ = open_[lengths[open_] > at]
            if not len(open_):
                break
            next_ = eights[starts[open_] + at] & _FIRST_BYTES[np.minimum(lengths[open_] - at, 8)]
            low, high = next_ & _LOW, next_ >> _HALF
            for total, k in ((one, self.word[0]), (two, self.word[1])):
                total[open_] += k[2 + at // 4] * low + k[3 + at // 4] * high
        out = (one & ~_LOW) | (two >> _HALF)
        for i in np.flatnonzero(lengths > _LONG).tolist():
            out[i] = int.from_bytes(blake2b(buffer[starts[i] : ends[i]], digest_size=8, key=self.seed).digest(), "little")
        return out

    def joined(self, a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The hash of two neighbouring runs, from theirs; the order counts."""
        parts = (a & _LOW, a >> _HALF, b & _LOW, b >> _HALF)
        out = []
        for k in keys:
            total = parts[0] * k[1]
            for i in (1, 2, 3):
                total += parts[i] * k[i + 1]
            out.append(total + k[0])
        return (out[0] & ~_LOW) | (out[1] >> _HALF)

    def windows(self, values: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
        """The hash of every ``length`` consecutive values, put together from those of runs of 1, 2, 4, ... values; two ``salt``s, 0 and 1, give independent hashes."""
        n = len(values) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, done, run, size, turn = None, 0, values, 1, 0
        while True:
            if length & size:
                part = run[done : done + n]
                out = part if out is None else self.joined(out, part, self.pair[salt, 0, turn])
                done += size
            if done == length:
                return mixed(out)
            run, size, turn = self.joined(run[:-size], run[size:], self.pair[salt, 1, turn]), size * 2, turn + 1


def _hashed(buffer: bytes, hashing: Hashing) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and hashes of the words of ``buffer``, in slices that end between words."""
    every = np.frombuffer(buffer + bytes(8), np.uint8)
    at, size = 0, len(buffer)
    while at < size:
        end = min(size, at + _SLICE)
        while end < size and not _IS_BLANK[every[end]]:
            ahead = _IS_BLANK[every[end : min(size, end + _SLICE)]]
            end += int(ahead.argmax()) if ahead.any() else len(ahead)
        word = np.concatenate([[False], ~_IS_BLANK[every[at:end]], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        yield at + edges[::2], hashing.words(every[at : end + 8], edges[::2], edges[1::2])
        at = end


def word_hashes(texts: Iterable[bytes], hashing: Hashing) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, one text after the other, and each text's number of words."""
    hashes, numbers = [], []
    todo: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if todo:
            limits = np.cumsum([len(t) + 1 for t in todo])
            counts = np.zeros(len(todo), np.int64)
            for starts, got in _hashed(b"\n".join(todo), hashing):
                hashes.append(got)
                counts += np.bincount(np.searchsorted(limits, starts, "right"), minlength=len(todo))
            numbers.append(counts)
            todo.clear()
            size = 0

    for t in texts:
        todo.append(t)
        size += len(t)
        if size >= _SLICE:
            flush()
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
