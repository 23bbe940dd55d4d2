"""Operator 12: edited texts against plain slices, fingerprints against a plain vote, tables against all pairs."""

import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.llm.words import mixed, word_hashes

SHAPE = "doc_id long, text string"


def plain_fingerprint(text):
    """A vote a bit and term, one at a time."""
    words = [int(h) for h in word_hashes([text.encode()], simhash._KEYS)[0]]
    one = lambda x: int(mixed(np.array([x % 2**64], np.uint64))[0])
    found = Counter(one(w) for w in words)
    found.update(one(a * int(simhash._KEYS.shingle[1]) + b) for a, b in zip(words, words[1:]))
    votes = [0] * simhash.BITS
    for term, n in found.items():
        weight = round(16 + 16 * math.log2(n))
        value = sum(one(term ^ int(simhash._KEYS.shingle[8 + k])) << 64 * k for k in range(simhash.BITS // 64))
        for b in range(simhash.BITS):
            votes[b] += weight if value >> b & 1 else -weight
    return sum((v > 0) << b for b, v in enumerate(votes)).to_bytes(simhash.BITS // 8, "little")


def brute(rows):
    prints = {}
    of = lambda t: prints.setdefault(t, simhash.fingerprints([t.encode()])[0])
    text = lambda r: r[1] or ""
    out = []
    for i, r in enumerate(rows):  # in descending order
        after = text(rows[(i + 1) % len(rows)])
        t, half = text(r), len(text(r)) // 2
        edited = t[: len(t) - half] + after[:half]
        bits = lambda a, b: bin(int.from_bytes(a) ^ int.from_bytes(b)).count("1")
        like = lambda a, b: max(0.0, math.cos(math.pi * bits(a, b) / simhash.BITS)) if a != b else 1.0
        near = sum(bits(of(t), of(text(x))) <= simhash.RADIUS for x in rows) - 1
        out.append((r[0], len(t), sha256(edited.encode()).hexdigest(), of(t).hex(), of(edited).hex(), like(of(t), of(edited)), like(of(t), of(after)), near))
    return out


def check(spark, rows):
    got = simhash.edits_and_neighbours(spark.createDataFrame(rows, SHAPE).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(sorted(rows, key=lambda r: -r[0])), key=str)


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    out = [None, "", " ", "é", "ab", "😀😀😀"]
    while len(out) < n:
        out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 5, 60, 300)))))
        if rng.random() < 0.4:
            out.append(out[-1])
        if rng.random() < 0.4:
            out.append(out[-1].replace("w7", "w8"))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 40, 150])
def test_equals_plain_slices_and_all_pairs(spark, n):
    rng = random.Random(n)
    rows = list(zip(rng.sample(range(-500, 5000), n), rng.sample(texts(rng, n + 10), n), strict=True))
    check(spark, rows)


def test_plain_votes():
    rng = random.Random(1)
    for text in ["", "a", "a a a b", "x y x y x y z", " ".join(rng.choice("abcdefg") for _ in range(500))]:
        assert simhash.fingerprints([text.encode()]) == [plain_fingerprint(text)]
    slow, simhash._SLICE = simhash._SLICE, 7
    try:
        text = " ".join(rng.choice("abcdefghijk") for _ in range(300))
        assert simhash.fingerprints([text.encode()]) == [plain_fingerprint(text)]
    finally:
        simhash._SLICE = slow


def test_ties_nulls_and_repeats(spark):
    """Rows of one id are ordered by a hash of the text; whatever it is, each row is followed by one of them or of the next id."""
    rows = [(None, "null id one"), (None, None), (3, "a b c d"), (3, "e f g h"), (3, "a b c d"), (3, "a b c d"), (1, "x y"), (9, "top of all " * 40_000)]
    got = simhash.edits_and_neighbours(spark.createDataFrame(rows, SHAPE).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    same = [r for r in got if r.doc_id == 3 and r.fingerprint == simhash.fingerprints([b"a b c d"])[0].hex()]
    assert len(same) == 3 and {r.n_near for r in same} == {2}
    top = next(r for r in got if r.doc_id == 9)
    text = rows[-1][1]
    assert top.edited_sha256 in {sha256((text[: len(text) - len(text) // 2] + t).encode()).hexdigest() for t in ("a b c d", "e f g h")}


def test_empty_table_and_clashing_columns(spark):
    assert simhash.edits_and_neighbours(spark.createDataFrame([], SHAPE)).count() == 0
    rows = [(i, f"text number {i}") for i in range(20)]
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("z") for c in ("id", "none", "down", "tie", "parts", "part", "other", "own", "fingerprint", "n", "near", "table", "key")})
    assert sorted(map(tuple, simhash.edits_and_neighbours(df).collect())) == sorted(brute(rows[::-1]))


@pytest.mark.parametrize(("radius", "blocks"), [(3, 4), (2, 4), (1, 2), (3, 8), (0, 1)])
def test_tables_find_all_pairs_once(spark, monkeypatch, radius, blocks):
    """Fingerprints in clusters around centres, with keys of more rows than a block has."""
    monkeypatch.setattr(simhash, "_ROWS", 9)
    rng = random.Random(radius)
    prints = []
    for _ in range(6):
        centre = rng.getrandbits(simhash.BITS)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, radius)):
                x ^= 1 << rng.randrange(simhash.BITS)
            prints += [x] * rng.choice((1, 1, 3))
    names = [x.to_bytes(simhash.BITS // 8, "little").hex() for x in prints]
    got = {r.fingerprint: r.n_near for r in simhash.near_counts(spark.createDataFrame([(n,) for n in names], "fingerprint string"), radius, blocks).collect()}
    assert got == {n: sum((x ^ y).bit_count() <= radius for y in prints) - 1 for n, x in zip(names, prints, strict=True)}


def test_likeness_estimates_the_share_that_stays():
    rng = random.Random(2)
    near, apart = [], []
    for _ in range(60):
        text, other = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(2))
        a, b, c = simhash.fingerprints([t.encode() for t in (text, simhash.edited_text(text, other), other)])
        near.append(simhash.likeness(a, b))
        apart.append(simhash.likeness(a, c))
    assert abs(sum(near) / 60 - 0.5) < 0.06 and sum(apart) / 60 < 0.15 and simhash.likeness(a, a) == 1.0
