"""Operator 5 against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import repeats, words


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def texts_of(rng, n, vocabulary, passages):
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))))
        out.append(rng.choice([" ", "\n", "\t  "]).join(parts))
    return out


@pytest.mark.parametrize("window", [35, 4, 1])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    vocabulary = [f"w{i}é" for i in range(500)] + ["\xa0", "x"]
    passages = [" ".join(rng.choices(vocabulary, k=k)) for k in (3, 34, 35, 36, 60, 200)] + ["a " * 80]
    texts = [None, "", "  ", *texts_of(rng, 80, vocabulary, passages)] + ["same words " * 30] * 5
    df = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(5)
    got = repeats.remove_repeats(df, window=window).drop("row").collect()
    key = lambda x: (x[0] is None, x)
    want = sorted(((i if i % 9 else None, *b) for i, b in enumerate(brute(texts, window))), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=lambda x: (x[0] is None, x)) == want
    assert all(sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in got)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomial_hashes_mistake(spark, n):
    tm = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    other = tm.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(34))
    swap = " ".join("ab"[bin(i).count("1") % 2] for i in range(64)), " ".join("ba"[bin(i).count("1") % 2] for i in range(64))
    texts = [f"{tm} {tail}", f"{other} {tail}", *swap]
    got = repeats.removal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, *b) for i, b in enumerate(brute(texts, 35))]


def test_words_that_were_made_to_collide(spark):
    """Two words that one fixed, public way of hashing takes for one another; keys that differ from run to run tell them apart."""
    tail = " ".join(f"w{i}" for i in range(34))
    texts = [f"{w} {tail}" for w in ("whseromw!!&!!(@@", "gcucezvb$!@c+^ji")]
    got = repeats.removal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, *b) for i, b in enumerate(brute(texts, 35))]


def test_keys_of_a_run():
    """One run gives one hash, whichever task takes a word; another run gives another; every pair of close words differs."""
    close = [bytes([a, b]) + b"x" * n for n in (0, 6, 7, 14, 62, 63, 100) for a in range(97, 107) for b in range(97, 107)]
    one, other = words.Hashing(), words.Hashing()
    first, again, second = (words.word_hashes(close, h)[0] for h in (one, words.Hashing(one.seed), other))
    assert first.tolist() == again.tolist() and not (first == second).any() and len(set(first.tolist())) == len(close)
    for length in (1, 2, 18, 35):
        plain = {}
        for at, h in enumerate(one.windows(first, length).tolist()):
            assert plain.setdefault(tuple(close[at : at + length]), h) == h
        assert len(set(plain.values())) == len(plain)


def test_empty_table(spark):
    assert repeats.removal(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes():
    texts = [b"", b" a b  a\n", b"b", "é ".encode() * 3, b"x" * 5_000_000 + b" a", b"a b " * 700_000]
    hashes, counts = words.word_hashes(texts, words.Hashing())
    assert counts.tolist() == [len(t.split()) for t in texts]
    flat = [w for t in texts for w in t.split()]
    assert len(set(hashes.tolist())) == len(set(flat)) and len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat))


def test_packing_of_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        keys, extra, flags = np.sort(rng.integers(0, 1 << 63, n, np.uint64)), rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 4, n, np.uint8)
        for got, want in zip(repeats._unpack(repeats._pack(keys, extra, flags)), (keys, extra, flags), strict=True):
            assert got.tolist() == want.tolist()
