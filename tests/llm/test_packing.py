"""Operator 4: lossless, full sequences, close to or at the lower bound; the search against exhaustive packing."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing
from quillspark.llm.tokens import Encoder, vocabulary


def fewest(items, capacity):
    """Fewest bins, by trying every way."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best if items else 0


def unpacked(patterns):
    out = Counter()
    for pattern, uses in patterns:
        for k, n in pattern:
            out[k] += n * uses
    return out


def test_search_finds_the_fewest_bins():
    random.seed(1)
    for _ in range(150):
        items = [random.randint(1, 20) for _ in range(random.randint(1, 9))]
        got = packing.pack_lengths(Counter(items), 20)
        assert unpacked(got) == Counter(items)
        assert all(sum(k * n for k, n in p) <= 20 for p, _ in got)
        assert sum(u for _, u in got) == fewest(items, 20), items


def test_last_round_proves_the_fewest():
    """Cases where best-fit decreasing is not the best, and where no packing meets the lower bound."""
    random.seed(4)
    unmet = better = 0
    for _ in range(400):
        capacity = random.choice((12, 30, 100))
        items = [random.randint(1, capacity // 2 + 2) for _ in range(random.randint(6, 11))]
        counts = Counter(items)
        got, want = packing.pack_lengths(counts, capacity), fewest(items, capacity)
        assert unpacked(got) == counts and sum(u for _, u in got) == want, items
        unmet += want > packing.least_bins(counts, capacity)
        better += want < sum(packing.best_fit_decreasing(counts, capacity).values())
    assert unmet and better


def test_search_of_many_lengths_ends():
    for lengths in (range(1, 2049), range(600, 1100), range(1, 60), [1, 2, 3] * 5000, [683] * 3001 + [682] * 2999 + [1025] * 7):
        counts = Counter(lengths)
        got = packing.pack_lengths(counts)
        assert unpacked(got) == counts and all(sum(k * n for k, n in p) <= 2048 for p, _ in got)
        assert sum(u for _, u in got) <= sum(packing.best_fit_decreasing(counts, 2048).values())


def test_search_at_scale_meets_the_bound():
    rng = np.random.default_rng(2)
    counts = dict(Counter(np.minimum(2048, rng.lognormal(6, 1, 300_000).astype(int) + 1).tolist()))
    got = packing.pack_lengths(counts)
    assert unpacked(got) == Counter(counts)
    assert sum(u for _, u in got) <= 1.001 * packing.least_bins(counts, 2048)


TEXTS = ["", None, "a b", "word " * 3000, "x\n\n  y\tz ", "The don't stop", "é" * 50, "same text here", "same text here", "A" * 9000, " lead", "trail \n", " odd blanks\x1c", "one\n\n\ntwo", "<|endoftext|> <|startoftext|>", "\0zero", "\1one two", "it's I'LL ŵ¼12 x² \x85\xa0y"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    plain = Tokenizer.from_file(vocabulary(name))
    plain.encode_special_tokens = True
    encoder = Encoder(name)
    random.seed(3)
    texts = TEXTS + ["".join(random.choices(["a", "B", " ", "\n", "'s", "1", "é", "!", "\t", " the", " ", "́", "Σ", "\r\n", "İ", "ß", "µ", "Ǆ", "²", "½", "\x85", "\xa0", "Å", "'LL", "!?"], k=random.randint(0, 25))) for _ in range(2000)]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, encoder.dtype).tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_pack(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (7, TEXTS[7]), (None, "null id")], "doc_id long, text string").repartition(3)
    plain = Tokenizer.from_file(vocabulary(packing.VOCABULARY))
    plain.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    want = Counter((d, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in [*enumerate(TEXTS), (7, TEXTS[7]), (None, "null id")])
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.piece):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        had = by_doc.setdefault((r.doc_id, r.row), [])
        assert r.start == len(had) and (r.start % 2048 == 0)
        had += ids.tolist()
    assert Counter((d, tuple(ids)) for (d, _), ids in by_doc.items()) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = Counter(r.length for r in rows)
    assert len(sequences) == packing.least_bins(total, 2048)


def test_empty_table_and_clashing_columns(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a", 5, 6)], "doc_id long, text string, rank int, length int")
    found = packing.pack(df, with_ids=False)
    assert set(found.columns) == {"doc_id", "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and found.count() == 1
