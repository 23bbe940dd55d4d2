"""Operator 10 against all pairs, and its index against all signatures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import neardup
from quillspark.llm.graph import components, forest_roots
from quillspark.llm.workspace import Workspace


def shingles(text, width):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {" ".join(w)} - {""}


def brute(rows, width=2):
    """The result of all pairs, and how many components with words there are."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    found = sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)
    return found, len({find(i) for i, s in enumerate(sets) if s})


def edited(rng, words, share):
    return [rng.choice(("new", "other", "x%d" % rng.randint(0, 99))) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(spark, width):
    rng = random.Random(11)
    texts = [None, "", "  ", "one", "ONE", "two words", "Two  Words", "two words more"]
    for share in (0.002, 0.01, 0.03, 0.05, 0.08):
        for n in (8, 40, 300):
            words = [f"w{rng.randint(0, 400)}é" for _ in range(n)]
            texts += [" ".join(edited(rng, words, share)) for _ in range(12)]
            for _ in range(4):  # a chain of edits
                words = edited(rng, words, share)
                texts.append(" ".join(words))
    texts += ["same text again and again"] * 60
    rng.shuffle(texts)
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, "unlike")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    found = neardup.near_duplicates(df, keep=("text", "n"), shingle=width)
    assert found.columns[-2:] == ["in_text", "in_n"]
    found = found.cache()
    got = sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    want, n_components = brute(rows, width)
    assert got == want
    # one row of each component with words is kept (ids may repeat, so component_id alone doesn't count them), and all without words
    assert found.where("n_shingles > 0 and kept_row").count() == n_components
    assert found.where("n_shingles = 0 and not kept_row").count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, words, 0.02))) for i in range(400)] + [(400 + i, " ".join(rng.choices(words, k=200))) for i in range(100)]
    got = neardup.dedup_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)[0]


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_that_polynomial_hashes_mistake(spark, n):
    rows = [(1, f"{thue_morse(n)} x"), (2, f"{thue_morse(n, 'ba')} x"), (3, f"{thue_morse(n)} x")]
    got = neardup.dedup_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_very_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 0.01))), (3, " ".join(rng.sample(words, len(words)))), (4, "x" * 2_000_000), (5, None)]
    got = neardup.dedup_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)[0]


def test_empty_table(spark):
    assert neardup.dedup_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_finds_all_pairs_within_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, neardup.VALUES)).astype(np.uint16)
        b = a.copy()
        at = rng.choice(neardup.VALUES, neardup.MOST_DIFFERENT, replace=False)
        b[0, at] ^= 1
        assert set(neardup.keys_of(a)[0]) & set(neardup.keys_of(b)[0])


def test_a_block_gives_a_forest():
    """Rows of one key that are all alike, in components of their own: as many links as connect them, and no pair more."""
    block = neardup._Block(0, False)
    base = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 300, np.uint64))
    for i in range(60):
        some = np.sort(np.concatenate([base[:295], np.random.default_rng(i + 2).integers(0, 1 << 63, 5, np.uint64)]))
        signature = neardup.signatures([some])
        block.rows.append((i, i, 3, 0, 300, signature.tobytes(), some.tobytes()))
    block.key = int(neardup.keys_of(np.frombuffer(block.rows[0][5], "<u2")[None])[0, 0])
    shared = [r for r in block.rows if block.key in neardup.keys_of(np.frombuffer(r[5], "<u2")[None])[0]]
    block.rows = shared
    assert len(shared) > 20 and set(block.candidates()) == {r[0] for r in shared}
    assert len(block.links()) == len(shared) - 1


def test_words_that_were_made_to_collide(spark):
    rows = [(1, "whseromw!!&!!(@@ x"), (2, "gcucezvb$!@c+^ji x")]
    got = neardup.dedup_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 2, True)]


def test_signature_agrees_with_similarity():
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 63, 3000, np.uint64)) for i in range(2)]
    mixed = np.sort(np.concatenate([sets[0][:2700], sets[1][:300]]))
    a, b = neardup.signatures([sets[0], mixed])
    assert abs((a == b).mean() - 2700 / 3300) < 0.2


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in list(root) if find(x) != x}
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "c")
    assert dict(map(tuple, got.select(F.col("node"), F.col("root")).collect())) == want


@pytest.mark.parametrize("chain", [0, 1, 37])
def test_forest_roots(spark, chain):
    rng = random.Random(chain)
    parent = {i: rng.randint(max(0, i - 40), i - 1) for i in range(100, 300)} | {1000 + i: 999 + i for i in range(1, chain + 1)}
    rows = [(a, b) for b, a in parent.items()] if chain else []

    def find(x):
        while x in parent:
            x = parent[x]
        return x

    got = forest_roots(spark.createDataFrame(rows, "a long, b long"), Workspace(spark, "test"), "f").collect()
    assert len(got) == len(rows) and {r.node: r.root for r in got} == {b: find(b) for _, b in rows}
