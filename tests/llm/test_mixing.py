"""Operator 1 against a plain mix."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Gives away the excess of capped sources by weight until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def rows_of(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "z", "empty"]
    return [(i if i % 19 else None, rng.choice([None, "", " "]) if rng.random() < 0.1 or s == "empty" else " \t".join(["wé"] * rng.randint(1, 60)) + "\n", s) for i in range(n) for s in [rng.choices(sources, [40, 3, 2, 10, 1, 1])[0]]]


def test_counts(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(7)
        got = mixing.mix_counts(df).collect()
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += len(words(t))
        want = targets(sizes)
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        order = sorted((int(md5(f"mix:{'null' if d is None else d}:{md5(t or '')}")[:13], 16), d is not None, d or 0, len(words(t)), s or "") for d, t, s in rows)
        place = {x[1:]: i for i, x in enumerate(order)}  # rows that share all of this take the same
        assert len(got) == len(rows)
        for s in sizes:
            mine = sorted((r for r in got if r.source == s), key=lambda r: place[(r.doc_id is not None, r.doc_id or 0, r.size, r.source or "")])
            assert all(r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-6) for r in mine)
            whole, rest = divmod(math.floor(mine[0].target), sizes[s]) if sizes[s] else (0, 0)
            for r in mine:
                part = min(r.size, rest)
                rest -= part
                assert r.taken == whole * r.size + part <= 2 * r.size
        assert sorted(map(str, mixing.mix_counts(df.repartition(3)).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("most", [mixing.BROADCAST_SOURCES, 0])
def test_texts(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = mixing.mix_counts(df).where("doc_id is not null").collect()
    taken = defaultdict(int)
    originals = {d: t for d, t, _ in rows}
    for r in mixing.mix(df).where("doc_id is not null").collect():
        assert originals[r.doc_id].startswith(r.text)
        taken[r.doc_id] += len(words(r.text))
    assert {r.doc_id: r.taken for r in counts if r.taken} == dict(taken)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_counts(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mixing.mix_counts(spark.createDataFrame([(1, None, None), (1, "", "a")], schema)).collect()] == [0, 0]
    one = mixing.mix_counts(spark.createDataFrame([(1, "x " * 200_000, "a")] * 2, schema)).collect()
    assert sum(r.taken for r in one) == 600_000 and all(r.taken <= 400_000 for r in one)


def test_rows_that_repeat_at_the_cut(spark):
    """All of a source's rows are one row: whole ones and one cut one are taken, just as the budget asks."""
    schema = "doc_id long, text string, source string, other int"
    rows = [(7, "a b c d e f g", "x", 1)] * 50 + [(i, "w " * 100, "y", 1) for i in range(30)]
    df = spark.createDataFrame(rows, schema).repartition(6)
    counts = {r.source: (r.total, r.target) for r in mixing.mix_counts(df).groupBy("source").agg(F.sum("taken").alias("total"), F.max("target").alias("target")).collect()}
    texts = {r.source: r.total for r in mixing.mix(df).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("total")).collect()}
    assert texts == {s: math.floor(t) for s, (_, t) in counts.items()} == {s: n for s, (n, _) in counts.items()}
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
