"""Operator 6 against all pairs."""

import math
import random

import numpy as np
import pytest

from quillspark.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(ok) if other != at)[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.01, 1e5])
def test_equals_all_pairs(spark, scale):
    rng = random.Random(5)
    rows = [(i, [scale * rng.gauss(0, 1) * (1 + i % 7) / (1 + j) for j in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(30)] + [(0, rows[3][1]), (50, rows[50][1]), (None, rows[1][1]), (1001, None), (1050, [1.0, None] * 4), (1100, [math.nan] * 8), (1150, [math.inf] * 8), (1200, []), (1250, [1.0]), (1300, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(6)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows, 5, 50)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 50, 65536), (50, 1, 0, 65536)]
    assert topk.top_k(df.limit(0)).count() == 0
    shared = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0])]
    assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(shared, "vec_id long, embedding array<float>")).collect()) == [(0, 1, 1, 327680), (0, 2, 1, 65536)]


def test_search_prunes_without_loss():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 50, (3000, 16)) * rng.lognormal(0, 1, (3000, 1)))
    ids = rng.permutation(3000)
    blocks = [(float(np.sqrt((v[i : i + 100] ** 2).sum(axis=1).max())), np.stack([ids[i : i + 100], ids[i : i + 100]], axis=1), v[i : i + 100]) for i in range(0, 3000, 100)]
    basis = np.ascontiguousarray(np.linalg.eigh(v.T @ v)[1][:, ::-1])
    best = topk.search(ids[:40], v[:40], blocks, basis, 5)
    score = v[:40] @ v.T
    for i in range(40):
        want = sorted((-int(s), int(j)) for s, j in zip(score[i], ids) if j != ids[i])[:5]
        mine = best.query == i
        assert list(zip((-best.score[mine]).tolist(), best.id[mine].tolist())) == want
