"""Operator 11 against whole trees in memory."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle

H = lambda parts: sha256("".join(parts).encode()).hexdigest()
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append((level[run:i], level[i + 1 : run + 8]))
        i //= 8
    return out


def leaf_of(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return H("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: b"" if g is None else b"1" + g.encode())
    trees = {}
    for name in names:
        mine = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[name] = mine, levels_of([leaf_of(r, r[1]) for r in mine])
    top = levels_of([trees[n][1][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        mine, levels = trees[name]
        for i, r in enumerate(mine):
            path = siblings(levels, i) + siblings(top, k)
            third = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1].translate({c: c + 32 for c in range(65, 91)}) if third and r[1] is not None else r[1]
            node = leaf_of(r, text)
            for before, after in path:
                node = H([*before, node, *after])
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], H([x for a, b in path for x in a + b]), node, node == top[-1][0]))
    return out


def check(spark, rows, levels=merkle.LEVELS):
    got = [tuple(r) for r in merkle.tampered(spark.createDataFrame(rows, SHAPE).repartition(3), levels).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def documents(rng, n, langs):
    return [(i, rng.choice((None, "", "lower", "Upper É", "x" * 50)), rng.choice(langs), rng.choice((None, "s", "ü")), rng.choice((None, 0, 7))) for i in range(n)]


@pytest.mark.parametrize("block_levels", [4, 1, 2])
def test_equals_whole_trees(spark, block_levels):
    """With blocks as they are, and so small that trees and their paths have many levels of blocks."""
    rng = random.Random(block_levels)
    got = check(spark, documents(rng, 700, ["a", "a", "a", "b", None, "é"]) + [(1000, "one", "lone", None, 1)], block_levels)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_of_one_group(spark, n):
    check(spark, documents(random.Random(n), n, ["a"]))


def test_many_groups(spark):
    check(spark, documents(random.Random(3), 300, [None, *(f"g{i}" for i in range(90))]), 1)


def test_nulls_repeats_and_long_texts(spark):
    check(spark, [(None, None, None, None, None)] * 3 + [(None, "A", "a", None, 1), (5, "B", "a", None, 1), (5, "B", "a", None, 1), (5, "b", "a", "x", 1), (-7, "A" * 3_000_000, "a", None, None)])


def test_empty_table_and_clashing_columns(spark):
    assert merkle.tampered(spark.createDataFrame([], SHAPE)).count() == 0
    rows = documents(random.Random(1), 30, ["a", "b"])
    df = spark.createDataFrame(rows, SHAPE)
    more = df.withColumns({c: F.lit("z") for c in ("tree", "id", "digest", "changed", "part", "at", "idx", "n", "block", "nodes", "leaf", "root", "path", "up")})
    assert sorted((tuple(r) for r in merkle.tampered(more).collect()), key=str) == sorted(brute(rows), key=str)


def test_paths_lead_to_the_root(spark):
    rows = documents(random.Random(6), 200, ["a", "b"])
    for r in merkle.manifest(spark.createDataFrame(rows, SHAPE), with_paths=True).collect():
        path = [(x.before.hex().encode(), x.after.hex().encode()) for x in r.path]
        assert merkle.folded(r.leaf.encode(), path).decode() == r.root == r.folded_root and r.verified


@pytest.mark.parametrize("n", [1, 5, 8, 63, 64, 65, 511, 513])
def test_traversal_keeps_a_run_and_a_stack_a_level(n):
    leaves = [H([str(i)]).encode() for i in range(n)]
    whole = levels_of([x.decode() for x in leaves])
    walk = merkle.Traversal(leaves, merkle.height(n))
    assert walk.root.decode() == whole[-1][0]
    for i, path in enumerate(walk.paths()):
        assert path == [("".join(a).encode(), "".join(b).encode()) for a, b in siblings(whole, i)]
        assert all(len(s.run) <= 8 and all(len(p) < 8 for p in s.partial) for s in walk.stacks)
