"""Operator 13 against a trie of nested dictionaries, with real fingerprints and with ones that collide all the time."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillspark.llm import prefix_trie
from quillspark.llm.registry import ORACLE_SQL

SHAPE = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    turns = {c: [(r, t) for *_, r, _, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def sums(node):
        below = [sums(x) for x in children.get(node, [])]
        words = len(node[-1][1].encode().split()) if node else 0
        leaves, saved = (sum(x) for x in zip(*below, strict=True)) if below else (1, 0)
        totals[node] = leaves, saved + (len(members[node]) - 1) * words
        return totals[node]

    totals, out = {}, []
    if members:
        sums(())
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, [])), *totals[node], sha256(ends.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, rolling=None):
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SHAPE).repartition(3), rolling)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def conversations(rng, n, roles=("user", "assistant"), texts=("a b", "c", "", None, "d  e\tf"), most=7):
    return [(c, t, roles[t % len(roles)], rng.choice(texts)) for c in rng.sample(range(-60, 4 * n), n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("primes", [None, (5, 7), (3, 5)])
def test_equals_nested_dictionaries(spark, primes):
    rolling = prefix_trie.Rolling(primes, (2, 3)) if primes else None
    check(spark, conversations(random.Random(3), 90), rolling)


def test_ties_nulls_and_repeats(spark):
    rows = [(1, None, "u", "first"), (1, 0, None, None), (1, 0, "u", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (20, 5, "u", "x"), (21, 5, "u", "x"), (21, 5, "u", "x"), (None, 1, "u", "gone"), (-3, 1, "u", ""), (-3, 2, "u", "é́ x")]
    check(spark, rows)


def test_turnless_conversations(spark):
    """Ids whose first turns come from an absent conversation and who have no more of their own."""
    short = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:8]
    check(spark, [(c, 0, "u", "only") for c in short])
    check(spark, [(c, 0, "u", "only") for c in short] + [(0, t, "u", f"t{t}") for t in range(2)])


def test_long_frequent_and_single_conversations(spark):
    same = [(c, t, "u", f"turn {t} w w") for c in range(0, 4000, 20) for t in range(3)]
    long = [(7, t, "u", f"{t % 5} x") for t in range(20_000)]
    check(spark, same + [(8, t, "u", "z" * 100_000) for t in range(3)])
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(long, SHAPE).repartition(3))
    h = zlib.crc32(b"7") % 4
    assert got.count() == 20_000 - h + 1 and got.agg(F.max("depth"), F.sum("saved_tokens"), F.max("n_leaves")).first()[:] == (20_000 - h, 0, 1)
    check(spark, [(3, 0, "u", "x")])


def test_ends_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_PIECE", 7)
    check(spark, [(20 * c, 0, "u", "same") for c in range(200)])


def test_empty_table_and_clashing_columns(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SHAPE)).count() == 0
    rows = conversations(random.Random(4), 30)
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("z") for c in ("key", "place", "digest", "words", "depth", "f", "g", "way", "part", "at", "one", "sum_0", "head")})
    assert sorted(map(tuple, prefix_trie.rebuilt_trie(df).collect())) == brute(rows)


def test_sql_equals_nested_dictionaries():
    import duckdb

    rows = conversations(random.Random(5), 60)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op13_trie"]).fetchall()) == brute(rows)
