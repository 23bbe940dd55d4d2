"""Operator 13, a trie of the prefixes of conversations, with their members.

Turns are digests of role and text. A numpy scan over turns sorted by (conversation, place) gives each prefix a polynomial rolling
fingerprint, modulo two primes of 31 bits with random bases: the sum of turn * base^place. Sorted ranges are scanned apart, and what a
conversation brings from an earlier range is added after, so neither a long conversation nor a frequent one is one task.

Prefixes of one depth and fingerprint are a candidate group. Its members are verified turn by turn: at each depth the last turn and
the group of the prefix before it must be those of the group's representative, the least conversation, which the group's least and
greatest value tell; with all shorter prefixes verified too, that holds the whole prefixes against each other. Where they differ, the
group is split: members get the number of their variant, which all their longer prefixes inherit, until every group is of one mind.

Sums over subtrees take no pass for each depth. Each node is owned by its least member. The nodes that a conversation owns are the last
ones of its path, so sums over them are one scan from their end; and its other prefixes are just those nodes that have all of them
below, so that each prefix of each conversation adds once to its node.

Nulls and edge cases: a null role or text is empty; rows without a conversation are left out; turns are ordered by number, null first, those
of one number by role, then by digest, and rows that repeat are turns each; a conversation without turns ends at the root, which has no
text; the empty text is a text. An empty table gives an empty result, without a root. Texts are used whole. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
#: Ids whose text is one row before the list of a node's ends is hashed.
_PIECE = 50_000
#: A node: its depth, the fingerprint of its prefix, and the variants by which it was split off.
NODE = ["depth", "f", "way"]


class Rolling:
    """Prefix fingerprints modulo the product of two primes, held as one number."""

    def __init__(self, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] | None = None):
        self.primes = primes
        self.bases = bases or tuple(2 + secrets.randbelow(p - 3) for p in primes)

    def powers(self, k: int, places: np.ndarray) -> np.ndarray:
        """base^place, by squaring."""
        p, square, out = np.uint64(self.primes[k]), np.uint64(self.bases[k] % self.primes[k]), np.ones(len(places), np.uint64)
        for bit in range(int(places.max()).bit_length() if len(places) else 0):
            out = np.where(places >> bit & 1, out * square % p, out)
            square = square * square % p
        return out

    def values(self, k: int, digests: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What each turn adds to the fingerprints of prefixes that have it."""
        p = np.uint64(self.primes[k])
        return (digests[:, k] % p * self.powers(k, places) % p).astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch], sums: int, rolling: Rolling | None) -> Iterator[pa.RecordBatch]:
    """key, place, ``sums`` columns of numbers, digest and more -> the same, with running sums in their key from the partition's first row on.

    With ``rolling``, two more sums follow, of what turns add to the fingerprint, taken by their place; own_0 and own_1 are what the row adds.
    """
    last_key, totals = None, None
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        values = [batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(sums)]
        if rolling:
            digests = np.frombuffer(b"".join(batch.column(2 + sums).to_pylist()), "<u8").reshape(len(batch), -1)
            values += [rolling.values(k, digests, batch.column(1).to_numpy()) for k in (0, 1)]
        own = values[sums:]
        (first,) = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        out = []
        for i, v in enumerate(values):
            run = np.cumsum(v)
            run -= np.repeat(run[first] - v[first], sizes)
            if key[0] == last_key:
                run[: sizes[0]] += totals[i]
            out.append(run)
        last_key, totals = key[-1], [int(r[-1]) for r in out]
        if rolling:
            totals[sums:] = [t % p for t, p in zip(totals[sums:], rolling.primes, strict=True)]
            out[sums:] = [r % p for r, p in zip(out[sums:], rolling.primes, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(r, pa.int64()) for r in (*out, *own))], [*batch.schema.names, *(f"sum_{i}" for i in range(len(out))), *(f"own_{k}" for k in range(len(own)))])


def scanned(rows: DataFrame, order: list[Column], sums: list[str], ws: Workspace, name: str, rolling: Rolling | None = None) -> DataFrame:
    """``rows`` (key, place, ...) with sum_0, sum_1, ...: running sums of the columns ``sums`` within a key, and of fingerprints, in ``order``.

    ``order`` begins with the key, ascending. The driver gets one row a partition: what its last key has come to.
    """
    names = ["key", "place", *sums, *(["digest"] if rolling else [])]
    rest = [c for c in rows.columns if c not in names]
    n = len(sums) + 2 * bool(rolling)
    parts = shuffle_partitions(ws.spark)
    sorted_ = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*names, *rest)
    owns = [f"own_{k}" for k in (0, 1)] if rolling else []
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema), *(f"sum_{i} long" for i in range(n)), *(f"{o} long" for o in owns)])
    local = ws.save(sorted_.mapInArrow(lambda b: _scan(b, len(sums), rolling), kinds).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), f"{name}-local")
    totals = [f"sum_{i}" for i in range(n)]
    ends = local.groupBy("part").agg(F.min("key").alias("first"), F.max(F.struct("key", "at", *totals)).alias("last"))
    carried, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r.part):
        brought = [0] * n
        if before and before[0] == r.first:
            brought = before[1]
            carried.append((r.part, r.first, *brought))
        own = [r.last[t] for t in totals]
        before = (r.last.key, [a + b for a, b in zip(own, brought, strict=True)] if r.last.key == r.first else own)
    shape = "part int, key long" + "".join(f", add_{i} long" for i in range(n))
    found = local.join(F.broadcast(ws.spark.createDataFrame(carried, shape)), ["part", "key"], "left")  # a row a partition at most
    limit = lambda i: rolling.primes[i - len(sums)] if rolling and i >= len(sums) else None
    total = lambda i: F.col(f"sum_{i}") + F.coalesce(f"add_{i}", F.lit(0))
    return found.select("key", *(c for c in rows.columns if c != "key"), *((total(i) % limit(i) if limit(i) else total(i)).alias(f"sum_{i}") for i in range(n)), *owns)


def turns_of(conversations: DataFrame, ws: Workspace, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """key (the conversation), place (from 0), digest, words: the turns of all conversations, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("key"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("one"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed = scanned(rows, [F.col(c) for c in ("key", "turn", "role", "digest")], ["one"], ws, "placed")
    return placed.select("key", (F.col("sum_0") - 1).alias("place"), "digest", "words")


def led_by(turns: DataFrame, leader: Column, lead: Column, most: int) -> DataFrame:
    """``turns`` (see ``turns_of``) rebuilt: the first ``lead`` turns, ``most`` at most, of each conversation are those of its ``leader``, a conversation that may be absent or shorter.

    Both are columns of ``key``. Only so many turns a conversation are moved to those that it leads.
    """
    heads = turns.where(F.col("place") < most).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    none = F.array().cast(heads.schema["head"].dataType)
    led = turns.select("key").distinct().select("key", leader.alias("leader"), lead.cast("long").alias("lead"))
    led = led.join(heads.withColumnRenamed("key", "leader"), "leader", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("lead").cast("int")))
    first = led.select("key", F.inline("head"))
    own = turns.join(led.select("key", "lead", F.size("head").cast("long").alias("taken")), "key").where("place >= lead")
    return first.select("key", "place", "digest", "words").unionByName(own.select("key", (F.col("place") - F.col("lead") + F.col("taken")).alias("place"), "digest", "words"))


def _verified(rows: DataFrame, ws: Workspace) -> DataFrame:
    """``rows`` (key, depth, digest, words, f, g) with way and way_before, by which unlike prefixes of one fingerprint are told apart."""
    rows = rows.withColumns({"way": F.lit(""), "way_before": F.lit("")})
    turn = 0
    while True:
        said = F.struct("digest", "g", "way_before")
        groups = rows.groupBy(*NODE).agg(F.min(said).alias("low"), F.max(said).alias("high"), F.min("key").alias("representative"))
        unlike = groups.where("low <> high").select(*NODE)
        if unlike.isEmpty():
            return rows
        # variants in the order of their least member, the representative's first
        turn += 1
        members = rows.join(unlike, NODE)
        variants = members.groupBy(*NODE, "digest", "g", "way_before").agg(F.min("key").alias("least"))
        variants = variants.withColumn("variant", F.row_number().over(Window.partitionBy(*NODE).orderBy("least")) - 1).where("variant > 0").drop("least")
        marks = ws.save(members.join(variants, [*NODE, "digest", "g", "way_before"]).select("key", "depth", F.concat_ws(".", "depth", "variant").alias("mark")), f"marks-{turn}")
        ways = marks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("depth", "mark"))).alias("marks"))
        upto = lambda last: F.array_join(F.transform(F.filter("marks", lambda m: m["depth"] <= last), lambda m: m["mark"]), ",")
        longer = lambda old, last: F.when(F.col("marks").isNull() | (upto(last) == ""), F.col(old)).otherwise(F.concat_ws(";", F.col(old), F.concat(F.lit(f"{turn}:"), upto(last))))
        marked = rows.join(ways, "key", "left").withColumns({"way": longer("way", F.col("depth")), "way_before": longer("way_before", F.col("depth") - 1)})
        rows = ws.save(marked.drop("marks"), f"ways-{turn}")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, f, way, key, sorted -> depth, f, way, first key, the keys as text."""
    node, keys = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": node[0], "f": node[1], "way": node[2], "first": keys[0], "text": ",".join(map(str, keys))}], pa.schema([("depth", pa.int64()), ("f", pa.int64()), ("way", pa.string()), ("first", pa.int64()), ("text", pa.string())]))

    for batch in batches:
        for *name, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != node or len(keys) == _PIECE:
                if keys:
                    yield piece()
                node, keys = name, []
            keys.append(key)
    if keys:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, f, way, text, sorted by node and first key -> depth, f, way, ends_sha256."""
    node, hashed, out = None, None, []
    shape = pa.schema([("depth", pa.int64()), ("f", pa.int64()), ("way", pa.string()), ("ends_sha256", pa.string())])
    done = lambda: dict(zip(shape.names, (*node, hashed.hexdigest()), strict=True))
    for batch in batches:
        for *name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != node:
                if node:
                    out.append(done())
                node, hashed = name, sha256(text.encode())
            else:
                hashed.update(f",{text}".encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, shape)
            out = []
    if node:
        yield pa.RecordBatch.from_pylist([*out, done()], shape)


def trie(turns: DataFrame, keys: DataFrame, ws: Workspace, rolling: Rolling | None = None) -> DataFrame:
    """A row a node of the trie of ``turns`` (key, place from 0 without gaps, digest, words); ``keys`` (key) names all conversations, those without turns too.

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rolling = rolling or Rolling()
    step = rolling.primes[1]
    scan = scanned(turns.select("key", "place", "digest", "words"), [F.col("key"), F.col("place")], [], ws, "prefixes", rolling)
    f = F.col("sum_0") * step + F.col("sum_1")
    without = lambda k: F.pmod(F.col(f"sum_{k}") - F.col(f"own_{k}"), F.lit(rolling.primes[k]).cast("long"))
    rows = ws.save(scan.select("key", (F.col("place") + 1).alias("depth"), "digest", "words", f.alias("f"), (without(0) * step + without(1)).alias("g")), "rows")
    rows = _verified(rows, ws)

    told = F.min(F.struct("key", "words", "g", "way_before"))
    nodes = rows.groupBy(*NODE).agg(told.alias("t"), F.count(F.lit(1)).alias("n_convs")).select(*NODE, F.col("t.key").alias("conv_id"), F.col("t.words").alias("words"), F.col("t.g").alias("g"), F.col("t.way_before").alias("way_before"), "n_convs")
    top = keys.agg(F.min("key").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = top.select(zero.alias("depth"), zero.alias("f"), F.lit("").alias("way"), "conv_id", zero.alias("words"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("string").alias("way_before"), "n_convs")
    nodes = ws.save(nodes.unionByName(root), "nodes")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("g"), F.col("way").alias("way_before"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["depth", "g", "way_before"], "left")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g").alias("f"), F.col("way_before").alias("way")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = ws.save(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("g", "way_before"), "family")

    # each owner's nodes from the deepest up: what lies below a node on its owner's path
    owned = nodes.select(F.col("conv_id").alias("key"), F.col("depth").alias("place"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"), *NODE[1:], "parent_conv_id", "n_convs", "n_children")
    sums = ws.save(scanned(owned, [F.col("key"), F.col("place").desc()], ["saved", "leaf"], ws, "owned"), "sums")
    paths = sums.groupBy("key").agg(F.min("place").alias("from"), F.max("sum_0").alias("saved"), F.max("sum_1").alias("leaves"))
    # and what owners of nodes below add to the prefixes that are not theirs
    shared = rows.join(paths, "key").where("depth < from").groupBy(*NODE).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    at_root = paths.where("from > 0").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves")).select(zero.alias("depth"), zero.alias("f"), F.lit("").alias("way"), "more_saved", "more_leaves")

    last = rows.groupBy("key").agg(F.max(F.struct(*NODE)).alias("last")).select("key", "last.*")
    bare = keys.join(last.select("key"), "key", "left_anti").select("key", zero.alias("depth"), zero.alias("f"), F.lit("").alias("way"))
    ends = last.unionByName(bare)
    order = [*NODE, "key"]
    pieces = ends.repartitionByRange(shuffle_partitions(ws.spark), *order).sortWithinPartitions(*order).select(*order).mapInArrow(_pieces, "depth long, f long, way string, first long, text string")
    hashes = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "text").mapInArrow(_hashed, "depth long, f long, way string, ends_sha256 string")

    every = sums.withColumnsRenamed({"key": "conv_id", "place": "depth"}).join(shared.unionByName(at_root), NODE, "left").join(hashes, NODE, "left")
    total = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).alias
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("sum_1", "more_leaves")("n_leaves"), total("sum_0", "more_saved")("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, rolling: Rolling | None = None) -> DataFrame:
    """The trie of conversations of which each takes its first turns, none to three by the checksum of its id, from the first conversation of its twenty."""
    ws = Workspace(conversations.sparkSession, "trie")
    turns = ws.save(turns_of(conversations, ws), "turns")
    rebuilt = led_by(turns, F.col("key") - F.col("key") % 20, F.crc32(F.col("key").cast("string")) % 4, 3)
    return trie(rebuilt, turns.select("key").distinct(), ws, rolling)
