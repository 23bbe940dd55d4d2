"""Ordered greedy folds over arrays, as columns: neighbours are joined from the left as long as they fit.

A piece is a struct of ``i`` (its first item), ``at`` and ``end`` (in characters) and ``cut``: how high the border before it is. A
fold at a level joins no piece over a border of that height or more. What a fold finds is a bit for each piece, so its state is two
numbers; bits are gathered by words of 32, words by runs of 256 and runs into one array, so no array that grows is copied for each
piece. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD, _RUN, _SUMS = 32, 256, 16
#: No limit: nothing is longer.
ANY = (1 << 31) - 1
PIECES = "array<struct<i:int,at:int,end:int,cut:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, not at each place where ``body`` has it, nor for each item where that is within a function of items.

    (Spark merges a column that is used once into its place, also where that is evaluated again and again.)
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(items: Column, size: int) -> Column:
    last = F.floor((F.size(items) - 1) / size).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * size + 1, F.lit(size))))


def _each(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """``state`` after ``items`` and the array of what ``step`` (state, item -> state, value) gave for each, which should be few."""
    start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

    def grown(acc: Column, item: Column) -> Column:
        s, value = step(acc["state"], item)
        return F.struct(s.alias("state"), F.concat(acc["out"], F.array(value)).alias("out"))

    return F.aggregate(items, start, grown)


def starts_before(lengths: Column) -> Column:
    """The sum of all earlier lengths, for each. Sums are gathered in short runs, as an array that grows is copied for each item."""

    def of_runs(runs: Column, inner: Callable[[Column], Column]) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, n: a + n))
        return F.flatten(F.zip_with(runs, inner(sums), lambda r, b: _each(r, b, lambda at, n: (at + n, at), "int")["out"]))

    inner = lambda sums: _each(sums, F.lit(0), lambda at, n: (at + n, at), "int")["out"]
    for _ in range(2):
        inner = lambda x, rest=inner: let(_groups(x, _SUMS), lambda runs: of_runs(runs, rest))
    short = _each(lengths, F.lit(0), lambda at, n: (at + n, at), "int")["out"]
    return F.coalesce(F.when(F.size(lengths) <= _SUMS, short).otherwise(inner(lengths)), F.array().cast("array<int>"))


def pieces(lengths: Column, cuts: Column) -> Column:
    """A piece an item."""

    def of(n: Column, cut: Column) -> Column:
        return let(starts_before(n), lambda at: F.transform(at, lambda a, i: F.struct(i.alias("i"), a.alias("at"), (a + F.get(n, i)).alias("end"), F.get(cut, i).alias("cut"))))

    return let(lengths, lambda n: let(cuts, lambda cut: of(n, cut)))


def _new(piece_runs: Column, most: Column, level: int, opened: Column) -> Column:
    """Where the last span begins, and words of a bit for each piece: whether a span begins with it."""

    def step(acc: Column, p: Column) -> Column:
        joins = (p["cut"] < level) & (p["end"] - acc["open"] <= most)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), acc["i"])
        after = lambda at, bits: F.struct(at.cast("bigint").alias("open"), bits.alias("bits"), (acc["i"] + 1).alias("i"))
        return F.when(joins, after(acc["open"], acc["bits"])).otherwise(after(p["at"], acc["bits"].bitwiseOR(bit)))

    def words(opened: Column, items: Column) -> Column:
        start = F.struct(opened.alias("state"), F.array().cast("array<bigint>").alias("out"))

        def grown(acc: Column, group: Column) -> Column:
            found = F.aggregate(group, F.struct(acc["state"].alias("open"), F.lit(0).cast("bigint").alias("bits"), F.lit(0).alias("i")), step)
            return let(found, lambda f: F.struct(f["open"].alias("state"), F.concat(acc["out"], F.array(f["bits"])).alias("out")))

        return F.aggregate(items, start, grown)

    start = F.struct(opened.cast("bigint").alias("state"), F.array().cast("array<array<bigint>>").alias("out"))

    def run(acc: Column, items: Column) -> Column:
        return let(words(acc["state"], items), lambda f: F.struct(f["state"].alias("state"), F.concat(acc["out"], F.array(f["out"])).alias("out")))

    return F.aggregate(piece_runs, start, run)


def fold(ps: Column, most: int, level: int, opened: Column | None = None) -> Column:
    """Pieces joined to spans. ``opened`` is where a span began that is still open before the first piece (a place of characters); without it the first piece begins one.

    The first item, place and border of a span are those of its first piece. A span that goes on from before the first piece is not
    among the result.
    """
    none = F.array().cast(PIECES)

    def of(pieces: Column) -> Column:
        runs = let(_groups(pieces, _WORD), lambda g: _groups(g, _RUN))
        found = let(runs, lambda r: F.flatten(_new(r, F.lit(most).cast("bigint"), level, F.lit(-1 << 40) if opened is None else opened)["out"]))
        begun = lambda words: F.filter(pieces, lambda p, i: F.call_function("getbit", F.get(words, F.shiftright(i, 5)), i.bitwiseAND(F.lit(_WORD - 1))) == 1)
        end = F.element_at(pieces, -1)["end"]
        ended = lambda kept: F.transform(kept, lambda x, j: F.struct(x["i"].alias("i"), x["at"].alias("at"), F.coalesce(F.get(kept, j + 1)["at"], end).alias("end"), x["cut"].alias("cut")))
        return let(let(found, begun), ended)

    return let(ps, lambda p: F.when(F.size(p) > 0, of(p)).otherwise(none))


def joined_items(items: Column, spans: Column) -> Column:
    """The text of each span: its items one behind the other."""

    def of(items: Column, spans: Column) -> Column:
        end = lambda j: F.coalesce(F.get(spans, j + 1)["i"], F.size(items))
        return F.transform(spans, lambda x, j: F.array_join(F.slice(items, x["i"] + 1, end(j) - x["i"]), ""))

    # spans may come from a Python function, which Spark does not find within a function of items
    return let(spans, lambda s: let(items, lambda t: of(t, s)))
