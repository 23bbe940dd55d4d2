"""Operator 9, secret scans. DataFrame functions only.

Three base kinds are found by pattern. The method adds a fourth, ``entropy``: within candidate strings a window slides one
character at a time; it keeps the sum of count * log2(count), updated by the counts of the character that enters and of the one
that leaves. The window's Shannon entropy is log2(w) minus that sum over w; each character class of
candidates has its own window and threshold. Windows above it join to spans. Candidates on the allow-list are suppressed, and so
are spans that a base span covers already.

Nulls and edge cases: a null text is empty; a text without secrets has counts 0, an empty ``spans`` and the digest of the empty
string; ids may be null or repeated, each row stands for itself; an empty table gives an empty result. Texts are scanned whole.
Extra columns are ignored, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in order. A match of ``assign`` counts if its group 2 has 8 characters; the minimum length of the others is in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: (name, pattern of a whole candidate, window, bits a character); the first class that fits counts. Of 20 random letters 99 % reach
#: 3.21 bits in one case and 3.55 in both, 3.62 with the joining characters. Letters of one case that are joined (paths, compounds)
#: keep a threshold that random strings seldom reach: words reach what random strings do.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 20, 3.0),
    ("lower", r"^[a-z]+$", 20, 3.2),
    ("upper", r"^[A-Z]+$", 20, 3.2),
    ("both cases", r"^[A-Za-z]+$", 20, 3.5),
    ("one case, joined", r"^(?:[a-z/_=+-]+|[A-Z/_=+-]+)$", 20, 4.15),
    ("both cases, joined", r"^[A-Za-z/_=+-]+$", 20, 3.6),
    ("mixed", r"^.+$", 20, 3.7),
)
_SAMPLE = "(?:example|placeholder|changeme|abcdefghij|0123456789)"
_FREE = f"(?:(?!{_SAMPLE}).){{0,19}}+"
#: Candidates that are known not to be secrets. Each rule covers a whole candidate: a sample word suppresses one only if no window
#: stands free of it (fewer than 20 characters before, between and after), a leading // (an address behind its scheme) only if no
#: part of the path is as long as a window. Repeated groups are possessive: Java takes those in a loop, and others by recursion,
#: which a candidate of some thousand parts overflows.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"(?i)^{_FREE}(?:{_SAMPLE}{_FREE})++$",
    r"^//[A-Za-z0-9_-]{0,63}+(?:/[A-Za-z0-9_=+-]{0,19}+)*+$",
    r"^/?[a-z0-9_-]++(?:/[a-z0-9_-]++){2,}+/?$",
    r"^[a-z0-9]{1,15}+(?:[-_][a-z0-9]{1,15}+){3,}+$",
)

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_SCALE = 1_000_000
#: Matches that are summed at once, windows of a candidate that are scanned at once, and characters of a text that are cut at once.
_BLOCK, _PIECE, _CHARS = 512, 60, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, not at each place where ``body`` has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(parts: Column) -> Column:
    """``parts`` (gap, hit: lengths in turn) with start and end of each hit.

    Lengths are summed within blocks, and then over blocks: an array that grows by one is copied at each step, so none grows long.
    """
    length = lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))
    grown = lambda acc, row: F.concat(acc["out"], F.array(row))

    def begins(lengths: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, state, lambda acc, n: F.struct((acc["at"] + n).alias("at"), grown(acc, acc["at"]).alias("out")), lambda acc: acc["out"])

    def inside(x: Column) -> Column:
        def step(acc: Column, part: Column) -> Column:
            start, end = acc["at"] + part["gap"], acc["at"] + length(part)
            row = F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("hit"), part["value"].alias("value"))
            return F.struct(end.alias("at"), grown(acc, row).alias("out"))

        state = F.struct(x["begin"].alias("at"), F.array().cast("array<struct<start:int,end:int,hit:int,value:int>>").alias("out"))
        return F.aggregate(x["block"], state, step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        starts = begins(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda total, x: total + length(x))))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("begin")), inside))

    def of_parts(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / _BLOCK).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(p, k * _BLOCK + 1, F.lit(_BLOCK))), of_blocks)

    return _let(parts, of_parts)


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: what stands between them has known lengths, so ends follow by summing. ``value`` is the length of ``group``."""
    lengths = lambda parts: F.transform(parts, F.length)
    whole = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    value = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else whole
    parts = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), whole.alias("hit"), value.alias("value"))
    return F.filter(_placed(parts), lambda x: x["hit"].isNotNull())


def _located(text: Column, pattern: str, kind: int, least_group2: int = 0) -> Column:
    hits = _hits(text, pattern, 2 if least_group2 else 0)
    spans = F.transform(F.filter(hits, lambda x: x["value"] >= least_group2), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _candidates(text: Column) -> Column:
    """Candidate strings outside the allow-list: start, the string, window, and the largest sum that is still random enough."""
    strings = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    every = F.arrays_zip(_hits(text, CANDIDATE).alias("at"), strings.alias("hit"))
    kept = F.filter(every, lambda c: ~c["hit"].rlike("|".join(f"(?:{p})" for p in ALLOWED))) if ALLOWED else every

    def prepared(c: Column) -> Column:
        window = limit = None
        for _, pattern, w, bits in reversed(CLASSES):
            least = math.floor(w * (math.log2(w) - bits) * _SCALE)
            fits = c["hit"].rlike(pattern)
            window = F.lit(w) if window is None else F.when(fits, w).otherwise(window)
            limit = F.lit(least) if limit is None else F.when(fits, least).otherwise(limit)
        return F.struct(c["at"]["start"].alias("start"), c["hit"].alias("hit"), window.alias("w"), limit.cast("bigint").alias("most"))

    empty = F.array().cast("array<struct<start:int,hit:string,w:int,most:bigint>>")
    return F.when(text.rlike(CANDIDATE), F.transform(kept, prepared)).otherwise(empty)


def _entropic(candidates: Column) -> Column:
    """Spans of windows above the threshold, joined where they overlap or touch.

    A candidate is scanned in pieces that overlap by a window, so that a step costs the same wherever it is. The character that
    enters and the one that leaves are counted among the characters that stay, and the sum of n * log2(n) changes by their shares.
    """
    widest = max(w for *_, w, _ in CLASSES)
    plogp = [round(n * math.log2(n) * _SCALE) if n else 0 for n in range(widest + 2)]
    share = F.array(*(F.lit(b - a).cast("bigint") for a, b in zip(plogp, plogp[1:], strict=False)))
    state = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("found"))

    def flagged(piece: Column, w: Column, most: Column) -> Column:
        """A bit for each place where a window above the threshold begins."""

        def step(acc: Column, i: Column) -> Column:
            n = F.least(i - 1, w - 1)

            def next_(stays: Column) -> Column:
                count = lambda at: n - F.length(F.replace(stays, F.substring(piece, at, F.lit(1)), F.lit("")))
                s = acc["s"] + F.get(share, count(i)) - F.when(i > w, F.get(share, count(i - w))).otherwise(0)
                bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), i - w)
                return _let(s, lambda s: F.struct(s.alias("s"), F.when((i >= w) & (s <= most), acc["found"].bitwiseOR(bit)).otherwise(acc["found"]).alias("found")))

            return _let(F.substring(piece, F.greatest(i - w + 1, F.lit(1)), n), next_)

        return F.aggregate(F.sequence(F.lit(1), F.length(piece)), state, step, lambda acc: acc["found"])

    def starts(c: Column) -> Column:
        pieces = F.regexp_extract_all(c["hit"], F.lit(f"(?=(.{{1,{_PIECE + widest - 1}}})).{{1,{_PIECE}}}"), F.lit(1))
        places = F.sequence(F.lit(0), F.lit(_PIECE - 1))
        return F.flatten(F.transform(pieces, lambda p, k: _let(flagged(F.substring(p, F.lit(1), c["w"] + (_PIECE - 1)), c["w"], c["most"]), lambda bits: F.transform(F.filter(places, lambda o: F.call_function("getbit", bits, o) == 1), lambda o: c["start"] + k * _PIECE + o))))

    def runs(c: Column) -> Column:
        def joined(at: Column) -> Column:
            first = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) + c["w"] < x))
            last = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + c["w"]))
            return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (b + c["w"]).alias("end")))

        return _let(starts(c), joined)

    return F.flatten(F.transform(candidates, runs))


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` under a leading ``in_``, with ``base`` and ``spans``: arrays of (start, kind, end), by start, then kind."""
    text = F.col("_text")
    df = docs.select(*(F.col(c).alias(f"in_{c}") for c in keep), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.withColumns({"_assign": _located(text, ASSIGN, 0, 8), "_access": _located(text, ACCESS, 1), "_hex": _located(text, HEX, 2), "_candidates": _candidates(text)})
    df = df.withColumns({"base": F.array_sort(F.concat("_assign", "_access", "_hex")), "_entropy": _entropic(F.col("_candidates"))})
    covered = lambda e: F.exists("base", lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"]))
    return df.select(*(f"in_{c}" for c in keep), "_text", "base", F.array_sort(F.concat("base", F.filter("_entropy", lambda e: ~covered(e)))).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: counts of the base kinds, the digest of the base spans, and all spans."""
    found = find_secrets(docs, text_col, (id_col,))
    n = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return found.select(F.col(f"in_{id_col}").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans get one. Rows, columns and null texts stay.

    Texts are put together block by block of characters, each with the spans that reach into it.
    """
    found = find_secrets(docs, text_col, tuple(docs.columns))

    def joined(spans: Column) -> Column:
        """Spans without what an earlier one covers; a span that begins within an earlier one has no mask of its own."""

        def step(acc: Column, x: Column) -> Column:
            return F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), F.concat(acc["out"], F.array(F.struct(F.greatest(acc["upto"], x["start"]).alias("a"), x["end"].alias("b"), (x["start"] >= acc["upto"]).alias("masked"), F.greatest(acc["upto"], x["end"]).alias("upto")))).alias("out"))

        state = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<a:int,b:int,masked:boolean,upto:int>>").alias("out"))
        return F.aggregate(spans, state, step, lambda acc: acc["out"])

    def cut(piece: Column, k: Column, runs: Column) -> Column:
        base = k * _CHARS

        def step(acc: Column, x: Column) -> Column:
            a, b = F.greatest(x["a"] - base, acc["at"]), F.least(x["b"] - base, F.lit(_CHARS))
            between = F.substring(piece, acc["at"] + 1, a - acc["at"])
            return F.struct(F.greatest(acc["at"], b).alias("at"), F.concat(acc["out"], between, F.when(x["masked"] & (x["a"] >= base), F.lit(mask)).otherwise(F.lit(""))).alias("out"))

        state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        near = F.filter(runs, lambda r: (F.get(r, F.lit(0))["a"] < base + _CHARS) & (F.element_at(r, -1)["upto"] > base))
        here = F.filter(F.flatten(near), lambda x: (x["a"] < base + _CHARS) & (x["b"] > base))
        return F.aggregate(here, state, step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.lit(_CHARS))))

    pieces = F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0))
    # long lists of spans are joined in runs, as an array that grows is copied at each step
    cuts = lambda runs: F.array_join(F.transform(pieces, lambda p, k: cut(p, k, runs)), "")
    text = F.when(F.size("spans") > 0, _let(_in_runs(F.col("spans"), joined), cuts)).otherwise(F.col(f"in_{text_col}"))
    return found.select(*((text if c == text_col else F.col(f"in_{c}")).alias(c) for c in docs.columns))


def _in_runs(spans: Column, joined: Callable[[Column], Column]) -> Column:
    """``joined`` of each block of spans. A span's end is known before it is joined, so a block begins where the spans before it end."""

    def of_blocks(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["end"])))
        before = lambda k: F.greatest(F.coalesce(F.array_max(F.slice(ends, F.lit(1), k)), F.lit(0)), F.lit(0))
        lead = lambda k: F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind"), before(k).alias("end"))
        return F.transform(blocks, lambda b, k: F.slice(joined(F.concat(F.array(lead(k)), b)), F.lit(2), F.lit(_BLOCK)))

    last = F.floor((F.size(spans) - 1) / _BLOCK).cast("int")
    return _let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(spans, k * _BLOCK + 1, F.lit(_BLOCK))), of_blocks)
