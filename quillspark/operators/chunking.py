"""Books cut into chunks no longer than a limit, along the grammar.

The steps: within a sentence, tokens are joined along its tree, inner subtrees first; the spans of a line's sentences are joined;
then those of neighbouring lines. A join takes neighbours as long as both fit. Each step is a greedy fold over an array
(``functions.folds``), so cutting the text of a book runs inside its scan, in the JVM, and shuffles nothing.

Without heads a rule stands in for the parse: clauses behind marks hang on the root, so a depth never exceeds 3, and the tree is two
folds more. Trees that are given as a table of tokens with their heads are joined by a kernel over flat buffers (``trees``), which
gets lengths and heads of a batch of sentences, whatever book they are of.

A book may come in parts, each a row of some of its lines in order. Then parts are folded apart: a part says how long the chunk is
that is open at its end for each length that may be open at its start; these are put together in order, a few numbers a part, and
each part is cut from what it starts with. No task ever has more than one part of a book's text.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ANY, PIECES, fold, joined_items, let, pieces
from ..functions.text import SPACE, strip
from ..storage import kept
from . import annotate, trees

#: Lines of a table of tokens that make a part.
PART_LINES = 2_000
_CLAUSE = r",;:()\[\]"
#: Heights of borders: before tokens of a clause, before clauses, sentences and lines, and where neighbouring lines can't be joined.
_TOKEN, _CLAUSES, _SENTENCES, _LINES, _CLOSED = range(5)


def _ends_open(text: Column) -> Column:
    """Whether a span's last token has a space behind it, which is no part of the span, so that nothing follows right behind the span."""
    return F.right(text, F.lit(2)).rlike(rf"[^{SPACE}] \z")


def _with_clauses(tokens: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the place of a sentence's root and, for each token, whether it begins a clause, by the rule.

    The first token with a letter or digit is the root. Behind a mark of a clause that comes after the root (or in the punctuation at the
    root's end) the next token that is no mark alone begins a clause.
    """
    ends = rf"[{_CLAUSE}]\p{{P}}* *\z"

    def kind(t: Column) -> Column:
        word = F.when(t.rlike(ends), "C").otherwise("a")
        return F.when(t.rlike(rf"^[{_CLAUSE}] ?\z"), "m").when(t.rlike(r"[\p{L}\p{N}]"), word).when(t.rlike(ends), "c").otherwise("x")

    def of_kinds(kinds: Column) -> Column:
        root = F.greatest(F.instr(F.translate(F.array_join(kinds, ""), "C", "a"), "a"), F.lit(1)) - 1

        def begins(k: Column, i: Column, root: Column) -> Column:
            before = F.get(kinds, i - 1)
            return F.coalesce((i > root) & (k != "m") & ((before == "C") | (before.isin("m", "c") & (i - 1 > root))), F.lit(False))

        return let(root, lambda r: let(F.transform(kinds, lambda k, i: begins(k, i, r)), lambda flags: body(r, flags)))

    return let(F.transform(tokens, kind), of_kinds)


def clause_heads(tokens: Column) -> Column:
    """The place of each token's head, by the rule: clauses hang on the root, other tokens on the first of their clause."""

    def heads(root: Column, flags: Column) -> Column:
        begun = F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
        last = lambda b, i: F.coalesce(F.array_max(F.filter(b, lambda x: x <= i)), root)
        return let(begun, lambda b: F.transform(flags, lambda x, i: F.when(x, root).otherwise(last(b, i))))

    return _with_clauses(tokens, heads)


def _each(frame: DataFrame, column: str, body: Callable[[Column], Column]) -> DataFrame:
    """``body`` of each item of an array column. Steps are columns of their own, as Spark resolves a few levels of nested functions in a pass and gives up at a hundred passes."""
    return frame.withColumn(column, F.transform(column, body))


def _folded(frame: DataFrame, column: str, most: int, level: int) -> DataFrame:
    """``ps`` of each item of an array column, folded."""
    return _each(frame, column, lambda x: F.struct(x["line"].alias("line"), x["tokens"].alias("tokens"), fold(x["ps"], most, level).alias("ps")))


def _texts(books: DataFrame, most: int, parsed: bool) -> DataFrame:
    """``books`` with ``_texts``, the texts of the spans of all lines, in the place of text. A line that fits is one span, and is not even cut into tokens."""
    parts = F.split("text", "\n", -1)
    frame = books.withColumn("_x", parts).drop("text")
    frame = frame.withColumn("_x", F.transform("_x", lambda p, i: F.when(i < F.size("_x") - 1, F.concat(p, F.lit("\n"))).otherwise(p)))
    frame = frame.withColumn("_x", F.filter("_x", lambda p: p != ""))
    # a sentence that fits is one span; of others, the spans of each clause, found by a pattern, are the items that are joined
    spans = lambda s: F.flatten(F.transform(annotate.clauses(s), lambda c: annotate.greedy(c, most))) if parsed else annotate.greedy(s, most)
    items = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(spans(s))
    cut = lambda line: F.transform(annotate.sentences(line, tidy=True), items)
    frame = _each(frame, "_x", lambda line: F.struct(line.alias("line"), F.when(F.length(line) > most, cut(line)).otherwise(F.array().cast("array<array<string>>")).alias("sentences")))
    borders = lambda s: F.transform(s, lambda t, i: F.when(i == 0, _SENTENCES).otherwise(_CLAUSES))
    frame = _each(frame, "_x", lambda x: F.struct(x["line"].alias("line"), F.flatten(x["sentences"]).alias("tokens"), F.flatten(F.transform(x["sentences"], borders)).alias("cuts")))
    frame = _each(frame, "_x", lambda x: F.struct(x["line"].alias("line"), x["tokens"].alias("tokens"), x["cuts"].alias("cuts"), F.transform(x["tokens"], F.length).alias("n")))
    frame = _each(frame, "_x", lambda x: F.struct(x["line"].alias("line"), x["tokens"].alias("tokens"), pieces(x["n"], x["cuts"]).alias("ps")))
    for level in (_SENTENCES, _LINES) if parsed else (_LINES,):
        frame = _folded(frame, "_x", most, level)
    frame = _each(frame, "_x", lambda x: F.when(F.size(x["tokens"]) == 0, F.array(x["line"])).otherwise(joined_items(x["tokens"], x["ps"])))
    return frame.withColumn("_texts", F.flatten("_x")).drop("_x")


def _text_pieces(frame: DataFrame, first: int) -> DataFrame:
    """``frame`` with ``_p``, pieces of ``_texts``, the spans of lines; ``first`` is the border before all of them."""
    frame = frame.withColumn("_p", F.transform("_texts", lambda t, i: F.struct(F.length(t).alias("n"), _ends_open(t).alias("open"))))
    cuts = F.transform("_p", lambda x, i: F.when(i == 0, first).when(F.get("_p", i - 1)["open"], _CLOSED).otherwise(_LINES))
    return frame.withColumn("_cuts", cuts).withColumn("_p", pieces(F.col("_p.n"), F.col("_cuts"))).drop("_cuts")


def _cut(texts: DataFrame, rest: list[str], most: int, across: bool) -> DataFrame:
    """A row a chunk, of whole books: ``rest``, ord, start, end, text."""
    frame = _text_pieces(texts, _CLOSED)
    if across:
        frame = frame.withColumn("_p", fold(F.col("_p"), most, _CLOSED)).withColumn("_texts", joined_items(F.col("_texts"), F.col("_p")))
    spans = F.zip_with("_p", "_texts", lambda x, t: F.struct(x["at"].cast("bigint").alias("start"), (x["end"] - F.when(_ends_open(t), 1).otherwise(0)).cast("bigint").alias("end"), t.alias("text")))
    each = frame.select(*rest, F.posexplode(spans).alias("ord", "_s"))
    return each.select(*rest, F.col("ord").cast("long").alias("ord"), "_s.start", "_s.end", "_s.text")


def chunks(books: DataFrame, most: int | None = 70, parsed: bool = True, across: bool = True) -> DataFrame:
    """A row a chunk: the columns of ``books`` but text, with ord (from 0), start, end, text. Joined in order, the texts are the book.

    A null or empty text has no chunks.
    """
    rest = [c for c in books.columns if c != "text"]
    return _cut(_texts(books.where(F.length("text") > 0), most or ANY, parsed), rest, most or ANY, across)


def parts_of(books: DataFrame, lines: int) -> DataFrame:
    """``books`` in parts of so many lines: a row a part, with its number from 0."""
    rest = [c for c in books.columns if c != "text"]

    def of_lines(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / lines).cast("int")
        # what ends a part's last line stays with it
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.concat(F.array_join(F.slice(x, k * lines + 1, F.lit(lines)), "\n"), F.when(k < last, F.lit("\n")).otherwise(F.lit(""))))

    return books.select(*rest, F.posexplode(let(F.split("text", "\n", -1), of_lines)).alias("part", "text")).where("text <> ''")


def chunks_of_parts(parts: DataFrame, keys: list[str], most: int = 70, parsed: bool = True) -> DataFrame:
    """As ``chunks``, of books that come in parts: ``keys`` name a book, ``part``, a whole number, orders its parts, and ``text`` has some whole lines."""
    return _chunks_of_texts(_texts(parts.where(F.length("text") > 0).select(*keys, "part", "text"), most, parsed), keys, most)


def _chunks_of_texts(texts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Chunks of books from the spans of their lines (``_texts``), by part. Lengths are folded by kernels (``trees``), texts stay in the JVM."""

    @F.arrow_udf("array<struct<open:int,n:int>>")
    def ends(lengths: pa.Array, first: pa.Array) -> pa.Array:
        return trees.ends_of(lengths, first, most)

    @F.arrow_udf(PIECES)
    def spans_of(lengths: pa.Array, opened: pa.Array) -> pa.Array:
        return trees.spans_of(lengths, opened, most)

    lengths = F.transform("_texts", lambda t: F.when(_ends_open(t), F.bitwise_not(F.length(t))).otherwise(F.length(t)))
    parts = kept(texts.select(*keys, "part", "_texts", lengths.alias("_lengths")))
    # nothing is open before a part with the least number of all, which is the first of its book
    least = parts.agg(F.min("part")).first()[0] or 0
    size = F.aggregate("_lengths", F.lit(0).cast("bigint"), lambda a, n: a + F.when(n < 0, F.bitwise_not(n)).otherwise(n))
    facts = parts.select(*keys, "part", size.alias("_n"), ends("_lengths", F.col("part") == least).alias("_ends"))

    # what each part starts with: an open chunk's length, the place in the book, the number of its first chunk, and whether its last chunk is open when the next begins
    start = F.struct(F.lit(0).alias("open"), F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("first"), F.array().cast("array<struct<part:bigint,open:int,base:bigint,first:bigint>>").alias("out"))
    entry = lambda acc, x: F.struct(x["part"].cast("bigint").alias("part"), acc["open"].alias("open"), acc["base"].alias("base"), acc["first"].alias("first"))
    end = lambda acc, x: F.get(x["_ends"], acc["open"])
    following = lambda acc, x: F.struct(end(acc, x)["open"].alias("open"), (acc["base"] + x["_n"]).alias("base"), (acc["first"] + end(acc, x)["n"]).alias("first"), F.concat(acc["out"], F.array(entry(acc, x))).alias("out"))
    ordered = facts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "_n", "_ends"))).alias("_f"))
    entries = ordered.select(*keys, F.aggregate("_f", start, following, lambda acc: acc["out"]).alias("_e"))
    entries = entries.select(*keys, F.explode(F.transform("_e", lambda x, i: F.struct(x.alias("of"), F.coalesce(F.get("_e", i + 1)["open"] > 0, F.lit(False)).alias("goes_on")))).alias("_e"))
    begun = kept(entries.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_e.of.part").alias("_part"), F.col("_e.of.open").alias("_open"), F.col("_e.of.base").alias("_base"), F.col("_e.of.first").alias("_first"), F.col("_e.goes_on").alias("_goes_on")))

    def cut(begun: DataFrame) -> DataFrame:
        same = [*(parts[k].eqNullSafe(begun[f"_{k}"]) for k in keys), parts["part"] == begun["_part"]]
        placed = parts.join(begun, same).select(*keys, "part", "_open", "_base", "_first", "_goes_on", "_texts", "_lengths")
        spans = placed.withColumn("_s", spans_of("_lengths", "_open"))
        own = F.zip_with("_s", joined_items(F.col("_texts"), F.col("_s")), lambda x, t: F.struct((F.col("_base") + x["at"]).alias("start"), t.alias("text")))
        return spans.withColumn("_own", F.transform(own, lambda x, i: F.struct((F.col("_first") + i).alias("ord"), x["start"].alias("start"), x["text"].alias("text"))))

    whole = F.size("_own") - F.when(F.col("_goes_on"), 1).otherwise(0)
    every = cut(begun).select(*keys, F.explode(F.slice("_own", F.lit(1), F.greatest(whole, F.lit(0)))).alias("_c")).select(*keys, "_c.*")
    # a chunk that goes over the end of a part is known by where it began; only parts that have one are looked at again
    edges = cut(begun.where("_open > 0 or _goes_on"))
    first = F.coalesce(F.get("_s", F.lit(0))["i"], F.size("_texts"))
    head = F.struct(F.lit(-1).cast("bigint").alias("ord"), (F.col("_base") - F.col("_open")).alias("start"), F.array_join(F.slice("_texts", F.lit(1), first), "").alias("text"))
    none = F.slice("_own", F.lit(1), F.lit(0))
    edges = edges.select(*keys, "part", F.explode(F.concat(F.when(first > 0, F.array(head)).otherwise(none), F.when(F.col("_goes_on"), F.slice("_own", F.lit(-1), F.lit(1))).otherwise(none))).alias("_c")).select(*keys, "part", "_c.*")
    edges = edges.groupBy(*keys, "start").agg(F.max("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("part", "text"))).alias("_t"))
    every = every.unionByName(edges.select(*keys, "ord", "start", F.array_join("_t.text", "").alias("text")))
    return every.select(*keys, "ord", "start", (F.col("start") + F.length("text") - F.when(_ends_open(F.col("text")), 1).otherwise(0)).alias("end"), "text")


def chunks_of_tokens(tokens: DataFrame, keys: list[str], most: int | None = 70, across: bool = True) -> DataFrame:
    """As ``chunks``, of a table of tokens with their heads (see ``annotate``)."""
    return chunks_of_sentences(annotate.sentences_of(tokens, keys), keys, most, across)


def chunks_of_sentences(sentences: DataFrame, keys: list[str], most: int | None = 70, across: bool = True) -> DataFrame:
    """As ``chunks``, of a table of sentences: keys, line_no, sent_no, tokens, heads. They are put together by parts of ``PART_LINES`` lines."""

    @F.arrow_udf("array<int>")
    def begins(lengths: pa.Array, heads: pa.Array) -> pa.Array:
        return trees.begins_of(lengths, heads, most)

    @F.arrow_udf(PIECES)
    def spans_of(lengths: pa.Array, counts: pa.Array, lines: pa.Array) -> pa.Array:
        return trees.spans_of_lines(lengths, counts, lines, most or ANY)

    found = sentences.withColumn("_b", begins(F.transform("tokens", F.length), F.col("heads")))
    place = F.transform("_b", lambda i: F.struct(i.alias("i"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(0).alias("cut"))).cast(PIECES)
    found = found.select(*keys, "line_no", "sent_no", joined_items(F.col("tokens"), place).alias("_t"))
    in_parts = bool(most) and across
    part = F.floor(F.col("line_no") / PART_LINES).cast("int") if in_parts else F.lit(0)
    gathered = found.groupBy(*keys, part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("line_no", "sent_no", "_t"))).alias("_s"))

    gathered = gathered.select(*keys, "part", F.flatten("_s._t").alias("_items"), spans_of(F.transform(F.flatten("_s._t"), F.length), F.transform("_s._t", F.size), F.col("_s.line_no")).alias("_p"))
    texts = gathered.select(*keys, "part", joined_items(F.col("_items"), F.col("_p")).alias("_texts"))
    return _chunks_of_texts(texts, keys, most) if in_parts else _cut(texts, keys, most or ANY, across)


def depths_of_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """A row a sentence of a table of tokens with their heads: keys, line_no, sent_no, depth."""

    @F.arrow_udf("int")
    def heights(heads: pa.Array) -> pa.Array:
        return trees.heights_of(heads)

    return annotate.sentences_of(tokens, keys).select(*keys, "line_no", "sent_no", heights("heads").alias("depth"))


def line_offsets(lines_with_ends: DataFrame, *book: str) -> DataFrame:
    """The first character of each line in its book: the sum of the lines before it."""
    before = Window.partitionBy(*book).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines_with_ends.withColumn("start", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)).cast("long"))


def clause_depth(tokens: Column) -> Column:
    """The height of the rule's tree, from the kinds of a sentence's tokens: marks of clauses (m), tokens with a letter or digit (a), others (x).

    A clause behind a mark after the root (the first a, or else the first token) has a height of its own if it has more than its first token.
    """
    kind = lambda t: F.when(t.rlike(r"^[,;:()\[\]] ?$"), "m").when(t.rlike(r"[\p{L}\p{N}]"), "a").otherwise("x")
    kinds = F.array_join(F.transform(tokens, kind), "")
    behind = F.call_function("substring", kinds, F.greatest(F.instr(kinds, "a"), F.lit(1)) + 1)
    return F.when(behind.rlike("m[ax]."), 3).when(F.size(tokens) > 1, 2).otherwise(F.size(tokens))


def sentence_depth(sentence: Column) -> Column:
    """``clause_depth`` of a sentence's text."""
    return F.when(sentence.rlike(annotate.BRANCHED), 3).when(sentence.rlike(annotate.SOME_TOKENS), 2).otherwise(F.least(F.length(sentence), F.lit(1)))


def depths(lines: DataFrame) -> DataFrame:
    """A row a sentence of stripped lines: the columns of ``lines`` but line, sent_no, depth (by the stand-in for a parse, 1 to 3)."""
    rest = [c for c in lines.columns if c != "line"]
    found = lines.select(*rest, F.posexplode(annotate.sentences(strip(F.col("line")))).alias("sent_no", "_sentence"))
    return found.select(*rest, "sent_no", sentence_depth(F.col("_sentence")).alias("depth"))
