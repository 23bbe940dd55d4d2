"""Complexity metrics of books: sums over sentences and tokens in one pass, and ratios of them.

A metric is a number for each token or each sentence, which is summed; a ratio divides two metrics. ``Metrics`` holds them in
order, and new ones can be added. Everything but the vocabulary metrics is summed within a sentence's array of tokens, so the
only shuffle is that of one partial sum for each book and task. Vocabulary metrics depend on a token's text alone: tokens are
counted by book and text first and then looked up; Spark chooses how to join by the size of the word list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import level_of, percentage, ratio
from ..schemas import LEVELS
from . import annotate


@dataclass(frozen=True)
class Metric:
    """A value of each sentence: ``of_token`` (a number for a token, summed), ``of_words`` (for its words), ``of_sentence`` (for all its tokens) or ``of_text`` (for its text).

    ``combine`` joins the values of sentences, by default as a sum; any aggregate will do, and values may be of any type, maps too.
    ``zero`` is the value of a book without sentences. The result is finished by ``finish``. Hidden metrics only serve ratios.
    """

    name: str
    of_token: Callable[[Column], Column] | None = None
    of_sentence: Callable[[Column], Column] | None = None
    finish: Callable[[Column], Column] = lambda total: total
    hidden: bool = False
    of_words: Callable[[Column], Column] | None = None
    combine: Callable[[Column], Column] = F.sum
    zero: Callable[[], Column] = lambda: F.lit(0)
    of_text: Callable[[Column], Column] | None = None

    def in_sentence(self, tokens: Column, words: Column, text: Column) -> Column:
        if self.of_sentence or self.of_words or self.of_text:
            value = self.of_sentence(tokens) if self.of_sentence else self.of_words(words) if self.of_words else self.of_text(text)
            return value.cast("long") if self.combine is F.sum else value
        return F.aggregate(tokens, F.lit(0).cast("long"), lambda total, t: total + self.of_token(t).cast("long"))


@dataclass(frozen=True)
class Ratio:
    name: str
    numerator: str
    denominator: str
    percent: bool = False

    def column(self) -> Column:
        return (percentage if self.percent else ratio)(F.col(self.numerator), F.col(self.denominator)).alias(self.name)


@dataclass
class Metrics:
    metrics: list[Metric] = field(default_factory=list)
    ratios: list[Ratio] = field(default_factory=list)

    def add(self, metric: Metric) -> Metrics:
        self.metrics.append(metric)
        return self

    def add_ratio(self, one: Ratio) -> Metrics:
        self.ratios.append(one)
        return self

    def __getitem__(self, name: str) -> Metric | Ratio:
        for m in [*self.metrics, *self.ratios]:
            if m.name == name:
                return m
        raise KeyError(name)


def standard_metrics() -> Metrics:
    out = Metrics()
    out.add(Metric("word_count", of_words=F.size))
    out.add(Metric("sentence_count", of_sentence=lambda tokens: F.lit(1)))
    out.add(Metric("word_length", of_words=lambda words: F.length(F.array_join(words, "")), hidden=True))
    out.add_ratio(Ratio("mean_words_per_sentence", "word_count", "sentence_count"))
    out.add_ratio(Ratio("mean_word_length", "word_length", "word_count"))
    return out


def by_sentence(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A row a sentence: keys, its text, its tokens, and its words without the space behind them. What no metric asks for is not made."""
    each = lines.select(*keys, F.explode(annotate.sentences(F.col("line"))).alias("_sentence"))
    return each.select(*keys, "_sentence", annotate.tokens(F.col("_sentence")).alias("_tokens"), annotate.words(F.col("_sentence")).alias("_words"))


def totals(lines: DataFrame, keys: list[str], metrics: Metrics, tokens: DataFrame | None = None) -> DataFrame:
    """All metrics by ``keys``, in one pass: of lines, or of a table of tokens."""
    if tokens is not None:
        each = annotate.sentences_of(tokens, keys)
        sentences = each.select(*keys, F.array_join("tokens", "").alias("_sentence"), F.col("tokens").alias("_tokens"), F.transform(F.filter("tokens", annotate.is_word), lambda t: F.rtrim(t)).alias("_words"))
    else:
        sentences = by_sentence(lines, keys)
    values = sentences.select(*keys, *(m.in_sentence(F.col("_tokens"), F.col("_words"), F.col("_sentence")).alias(m.name) for m in metrics.metrics))
    return values.groupBy(*keys).agg(*(m.combine(F.col(m.name)).alias(m.name) for m in metrics.metrics))


def token_counts(lines: DataFrame, keys: list[str], tokens: DataFrame | None = None) -> DataFrame:
    """keys, word (a token's text), n."""
    if tokens is None:
        every = lines.select(*keys, F.explode(annotate.bare_tokens(F.col("line"))).alias("word"))
    else:
        every = tokens.select(*keys, annotate.bare(F.col("token")).alias("word"))
    return every.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def words_known(counts: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Tokens that are in the word list, or digits."""
    seen = counts.join(known.select("word").distinct().withColumn("_known", F.lit(True)), "word", "left")
    return seen.groupBy(*keys).agg(F.sum(F.when(F.col("_known") | annotate.is_digit(F.col("word")), F.col("n")).otherwise(0)).alias("words_known"))


def histogram(counts: DataFrame, keys: list[str], frequencies: DataFrame, levels=LEVELS, ranked_only: bool = False) -> DataFrame:
    """keys, level, n: all tokens by the level of their lower-case form; those without a rank have level 0 (or are left out)."""
    found = counts.withColumn("_lower", F.lower("word")).join(frequencies.select(F.col("word").alias("_lower"), "rank"), "_lower", "inner" if ranked_only else "left")
    return found.groupBy(*keys, level_of(F.coalesce("rank", F.lit(0)), levels).alias("level")).agg(F.sum("n").alias("n"))


def percentile_level(levels: DataFrame, keys: list[str], name: str, percent: int = 95) -> DataFrame:
    """The least level up to which more than ``percent`` of the tokens are. There are as many rows a key as bands."""
    upto = Window.partitionBy(*keys).orderBy("level")
    placed = levels.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    return placed.where(F.col("_upto") * 100 > F.col("_all") * percent).groupBy(*keys).agg(F.min("level").alias(name))


def complexity(books: DataFrame, lines: DataFrame, keys: list[str], known: DataFrame | None = None, frequencies: DataFrame | None = None, levels=LEVELS, depth: bool = True, metrics: Metrics | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """A row a book: its keys, the metrics, the vocabulary metrics whose word lists are given, and the ratios. Empty books have zeros.

    ``tokens``, a table of tokens with their heads (see ``annotate``), takes the place of the rule's tokens and trees.
    """
    from .chunking import depths_of_tokens, sentence_depth

    metrics = metrics or standard_metrics()
    every = Metrics([*metrics.metrics], [*metrics.ratios])
    if depth and tokens is None:
        every.add(Metric("grammar_depth", of_text=sentence_depth, hidden=True)).add_ratio(Ratio("mean_grammar_depth", "grammar_depth", "sentence_count"))
    shown = [m.name for m in every.metrics if not m.hidden]
    parts = [totals(lines, keys, every, tokens)]
    if depth and tokens is not None:
        parts.append(depths_of_tokens(tokens, keys).groupBy(*keys).agg(F.sum("depth").alias("grammar_depth")))
        every.add_ratio(Ratio("mean_grammar_depth", "grammar_depth", "sentence_count"))
    if known is not None or frequencies is not None:
        counts = token_counts(lines, keys, tokens)
        if known is not None:
            parts.append(words_known(counts, keys, known))
            shown.append("words_known")
            every.add_ratio(Ratio("percent_words_known", "words_known", "word_count", percent=True))
        if frequencies is not None:
            parts.append(percentile_level(histogram(counts, keys, frequencies, levels), keys, "vocab_level"))
            shown.append("vocab_level")
    out = books.select(*keys).distinct()
    for p in parts:  # keys may be null
        named = p.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in p.columns if c not in keys))
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
        out = out.join(named, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    zeros = {m.name: m for m in every.metrics}
    names = [c for c in out.columns if c not in keys]
    out = out.select(*keys, *(F.coalesce(c, zeros[c].zero() if c in zeros else F.lit(0)).alias(c) for c in names))
    finished = [zeros[n].finish(F.col(n)).alias(n) if n in zeros else F.col(n) for n in shown]
    return out.select(*keys, *finished, *(r.column() for r in every.ratios))
