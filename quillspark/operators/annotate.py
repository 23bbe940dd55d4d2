"""Sentences and tokens. The rule annotator is two regular expressions, so it runs inside the scan and shuffles nothing.

A sentence ends after terminal marks, closing marks behind them, and the white space that follows; and at a line's end. A token
is a word (letters, marks and digits, joined by apostrophes and hyphens), one other character, each with one space behind it, or
any other white space. Sentences and tokens are lossless: joined, they give the line again.

With ``tidy``, each token that is no punctuation takes the run of punctuation right behind it, across the end of a sentence too;
leading punctuation stays alone. This is how texts are read to be cut into cards; metrics count plain tokens.

Other annotators make a table of tokens (see ``TOKEN_COLUMNS``), from which ``chunking`` and ``metrics`` work as well: a table that
was annotated before, or spaCy, where it is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import let, starts_before
from ..functions.text import SPACE

Annotate = Callable[[DataFrame, bool], DataFrame]

MARK, CLOSING = r"[.!?…]", r"[.!?…)»”\x22]"
DIGITS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]+"
# Repeated groups are possessive: Java takes those in a loop, where it would recurse once a repeat. None has to give back what it took.
WORD = r"[\p{L}\p{M}\p{N}]++(?:['’\-][\p{L}\p{M}\p{N}]++)*+"
TOKEN = rf"(?:{WORD}|[^{SPACE}\p{{L}}\p{{M}}\p{{N}}]) ?|[{SPACE}]+"
_PUNCT = r"(?:\p{P} ?)*+"
# Marks that no white space follows end nothing; each run of them is passed as a whole.
_WITHIN = rf"(?:[^.!?…]++|{MARK}{CLOSING}*+(?![{SPACE}]))*+{MARK}{CLOSING}*+[{SPACE}]++"
SENTENCE = rf"(?s){_WITHIN}|.+\z"
TIDY_SENTENCE = rf"(?s){_WITHIN}{_PUNCT}|.+\z"
TIDY_TOKEN = rf"(?:(?:{WORD}|[^{SPACE}\p{{L}}\p{{M}}\p{{N}}\p{{P}}]) ?|[{SPACE}]+){_PUNCT}|\p{{P}} ?"
# Parts of a sentence's tidy tokens, as patterns. Whether a token ends, or ends a clause, is seen in the characters beside that place, so
# tokens need not be cut out to be joined. Only punctuation that leads a sentence is a token by itself.
_CLAUSE = r",;:()\[\]"
# Java looks behind by code points, and not by halves of a pair, only where the pattern itself has a character beyond 16 bits; this one is a letter.
_LETTERS = "[\\p{L}\\p{M}\\p{N}\U00010000]"
_BASE = rf"(?:(?:{WORD}|[^{SPACE}\p{{L}}\p{{M}}\p{{N}}\p{{P}}]) ?+|[{SPACE}]++)"
_MARKED = rf"(?:\p{{P}}++ (?=\p{{P}}))*+[\p{{P}}&&[^{_CLAUSE}]]*+[{_CLAUSE}]\p{{P}}*+ ?+"  # punctuation whose last run has a mark
_ENDS = rf"(?:(?:[{_CLAUSE}] ?+)++|{_BASE}{_MARKED})"
_GOES_ON = rf"(?:(?!{_ENDS})(?:\p{{P}} ?+|{_BASE}{_PUNCT}))"
_ROOT = rf"(?:[^\p{{L}}\p{{N}}]*+(?:{WORD} ?+{_MARKED}|{WORD} ?+{_PUNCT}{_GOES_ON}*+{_ENDS}?+)|(?:\p{{P}} ?+|{_BASE}{_PUNCT}){_GOES_ON}*+{_ENDS}?+)"
#: A sentence's clauses, the first with all before and around the root; each of the others begins behind a mark that comes after the root.
CLAUSE = rf"\A{_ROOT}|{_GOES_ON}*+{_ENDS}|{_GOES_ON}++"
_BORDER = rf"(?:\z|(?<!{_LETTERS})(?<!{_LETTERS}['’\-])(?={_LETTERS})|(?=[^{SPACE}\p{{L}}\p{{M}}\p{{N}}\p{{P}}])|(?<=[^{SPACE}])(?! )(?=[{SPACE}])|(?<=[^{SPACE}] )(?=[{SPACE}]))"
# Parts of a sentence's plain tokens.
_PLAIN = rf"(?:(?:{WORD}|[^{SPACE}\p{{L}}\p{{M}}\p{{N}}]) ?+|[{SPACE}]++)"
#: A token without the space behind it, as a group.
BARE = rf"({WORD}|[^{SPACE}\p{{L}}\p{{M}}\p{{N}}]|[{SPACE}]++) ?"
#: The next word as a group, behind all that is none; the group is empty at the end.
NEXT_WORD = rf"(?:{DIGITS}+(?!{_LETTERS}|['’\-]{_LETTERS})|\p{{P}}|[{SPACE}]++)*+({WORD}|[^{SPACE}\p{{L}}\p{{M}}\p{{N}}\p{{P}}]|\z)"
#: A sentence behind whose root (the first token with a letter or digit, or else the first) comes a mark, a token that is none, and another.
BRANCHED = rf"\A(?:[^\p{{L}}\p{{N}}]*+{WORD} ?+|(?=[^\p{{L}}\p{{N}}]++\z){_PLAIN})(?s:.*?)[{_CLAUSE}] ?+(?![{_CLAUSE}]){_PLAIN}(?s:.)"
SOME_TOKENS = rf"\A{_PLAIN}(?s:.)"
#: A table of tokens has these, and any keys of the book. ``head`` is the place of the governing token in the sentence, its own for the root.
TOKEN_COLUMNS = ("line_no", "sent_no", "i", "token", "head")


def sentences(line: Column, tidy: bool = False) -> Column:
    return F.regexp_extract_all(line, F.lit(TIDY_SENTENCE if tidy else SENTENCE), F.lit(0))


def tokens(sentence: Column) -> Column:
    """Tokens with the space behind them."""
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))


def bare_tokens(text: Column) -> Column:
    """Tokens of a line or sentence without the space behind them."""
    return F.regexp_extract_all(text, F.lit(BARE), F.lit(1))


def words(text: Column) -> Column:
    """Those of ``bare_tokens`` that ``is_word`` says are words."""
    return F.array_remove(F.regexp_extract_all(text, F.lit(NEXT_WORD), F.lit(1)), "")


def tidy_tokens(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(TIDY_TOKEN), F.lit(0))


def clauses(sentence: Column) -> Column:
    """The clauses of a tidy sentence, by the rule."""
    return F.regexp_extract_all(sentence, F.lit(CLAUSE), F.lit(0))


def greedy(text: Column, most: int) -> Column:
    """``text``, some whole tidy tokens of a sentence, as spans of as many tokens as are no longer than ``most`` together; longer tokens stand alone."""
    some = rf"(?s:.{{1,{most}}})"
    return F.regexp_extract_all(text, F.lit(rf"{some}{_BORDER}|(?=\p{{P}}){some}(?=\p{{P}})|{TIDY_TOKEN}"), F.lit(0))


def is_punct(token: Column) -> Column:
    return token.rlike(r"^\p{P}+ ?$")


def is_digit(token: Column) -> Column:
    return token.rlike(rf"^{DIGITS} ?$")


def is_space(token: Column) -> Column:
    return token.rlike(rf"^[{SPACE}]+$")


def is_word(token: Column) -> Column:
    return ~token.rlike(rf"^(?:\p{{P}}+|{DIGITS}|[{SPACE}]*) ?$")


def bare(token: Column) -> Column:
    """A token without the space behind it."""
    return F.when(is_space(token), token).otherwise(F.rtrim(token))


def annotate(lines: DataFrame) -> DataFrame:
    """A row a token: the columns of ``lines`` but line, with sent_no and i (both from 0), token."""
    rest = [c for c in lines.columns if c != "line"]
    by_sentence = lines.select(*rest, F.posexplode(sentences(F.col("line"))).alias("sent_no", "sentence"))
    return by_sentence.select(*rest, "sent_no", F.posexplode(tokens(F.col("sentence"))).alias("i", "token"))


def from_table(annotated: DataFrame) -> DataFrame:
    """A table annotated before (text, ws, and any keys) in the shape of ``annotate``; ``head`` stays, if there is one."""
    return annotated.withColumn("token", F.concat("text", F.coalesce("ws", F.lit("")))).drop("text", "ws")


def sentences_of(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, sent_no, tokens, heads: a row a sentence of a table of tokens.

    Places ``i`` must count from 0 without gaps or repeats, tokens must not be null, and just one token must be its own head; that
    heads are tokens of the sentence and form a tree is left to those who follow them (``trees``).
    """
    placed = F.struct(F.col("i").cast("int").alias("i"), "token", F.col("head").cast("int").alias("head"))
    each = tokens.groupBy(*keys, "line_no", "sent_no").agg(F.sort_array(F.collect_list(placed)).alias("_t"))
    roots = F.size(F.filter("_t", lambda t: t["head"] == t["i"]))
    checked = F.when(roots == 1, F.col("_t")).otherwise(F.raise_error(F.concat(F.lit("a sentence must have one root, not "), roots.cast("string"))).cast("array<struct<i:int,token:string,head:int>>"))
    gaps = F.size(F.filter("_t", lambda t, k: ~t["i"].eqNullSafe(k) | t["token"].isNull()))
    checked = F.when(gaps == 0, checked).otherwise(F.raise_error(F.lit("the places of a sentence's tokens must count from 0, and no token may be null")).cast("array<struct<i:int,token:string,head:int>>"))
    return each.select(*keys, "line_no", "sent_no", checked.alias("_t")).select(*keys, "line_no", "sent_no", F.col("_t.token").alias("tokens"), F.col("_t.head").alias("heads"))


def rule_sentences(lines: DataFrame, tidy: bool = False) -> DataFrame:
    """A table of sentences by the rule, as ``sentences_of`` makes it of ``rule_tokens``: the columns of ``lines`` but line, sent_no, tokens, heads. Nothing is gathered."""
    from .chunking import clause_heads

    rest = [c for c in lines.columns if c != "line"]
    each = lines.select(*rest, F.posexplode(sentences(F.col("line"), tidy)).alias("sent_no", "_s"))
    if not tidy:
        return each.withColumn("tokens", tokens(F.col("_s"))).select(*rest, "sent_no", "tokens", clause_heads(F.col("tokens")).alias("heads"))
    # a sentence without a mark is one clause
    parts = F.when(F.col("_s").rlike(f"[{_CLAUSE}]"), clauses(F.col("_s"))).otherwise(F.array("_s"))
    each = each.withColumn("_c", F.transform(parts, tidy_tokens))
    return each.select(*rest, "sent_no", F.flatten("_c").alias("tokens"), heads_of_clauses(F.col("_c")).alias("heads"))


def heads_of_clauses(clause_tokens: Column) -> Column:
    """The place of each token's head, by the rule, of the tokens of each clause of a sentence (see ``CLAUSE``): those of the first clause
    and the first of each other hang on the root, the others on the first of their clause."""
    lettered = lambda t: t.rlike(r"[\p{L}\p{N}]")

    def of(c: Column) -> Column:
        first = F.get(c, F.lit(0))
        root = F.when(lettered(F.get(first, F.lit(0))), 0).otherwise(F.greatest(F.array_position(F.transform(first, lettered), True).cast("int"), F.lit(1)) - 1)
        below = lambda x, k, at, r: F.when(k == 0, F.array_repeat(r, F.size(x))).otherwise(F.concat(F.array(r), F.array_repeat(F.get(at, k), F.size(x) - 1)))
        heads = lambda at, r: F.flatten(F.transform(c, lambda x, k: below(x, k, at, r)))
        return let(starts_before(F.transform(c, F.size)), lambda at: let(root, lambda r: heads(at, r)))

    return let(clause_tokens, of)


def rule_tokens(lines: DataFrame, tidy: bool = False) -> DataFrame:
    """A table of tokens by the rule, with the heads that it stands for."""
    rest = [c for c in lines.columns if c != "line"]
    each = rule_sentences(lines, tidy)
    return each.select(*rest, "sent_no", F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("heads").alias("head"))).alias("i", "_x")).select(*rest, "sent_no", "i", "_x.token", "_x.head")


def table_tokens(path: str) -> Annotate:
    """Tokens of a table that was annotated before: those of the lines that are asked for, by all their columns but line."""

    def run(lines: DataFrame, tidy: bool = False) -> DataFrame:
        names = [c for c in lines.columns if c != "line"]
        table = lines.sparkSession.read.parquet(path)
        missing = {*names, *TOKEN_COLUMNS} - set(table.columns)
        if missing:
            raise ValueError(f"{path} has no columns {sorted(missing)}")
        keys = lines.select(*(F.col(c).alias(f"_{c}") for c in names)).distinct()
        same = [table[c].eqNullSafe(keys[f"_{c}"]) for c in names]
        return table.join(keys, same, "left_semi").select(*names, *(c for c in TOKEN_COLUMNS if c not in names))

    return run


def model_tokens(lines: DataFrame, load: Callable[[], object], tidy: bool = False) -> DataFrame:
    """A table of tokens by a model as spaCy's are (``load()`` has ``pipe``; texts have ``sents`` and ``retokenize``), with heads; it is loaded once a task.

    ``tidy`` as above; a joined token has the head of its first part outside of itself.
    """
    rest = [c for c in lines.columns if c != "line"]
    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        nlp = load()
        for batch in batches:
            rows = []
            for keys, doc in zip(batch[rest].itertuples(index=False), nlp.pipe(batch["line"]), strict=True):
                if tidy:
                    with doc.retokenize() as joins:
                        at = 0
                        while at < len(doc):
                            end = at + 1
                            while not doc[at].is_punct and end < len(doc) and doc[end].is_punct:
                                end += 1
                            if end - at > 1:
                                joins.merge(doc[at:end])
                            at = end
                for s, sent in enumerate(doc.sents):
                    rows += [(*keys, s, t.i - sent.start, t.text_with_ws, t.head.i - sent.start) for t in sent]
            yield pd.DataFrame(rows, columns=[*rest, "sent_no", "i", "token", "head"])

    return lines.mapInPandas(run, f"{kinds}, sent_no int, i int, token string, head int")


def spacy_tokens(model: str) -> Annotate:
    def load() -> object:
        import spacy

        return spacy.load(model, exclude=["lemmatizer", "ner", "attribute_ruler"])

    return lambda lines, tidy=False: model_tokens(lines, load, tidy)


#: What makes an annotator, by the name before the colon, from what is behind it. An annotator takes lines (keys, line_no, line) and
#: whether tokens are tidy, and gives a table of tokens: the same keys and ``TOKEN_COLUMNS``, lossless, a tree a sentence.
ANNOTATORS: dict[str, Callable[[str], Annotate]] = {"rule": lambda _: rule_tokens, "table": table_tokens, "spacy": spacy_tokens}


def annotator(name: str) -> Annotate:
    """``rule``, ``table:PATH``, ``spacy:MODEL``, any other that was added to ``ANNOTATORS``, or just the name of a spaCy model."""
    kind, _, what = name.partition(":")
    return ANNOTATORS[kind](what) if kind in ANNOTATORS else spacy_tokens(name)


def tidy(line_tokens: Column) -> Column:
    """Each token that is no punctuation takes the run of punctuation right behind it; leading punctuation stays alone.

    White space counts as no punctuation. Joined tokens keep the blanks between them.
    """

    def joined(all_tokens: Column) -> Column:
        n = F.size(all_tokens)
        at = lambda i: F.get(all_tokens, i - 1)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        first = F.coalesce(F.array_min(F.filter(places, lambda i: ~is_punct(at(i)))), n + 1)

        def groups(x: Column) -> Column:
            ends = lambda k: F.coalesce(F.get(x["starts"], k + 1), n + 1)
            return F.transform(x["starts"], lambda i, k: F.array_join(F.slice(all_tokens, i, ends(k) - i), ""))

        starts = F.transform(F.array(F.struct(first.alias("first"))), lambda x: F.struct(F.filter(places, lambda i: (i < x["first"]) | ~is_punct(at(i))).alias("starts")))
        return F.get(F.transform(starts, groups), F.lit(0))

    # arrays are bound as variables, so that they are made once and not for each token
    return F.get(F.transform(F.array(line_tokens), joined), F.lit(0))
