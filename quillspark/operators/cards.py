"""Cards: from books, with context, cleaned, as notes of decks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as f
from .chunking import chunks, chunks_of_tokens

BOOK = ("author", "title")


def cards_of(books: DataFrame, most: int | None = 70, parsed: bool = True) -> DataFrame:
    return chunks(books, most, parsed).select("author", "title", "ord", "start", "end", "text", F.lit("").alias("translation"))


def cards_of_tokens(tokens: DataFrame, most: int | None = 70) -> DataFrame:
    """As ``cards_of``, of a table of tokens with their heads."""
    return chunks_of_tokens(tokens, list(BOOK), most).select("author", "title", "ord", "start", "end", "text", F.lit("").alias("translation"))


def with_context(cards: DataFrame) -> DataFrame:
    """prev and next: the texts beside a card in its book, '' at the book's ends."""
    order = Window.partitionBy(*BOOK).orderBy("ord")
    return cards.withColumns({"prev": F.lag("text", 1, "").over(order), "next": F.lead("text", 1, "").over(order)})


def skip_author_line(cards: DataFrame) -> DataFrame:
    """The first card of each book loses its first line if that is the author; with nothing else in it, or empty, it is dropped."""
    first = cards.groupBy(*BOOK).agg(F.min("ord").alias("_first"))
    lines = f.split_lines(F.col("text"))
    is_author = F.get(lines, F.lit(0)) == F.col("author")
    marked = cards.join(first, list(BOOK)).withColumn("_here", F.col("ord") == F.col("_first"))
    cut = F.col("_here") & F.coalesce(is_author, F.lit(False))
    dropped = F.col("_here") & ((F.col("text") == "") | (cut & (F.size(lines) == 1)))
    out = marked.where(~dropped)
    out = out.withColumns({"start": F.when(cut, F.col("start") + F.length("author") + 1).otherwise(F.col("start")), "text": F.when(cut, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n")).otherwise(F.col("text"))})
    return out.select(*cards.columns)


def trim_titles(cards: DataFrame, separator: str = "", keep_if_absent: bool = False) -> DataFrame:
    return cards.withColumn("title", f.trim_title(F.col("title"), separator, keep_if_absent))


def notes(cards: DataFrame, structure: bool = True) -> DataFrame:
    """Cards with context as notes: escaped string fields, the deck's name and id, and a stable guid."""
    deck = f.deck_name(F.col("author"), F.col("title"), structure)
    fields: dict[str, Column] = {c: f.html_escape(F.col(c)) for c in ("author", "title", "prev", "text", "next", "translation")} | {c: F.col(c).cast("string") for c in ("start", "end")}
    return cards.select(f.deck_id(deck).alias("deck_id"), f.html_escape(deck).alias("deck_name"), "ord", *(c.alias(k) for k, c in fields.items()), f.note_guid(F.col("author"), F.col("title"), F.col("end")).alias("guid"))
