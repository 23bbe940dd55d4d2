"""Books side by side with their translation, as one HTML page each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape
from ..storage import write_books


def side_by_side(cards: DataFrame, font_size: int = 30) -> DataFrame:
    """author, title, html: a table row a card in the book's order."""
    row = F.concat(F.lit("<tr><td>"), html_escape(F.col("text")), F.lit("</td><td>"), html_escape(F.col("translation")), F.lit("</td></tr>"))
    books = cards.select("author", "title", "ord", row.alias("_row")).groupBy("author", "title").agg(F.array_sort(F.collect_list(F.struct("ord", "_row"))).alias("_rows"))
    head = F.concat(F.lit('<html><head><meta charset="utf-8"><title>'), html_escape(F.col("title")), F.lit(f"</title></head><body style=\"font-size:{font_size}px\"><table>"))
    return books.select("author", "title", F.concat(head, F.array_join(F.col("_rows._row"), "\n"), F.lit("</table></body></html>")).alias("html"))


def write_side_by_side(cards: DataFrame, path: str, font_size: int = 30) -> int:
    """A page <author>/<title>.html for each book, and how many there are."""
    pages = side_by_side(cards, font_size)
    return write_books(pages.select("author", "title", F.lit(0).alias("ord"), F.col("html").alias("value")), path, ".html")
