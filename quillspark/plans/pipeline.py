"""A chain of steps from a source of books or cards to a sink; nothing runs before the sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate
from ..operators import cards as c
from ..operators import translate as t
from ..sinks import anki, html, jsonl
from ..sources.books import lines_of, read_books
from ..sources.cards import read_cards
from ..storage import kept


class Pipeline:
    """``Pipeline(spark).from_text(...).pipeline().dummy_translate().to_jsonl(...)``"""

    def __init__(self, spark: SparkSession, frame: DataFrame | None = None):
        self.spark, self.frame = spark, frame

    def _with(self, frame: DataFrame) -> Pipeline:
        return Pipeline(self.spark, frame)

    def from_text(self, path: str, **how) -> Pipeline:
        return self._with(read_books(self.spark, path, **how))

    from_folder = from_text

    def from_books(self, books: DataFrame) -> Pipeline:
        """In-memory source: author, title, text."""
        return self._with(books)

    def from_tokens(self, tokens: DataFrame, maxfieldlen: int = 70) -> Pipeline:
        """Cards of a table of tokens with their heads: author, title and ``annotate.TOKEN_COLUMNS``."""
        return self._with(c.cards_of_tokens(tokens, maxfieldlen))

    def from_jsonl(self, path: str) -> Pipeline:
        cards = read_cards(self.spark, path)
        return self._with(cards.withColumn("ord", F.col("start")))

    def apply(self, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return self._with(self.frame.transform(step))

    def pipeline(self, maxfieldlen: int = 70, parsed: bool = True, model: str | None = None) -> Pipeline:
        """Cards of books. ``model`` names an annotator (see ``annotate.annotator``), whose parse then takes the place of the rule's."""
        if maxfieldlen < 30:
            raise ValueError("maxfieldlen must be at least 30")
        if model:
            lines = lines_of(self.frame.select("author", "title", "text"), keep_ends=True)
            return self._with(c.cards_of_tokens(annotate.annotator(model)(lines, True), maxfieldlen))
        return self._with(c.cards_of(self.frame, maxfieldlen, parsed))

    def observed(self, name: str, *metrics: Column) -> Pipeline:
        """Counts rows (and what ``metrics`` say) while the chain runs; a listener, or ``Observation(name)``, gets them."""
        return self._with(self.frame.observe(name, F.count(F.lit(1)).alias("cards"), *metrics))

    def skip_first_line_if_author(self) -> Pipeline:
        return self._with(c.skip_author_line(self.frame))

    def remove_title_crap_after(self, sep: str = "") -> Pipeline:
        return self._with(c.trim_titles(self.frame, sep))

    def dummy_translate(self) -> Pipeline:
        return self._with(t.dummy_translate(self.frame))

    def translate(self, make_translator: Callable[[], object], lang: str, store: str | None = None, limits: t.Limits | None = None) -> Pipeline:
        """Asks at once, and once, whatever sinks follow. With ``store``, a folder, every batch is kept there as soon as it is translated, and later runs ask for the rest only."""
        found = t.translate_into(store, self.frame, make_translator, lang, limits) if store else kept(t.translate(self.frame, make_translator, lang, limits=limits))
        return self._with(found.drop("error"))

    def to_jsonl(self, path: str, layout: str = "auto", trim: str = "", tell: Callable[[int], None] | None = None) -> None:
        jsonl.write_cards(self.frame, path, layout, trim, tell)

    def to_anki(self, path: str, structure: bool = True, fontsize: int = 30, tell: Callable[[int], None] | None = None) -> int:
        return anki.write_anki(self.frame, path, structure, fontsize, tell=tell)

    def to_sidebyside(self, path: str, fontsize: int = 30) -> None:
        html.write_side_by_side(self.frame, path, fontsize)
