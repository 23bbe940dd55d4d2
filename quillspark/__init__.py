"""Book analytics and flashcards as DataFrame transformations."""

from .operators.annotate import annotator
from .operators.cards import cards_of, cards_of_tokens, notes, skip_author_line, trim_titles, with_context
from .operators.chunking import chunks, chunks_of_parts, chunks_of_tokens, parts_of
from .operators.metrics import Metric, Metrics, Ratio, complexity, standard_metrics
from .operators.translate import Limits, dummy_translate, translate, translate_into
from .plans.pipeline import Pipeline
from .schemas import CARD
from .sinks.anki import write_anki
from .sinks.html import write_side_by_side
from .sinks.jsonl import write_cards
from .sources.books import books_of, lines_of, read_book_parts, read_books
from .sources.cards import read_cards
from .sources.lexicon import read_frequencies, read_known_words

__all__ = [
    "CARD", "Limits", "Metric", "Metrics", "Pipeline", "Ratio", "annotator", "books_of", "cards_of", "cards_of_tokens", "chunks", "chunks_of_parts", "chunks_of_tokens", "complexity", "dummy_translate", "lines_of", "notes", "parts_of", "read_book_parts", "read_books", "read_cards", "read_frequencies", "read_known_words", "skip_author_line", "standard_metrics", "translate", "translate_into", "trim_titles", "with_context", "write_anki", "write_cards", "write_side_by_side",
]
