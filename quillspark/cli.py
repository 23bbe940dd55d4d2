"""Command line: ``flashcards`` runs a chain of steps, ``complexity`` profiles a book or a folder of books.

    python -m quillspark.cli flashcards from-text book.txt pipeline --maxfieldlen 70 dummy-translate to-jsonl cards.jsonl
    python -m quillspark.cli complexity books/ --knownmorphs known.csv --frequencycsv freq.csv --outputfilename rows.jsonl
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import annotate
from .operators.metrics import complexity
from .operators.translate import Limits
from .plans.pipeline import Pipeline
from .sinks import jsonl
from .sources.books import lines_of, read_books
from .sources.lexicon import read_frequencies, read_known_words

#: Steps with their positional arguments and options.
STEPS = {
    "from-text": (["inputfile"], {}),
    "from-folder": (["inputfolder"], {}),
    "from-jsonl": (["path"], {}),
    "skip-first-line-if-author": ([], {}),
    "remove-title-crap-after": ([], {"--sep": str}),
    "pipeline": ([], {"--maxfieldlen": int, "--model": str}),
    "translate": ([], {"--lang": str, "--translator": str, "--key": str, "--store": str, "--characters": int}),
    "dummy-translate": ([], {}),
    "to-jsonl": (["path"], {"--trim": str}),
    "to-anki": (["path"], {"--fontsize": int}),
    "to-sidebyside": (["path"], {"--fontsize": int}),
}


def _chain(words: list[str]) -> list[argparse.Namespace]:
    starts = [i for i, w in enumerate(words) if w in STEPS and (not i or words[i - 1] not in STEPS or not STEPS[words[i - 1]][0])]
    out = []
    for i, end in zip(starts, [*starts[1:], len(words)], strict=True):
        parser = argparse.ArgumentParser(prog=words[i])
        places, options = STEPS[words[i]]
        for p in places:
            parser.add_argument(p)
        for o, kind in options.items():
            parser.add_argument(o, type=kind, default=argparse.SUPPRESS)
        out.append((words[i], parser.parse_args(words[i + 1 : end])))
    return out


def translator(name: str, key: str | None):
    """Makes translators: ``name`` is module:class, which is called with the key, if there is one (also from $TRANSLATOR_KEY)."""
    module, _, kind = name.partition(":")
    key = key or os.environ.get("TRANSLATOR_KEY")
    made = getattr(importlib.import_module(module), kind)
    return (lambda: made(key)) if key else made


def flashcards(spark: SparkSession, words: list[str]) -> None:
    """Runs the steps in order. A chain without a sink does nothing."""
    chain = Pipeline(spark)
    for name, args in _chain(words):
        given = vars(args)
        places = [given.pop(p) for p in STEPS[name][0]]
        if name == "translate":
            places, given = [translator(given["translator"], given.get("key")), given["lang"], given.get("store"), Limits(characters=given.get("characters"))], {}
        chain = getattr(chain, name.replace("-", "_"))(*places, **given)


def profile(spark: SparkSession, words: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="complexity")
    parser.add_argument("input")
    parser.add_argument("--lang", default="")
    parser.add_argument("--pipeline", help="an annotator (rule, table:PATH, spacy:MODEL or just a MODEL), whose tokens, sentences and trees then take the place of the rule's")
    parser.add_argument("--knownmorphs")
    parser.add_argument("--frequencycsv")
    parser.add_argument("--outputfilename")
    args = parser.parse_args(words)
    books = read_books(spark, args.input)
    known = read_known_words(spark, args.knownmorphs) if args.knownmorphs else None
    frequencies = read_frequencies(spark, args.frequencycsv) if args.frequencycsv else None
    lines = lines_of(books)
    tokens = annotate.annotator(args.pipeline)(lines, False) if args.pipeline else None
    rows = complexity(books, lines, ["title", "author"], known, frequencies, tokens=tokens).select(F.lit(args.lang).alias("lang"), "*").orderBy("author", "title")
    if args.outputfilename:
        jsonl.append_rows(rows, args.outputfilename)
    else:
        jsonl.show_row(rows)


def main(argv: list[str] | None = None) -> int:
    command, *words = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    {"flashcards": flashcards, "complexity": profile}[command](spark, words)
    return 0


if __name__ == "__main__":
    sys.exit(main())
