"""JSON lines: cards in one file or in a file a book, complexity rows appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_title
from ..schemas import CARD
from ..storage import write_books, write_one


def as_json(cards: DataFrame) -> DataFrame:
    return cards.select(F.to_json(F.struct(*(F.col(x.name) for x in CARD.fields))).alias("value"), *[c for c in ("author", "title", "ord") if c in cards.columns])


def write_cards(cards: DataFrame, path: str, layout: str = "auto", separator: str = "", tell: Callable[[int], None] | None = None) -> None:
    """``layout``: ``file`` for one file in order, ``folder`` for a file <author>/<title>.jsonl per book, ``table`` for a folder
    author=.../title=... per book, which Spark reads back with its columns; ``auto`` is ``file`` for the suffix .jsonl, else ``folder``.

    A book that is written again replaces its file or folder; others stay. All its cards are kept, wherever they stood. With a file per book,
    ``tell`` hears how many are finished.
    """
    named = cards if layout == "file" or not separator else cards.withColumn("title", trim_title(F.col("title"), separator))
    named = as_json(named if "ord" in named.columns else named.withColumn("ord", F.col("start")))
    if layout == "file" or (layout == "auto" and path.endswith(".jsonl")):
        write_one(named, ["author", "title", "ord"], path)
    elif layout == "table":
        sorted_ = named.repartition("author", "title").sortWithinPartitions("author", "title", "ord").select("value", "author", "title")
        sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("author", "title").text(path)
    else:
        write_books(named, path, ".jsonl", tell)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_batch(rows: DataFrame, path: str, stream: str, batch: int) -> None:
    """Appends a stream's batch of rows; a batch that is run again takes the place of what it left before, so no row is there twice."""
    rows.write.mode("overwrite").json(f"{path}/stream={stream}/batch={batch}")


def show_row(rows: DataFrame) -> None:
    """Metrics of a book as two columns, to the console."""
    names = [c for c in rows.columns]
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in names)
    rows.selectExpr(f"stack({len(names)}, {pairs}) as (metric, value)").show(len(names) * 100, truncate=False)
