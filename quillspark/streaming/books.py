"""Books as a stream of files: each new file becomes cards, written by author and title, or a row of metrics. Books are independent, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cards import cards_of
from ..operators.metrics import complexity
from ..sinks.jsonl import append_batch, write_cards
from ..sources.books import lines_of, read_books


def stream_cards(spark: SparkSession, folder: str, output: str, checkpoint: str, most: int = 70) -> StreamingQuery:
    """Takes what is there and what comes, until stopped; a batch that is run again replaces its own books."""

    def write(batch: DataFrame, _: int) -> None:
        write_cards(batch, output, layout="folder")

    cards = cards_of(read_books(spark, folder, streaming=True), most)
    return cards.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_complexity(spark: SparkSession, folder: str, output: str, checkpoint: str, known: DataFrame | None = None, frequencies: DataFrame | None = None) -> StreamingQuery:
    """A row of metrics for each book that is there or comes, appended by batch: one that is run again after a failure adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "one"
        append_batch(complexity(batch, lines_of(batch), ["author", "title"], known, frequencies), output, stream, number)

    return read_books(spark, folder, streaming=True).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
