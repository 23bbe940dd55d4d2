"""Word lists from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import numbered


def read_known_words(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """word: the second column of every row, without repeats; rows of one column have none."""
    return spark.read.option("header", header).schema("lemma string, word string").csv(path).select("word").where("word is not null").distinct()


def read_frequencies(spark: SparkSession, path: str, skip_rows: int = 2) -> DataFrame:
    """word, rank: the second of two columns and the row's number in the file, from 0; of repeated words the last counts.

    The first ``skip_rows`` rows have no rank. A row's number follows from its place among those of its input partition and the
    number of rows in earlier partitions, so that only one row a partition is in the window over all.
    """
    rows = spark.read.schema("lemma string, word string").csv(path).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumns({"part": F.shiftright("at", 33), "inside": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    starts = rows.groupBy("part").agg((F.max("inside") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = rows.join(starts, "part").select("word", (F.col("start") + F.col("inside")).alias("rank"))
    return last_rank(placed.where(F.col("rank") >= skip_rows))


def last_rank(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("word").agg(F.max("rank").alias("rank"))


def rank_words(counts: DataFrame, skip_rows: int = 2) -> DataFrame:
    """word, rank from word, n: the most frequent word first, ties by word; numbers begin at ``skip_rows``."""
    ordered = numbered(counts.select("word", (-F.col("n")).alias("down")), ["down", "word"])
    return ordered.select("word", (F.col("number") + skip_rows).cast("long").alias("rank"))
