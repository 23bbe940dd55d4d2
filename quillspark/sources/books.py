"""Books as tables: author, title, text. A book is a file <author>/<title>.txt, or a row of any table with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import let
from ..functions.text import strip, universal_newlines
from ..storage import is_file


def path_properties(path: Column, author_mode: str = "stem") -> tuple[Column, Column]:
    """Author (parent folder) and title (file) of a file's URL, both without their suffix; ``author_mode="name"`` keeps the folder's."""
    parts = F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/")
    stem = lambda name: F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    folder = F.element_at(parts, -2)
    return (stem(folder) if author_mode == "stem" else folder), stem(F.element_at(parts, -1))


def read_books(spark: SparkSession, path: str, author_mode: str = "stem", streaming: bool = False) -> DataFrame:
    """One text file, whatever its name, or all ``*.txt`` below a folder; files whose names begin with ``_`` or ``.`` are Spark's own and left out."""
    reader = (spark.readStream if streaming else spark.read).format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if streaming:
        reader = reader.schema("value string")
    if not is_file(spark, path):
        reader = reader.option("pathGlobFilter", "*.txt")
    author, title = path_properties(F.col("_metadata.file_path"), author_mode)
    return reader.load(path).select(author.alias("author"), title.alias("title"), universal_newlines(F.col("value")).alias("text"))


def read_book_parts(spark: SparkSession, path: str, author_mode: str = "stem", lines: int = 20_000) -> DataFrame:
    """Books of any size: author, title, part, text, a row for so many lines of a book at most; ``chunking.chunks_of_parts`` takes them.

    Files are read by splits, so a task never has a whole book. Parts are numbered by their split's place in the file and their place in
    the split. The texts of a book's parts, joined, are what ``read_books`` has: line ends are ``\\n``, and the last line has one if it has one there.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if not is_file(spark, path):
        reader = reader.option("pathGlobFilter", "*.txt")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), place.alias("at"))
    part = F.shiftleft(F.col("block").cast("long"), 20) + F.floor(F.col("at") / lines)
    ended = F.regexp_replace(F.regexp_replace("value", r"\r\z", ""), r"\r", "\n")
    parts = rows.groupBy("file", "size", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", ended.alias("line")))).alias("_l"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"))
    files = rows.groupBy("file").agg(F.max(part).alias("last"), F.sum(F.octet_length("value").cast("long") + 1).alias("total"))
    joined = parts.join(files, "file").withColumn("open", (F.col("part") == F.col("last")) & (F.col("total") > F.col("size")))
    author, title = path_properties(F.col("file"), author_mode)
    text = F.concat(F.array_join("_l.line", "\n"), F.when(F.col("open"), F.lit("")).otherwise(F.lit("\n")))
    return joined.select(author.alias("author"), title.alias("title"), "part", text.alias("text"))


def spread(books: DataFrame) -> DataFrame:
    """``books``, a plain scan, dealt to all cores where its files have fewer parts with rows than there are cores.

    Large inputs have many more parts than that and are left where they are; so nothing but small inputs is ever shuffled.
    """
    cores = books.sparkSession.sparkContext.defaultParallelism
    return books.repartition(cores) if books.rdd.getNumPartitions() < cores else books


def books_of(table: DataFrame, text: str, title: str, author: str, *more: str) -> DataFrame:
    """Rows of a table as books."""
    return table.select(F.col(author).cast("string").alias("author"), F.col(title).cast("string").alias("title"), universal_newlines(F.col(text)).alias("text"), *more)


def union_books(*books: DataFrame) -> DataFrame:
    out, *rest = books
    for b in rest:
        out = out.unionByName(b)
    return out


def lines_of(books: DataFrame, keep_ends: bool = False) -> DataFrame:
    """A row a line: the columns of ``books`` but text, line_no (from 0), line. Stripped, or with its line end as it is."""
    rest = [c for c in books.columns if c != "text"]

    def of(parts: Column) -> Column:  # what follows a last line end is no line
        if keep_ends:
            return F.filter(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit("\n"))).otherwise(p)), lambda p: p != "")
        return F.transform(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), strip)

    # all within the array: what a line needs of its whole text is found once a text, not once a line
    return books.select(*rest, F.posexplode(let(F.split("text", "\n", -1), of)).alias("line_no", "line"))
