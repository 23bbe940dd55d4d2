"""Single files: what a path names, several sorted parts as one file, a file for each book; and rows kept and numbered for them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _opened(spark: SparkSession, path: str):
    """The file system and the full path, for the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(where)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is one existing file; patterns and folders are not."""
    if any(c in path for c in "*?[{"):
        return False
    system, where = _opened(spark, path)
    return system.exists(where) and system.getFileStatus(where).isFile()


def is_folder(spark: SparkSession, path: str) -> bool:
    system, where = _opened(spark, path)
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def folder_url(spark: SparkSession, path: str) -> str:
    """The full path, as tasks open it."""
    return _url(str(_opened(spark, path)[1]))


def write_file(folder: str, name: str, data: bytes) -> None:
    """``data`` under its name all at once: a task that is run again, or twice, leaves the same file."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    draft = f"{base}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{base}/{name}")


def kept(frame: DataFrame) -> DataFrame:
    """``frame``, made once: a checkpoint in the folder that the cluster shares (a temporary one where all tasks run on this machine)."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(found)
    return frame.checkpoint()


def numbered(rows: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """``rows`` with ``number``, from 0, in ``order``; of their own ``group``, if one is named, by which ``order`` then begins.

    Rows are sorted by range and kept, as limits that were drawn again could differ. What is summed up over partitions is a row for each,
    or for each group in each.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), at.alias("_at")))
    named = [F.col(group).alias("_group")] if group else [F.lit(0).alias("_group")]
    counts = dealt.groupBy("_part", *named).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(F.col("_part").alias("_p"), "_group", (before - F.col("_first")).alias("_shift"))
    same = (dealt["_part"] == places["_p"]) & (dealt[group].eqNullSafe(places["_group"]) if group else F.lit(True))
    return dealt.join(places, same).withColumn("number", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_group", "_shift")


def running(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` in ``order`` up to and with each row. Sorted by range, and kept, as in ``numbered``."""
    dealt = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(before, F.col("_part") == F.col("_p")).withColumn("total", F.col("_before") + F.col("_inside")).drop("_part", "_p", "_before", "_inside")


def _url(path: str) -> str:
    """A path as Arrow takes it."""
    return f"file://{path.removeprefix('file:')}" if path.startswith("file:/") and not path.startswith("file://") else path


def write_one(lines: DataFrame, order: list[str], path: str) -> None:
    """The column ``value`` as one file, in order, which appears whole.

    Tasks sort and write parts. The sizes of the parts before it say where each belongs. On a file system that joins files (HDFS) the
    parts are joined by name; on a shared or local disk each task copies its part to its place in the one file. No line passes
    through the driver, but on stores that can do neither, where it joins the parts as streams of bytes.
    """
    spark = lines.sparkSession
    system, target = _opened(spark, path)
    if system.exists(target) and system.getFileStatus(target).isDirectory():
        raise IsADirectoryError(path)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    draft = path_of(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex}")
    folder = f"{draft}.parts"
    lines.orderBy(*order).select("value").write.text(folder)
    parts = sorted((s.getPath().getName(), s.getLen()) for s in system.listStatus(path_of(folder)) if s.getPath().getName().startswith("part-"))
    parts = [(name, size) for name, size in parts if size]
    try:
        if system.getScheme() == "file":
            _place_parts(spark, folder, parts, str(draft))
        else:
            _join_parts(spark, system, folder, [name for name, _ in parts], draft)
        if system.exists(target):
            system.delete(target, False)
        system.rename(draft, target)
    finally:
        system.delete(path_of(folder), True)
        system.delete(draft, False)


def _place_parts(spark: SparkSession, folder: str, parts: list[tuple[str, int]], draft: str) -> None:
    """Each task copies a part to its place in one file, which all of them open."""
    starts = [0, *accumulate(size for _, size in parts)]
    local = lambda url: _url(url).removeprefix("file://")
    source, goal = local(folder), local(draft)
    with open(goal, "wb") as out:
        out.truncate(starts[-1])

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(f"{source}/{name}", "rb") as part, open(goal, "r+b") as out:
                    out.seek(at)
                    while some := part.read(1 << 20):
                        out.write(some)
            yield batch.select(["at"])

    if parts:
        rows = [(name, at) for (name, _), at in zip(parts, starts, strict=False)]
        spark.createDataFrame(rows, "name string, at long").repartition(len(rows)).mapInArrow(copy, "at long").write.format("noop").mode("overwrite").save()


def _join_parts(spark: SparkSession, system, folder: str, names: list[str], draft) -> None:
    """Parts joined by the file system, or, where it can't, by the driver as streams."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = system.create(draft)
    try:
        if system.hasPathCapability(draft, "fs.capability.paths.concat"):
            out.close()
            several = spark.sparkContext._gateway.new_array(path_of, len(names))
            for i, name in enumerate(names):
                several[i] = path_of(folder, name)
            if names:
                system.concat(draft, several)
            return
        for name in names:
            source = system.open(path_of(folder, name))
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    finally:
        out.close()


@contextmanager
def progress(spark: SparkSession, tell: Callable[[int], None] | None) -> Iterator[Callable[[], None]]:
    """What tasks call for each thing (a book, a package) that they have finished. ``tell`` hears the number while the job runs, as tasks end, and at the end.

    A task that runs again counts again, so the number is for people to look at.
    """
    if not tell:
        yield lambda: None
        return
    done, over = spark.sparkContext.accumulator(0), threading.Event()
    told = [0]

    def look() -> None:
        if done.value > told[0]:
            told[0] = done.value
            tell(told[0])

    def watch() -> None:
        while not over.wait(0.2):
            look()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield lambda: done.add(1)
    finally:
        over.set()
        watcher.join()
        look()


def write_books(rows: DataFrame, folder: str, suffix: str, tell: Callable[[int], None] | None = None) -> int:
    """A file <author>/<title><suffix> for each book of ``rows`` (author, title, ord, value), and how many there are. Other files stay.

    A book is written by one task as a stream, under a draft name until it is whole, so a task that runs again leaves the same files.
    Null names are empty ones; names that fall together ('/' becomes '_') share a file. ``tell`` hears how many are finished (``progress``).
    """
    spark = rows.sparkSession
    root = folder_url(spark, folder)
    named = rows.select(F.coalesce("author", F.lit("")).alias("author"), F.coalesce("title", F.lit("")).alias("title"), "ord", "value")
    shown = lambda c: F.when(F.col(c).isin("", ".", ".."), F.concat(F.lit("_"), F.translate(c, ".", "_"))).otherwise(F.translate(c, "/\0", "__"))
    named = named.select(shown("author").alias("_folder"), shown("title").alias("_file"), "author", "title", "ord", "value")
    sorted_ = named.repartition("_folder", "_file").sortWithinPartitions("_folder", "_file", "author", "title", "ord")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        now, out, n = None, None, 0

        def finish() -> None:
            out.close()
            system.move(draft(now), f"{base}/{now[0]}/{now[1]}{suffix}")
            finished()

        mark = uuid.uuid4().hex

        def draft(book: tuple[str, str]) -> str:
            return f"{base}/{book[0]}/_{book[1]}.{mark}"

        try:
            for batch in batches:
                for author, title, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (author, title) != now:
                        if out:
                            finish()
                        now, n = (author, title), n + 1
                        system.create_dir(f"{base}/{author}", recursive=True)
                        out = system.open_output_stream(draft(now))
                    out.write(f"{value}\n".encode())
            if out:
                finish()
        except BaseException:
            if out and not out.closed:
                out.close()
                system.delete_file(draft(now))
            raise
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    with progress(spark, tell) as finished:
        return sorted_.select("_folder", "_file", "value").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
