"""Translations by any object with ``translate_text(texts, target_lang=...)``, in batches, for cards that have none yet.

A translator may refuse. What it raises tells by ``http_status_code`` what to do: a batch that is too large (413) is asked again in
halves, down to single texts; where it is asked too often or is out of order (429, 5xx) it is asked again after a pause that
doubles; where nothing is left of its quota (456) it is asked no more by that task. Anything else fails the batch. A text without a
translation keeps its blank, with the reason.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import reverse_text
from ..storage import folder_url, is_folder, kept, running, write_file

TOO_LARGE, TOO_OFTEN, NOTHING_LEFT = 413, 429, 456


@dataclass(frozen=True)
class Limits:
    """Texts a batch, how often and after what pause (in seconds, doubled each time) to ask again, and characters to ask for over all tasks (None: any number)."""

    batch: int = 200
    retries: int = 4
    pause: float = 1.0
    characters: int | None = None


def dummy_translate(cards: DataFrame, force: bool = False) -> DataFrame:
    """The text backwards, where there is no translation."""
    return cards.withColumn("translation", F.when((F.col("translation") == "") | F.lit(force), reverse_text(F.col("text"))).otherwise(F.col("translation")))


class Asking:
    """A task's translator, made when it is first asked."""

    def __init__(self, make_translator: Callable[[], object], language: str, limits: Limits):
        self.make, self.language, self.limits = make_translator, language, limits
        self.translator = self.refused = None

    def ask(self, texts: list[str]) -> list[tuple[str | None, str | None]]:
        """A translation or the reason why there is none, for each."""
        if self.refused:
            return [(None, self.refused)] * len(texts)
        pause = self.limits.pause
        for turn in range(self.limits.retries + 1):
            try:
                self.translator = self.translator or self.make()
                got = [str(getattr(x, "text", x)) for x in self.translator.translate_text(texts, target_lang=self.language)]
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} translations of {len(texts)} texts")
                return [(x, None) for x in got]
            except Exception as e:  # the service's own errors
                status, reason = getattr(e, "http_status_code", None), f"{type(e).__name__}: {e}"
                if status == TOO_LARGE and len(texts) > 1:
                    half = len(texts) // 2
                    return self.ask(texts[:half]) + self.ask(texts[half:])
                if status == NOTHING_LEFT:
                    self.refused = reason
                if not (status == TOO_OFTEN or (status or 0) >= 500) or turn == self.limits.retries:
                    return [(None, reason)] * len(texts)
                time.sleep(pause)
                pause *= 2
        raise AssertionError


def translate(cards: DataFrame, make_translator: Callable[[], object], language: str, batch: int = 200, force: bool = False, limits: Limits | None = None) -> DataFrame:
    """Translates blanks only, with ``error`` for the reason where that failed. The translator is made once a task.

    A task that is run again translates again; ``translate_into`` keeps what was translated.
    """
    limits = limits or Limits(batch)
    todo = F.lit(True) if force else F.col("translation") == ""
    done = cards.where(~todo).withColumn("error", F.lit(None).cast("string"))
    names = cards.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = Asking(make_translator, language, limits)
        for b in batches:
            for i in range(0, len(b), limits.batch):
                some = b.slice(i, limits.batch)
                texts, old = (some.column(names.index(c)).to_pylist() for c in ("text", "translation"))
                found = asking.ask(texts)
                got = [o if t is None else t for (t, _), o in zip(found, old, strict=True)]
                columns = [pa.array(got, pa.string()) if n == "translation" else c for n, c in zip(names, some.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([e for _, e in found], pa.string())], [*names, "error"])

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in cards.schema)
    return done.unionByName(cards.where(todo).mapInArrow(run, f"{kinds}, error string"))


def _write(folder: str, table: pa.Table) -> None:
    out = pa.BufferOutputStream()
    pq.write_table(table, out)
    write_file(folder, f"{uuid.uuid4().hex}.parquet", out.getvalue().to_pybytes())


_STORED = "key string, translation string, error string"


def stored(spark: SparkSession, store: str, language: str) -> DataFrame:
    """key and translation of all texts that ``store`` has in a language; one row a text."""
    folder = f"{store.rstrip('/')}/{language}"
    if not is_folder(spark, folder):
        return spark.createDataFrame([], "key string, translation string")
    return spark.read.schema(_STORED).parquet(folder).where("translation is not null").groupBy("key").agg(F.min("translation").alias("translation"))


def translate_into(store: str, cards: DataFrame, make_translator: Callable[[], object], language: str, limits: Limits | None = None) -> DataFrame:
    """As ``translate``, with a folder of translations that outlasts the run: a text is asked for once, in whatever cards and runs it is.

    Each batch is written to the folder, by language, as soon as it is translated, so a run that ends early, or loses an executor, has what it
    got, and the next run asks for the rest only. Texts are known by their digest. ``limits.characters`` bounds what a run asks for: texts
    are taken in the order of their digests until their lengths come to it, over all tasks; the others keep their blank, with the reason.
    """
    spark, limits = cards.sparkSession, limits or Limits()
    key = F.sha2("text", 256)
    blank = F.col("translation") == ""
    wanted = cards.where(blank).groupBy(key.alias("key")).agg(F.first("text").alias("text"))
    left = wanted.join(stored(spark, store, language), "key", "left_anti")
    if limits.characters is not None:
        left = running(left.withColumn("_n", F.length("text")), ["key"], "_n").where(F.col("total") <= limits.characters)
    folder = folder_url(spark, f"{store.rstrip('/')}/{language}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = Asking(make_translator, language, limits)
        for b in batches:
            for i in range(0, len(b), limits.batch):
                some = b.slice(i, limits.batch)
                found = asking.ask(some.column(1).to_pylist())
                table = pa.table({"key": some.column(0), "translation": pa.array([t for t, _ in found], pa.string()), "error": pa.array([e for _, e in found], pa.string())})
                _write(folder, table)
                yield from table.select(["key", "error"]).filter(pc.is_valid(table.column("error"))).to_batches()

    errors = left.select("key", "text").mapInArrow(run, "key string, error string")
    failed = kept(errors)  # asks, once
    got = stored(spark, store, language)
    out = cards.withColumn("_key", F.when(blank, key))
    out = out.join(got.select(F.col("key").alias("_key"), F.col("translation").alias("_new")), "_key", "left").join(failed.select(F.col("key").alias("_key"), "error"), "_key", "left")
    late = F.when(blank & F.col("_new").isNull(), F.coalesce("error", F.lit("beyond the characters of this run")))
    return out.select(*(F.coalesce("_new", "translation").alias(c) if c == "translation" else F.col(c) for c in cards.columns), late.alias("error"))
