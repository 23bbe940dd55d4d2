"""Anki packages: a package is one SQLite file in a ZIP, made by one task; many notes make many packages, which an import joins, as decks keep their ids."""

from __future__ import annotations

import hashlib
import io
import json
import sqlite3
import string
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cards import notes, with_context
from ..storage import folder_url, is_folder, numbered, progress, write_file

#: Notes of one package.
MOST_NOTES = 50_000
# Fixed values of the format.
DIGITS = string.ascii_letters + string.digits + "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
MODEL_ID = 1356306641
MODEL_NAME = "Book Snippet"
FIELDS = ("author", "title", "start", "end", "prev", "current", "next", "translation")
FRONT = '<div class="context">{{prev}}</div><div class="now">{{current}}</div><div class="context">{{next}}</div>'
BACK = "{{FrontSide}}<hr id=answer><div class=\"translation\">{{translation}}</div>"

_TABLES = """
create table col (id integer primary key, crt integer, mod integer, scm integer, ver integer, dty integer, usn integer, ls integer, conf text, models text, decks text, dconf text, tags text);
create table notes (id integer primary key, guid text, mid integer, mod integer, usn integer, tags text, flds text, sfld text, csum integer, flags integer, data text);
create table cards (id integer primary key, nid integer, did integer, ord integer, mod integer, usn integer, type integer, queue integer, due integer, ivl integer, factor integer, reps integer, lapses integer, left integer, odue integer, odid integer, flags integer, data text);
create table revlog (id integer primary key, cid integer, usn integer, ease integer, ivl integer, lastIvl integer, factor integer, time integer, type integer);
create table graves (usn integer, oid integer, type integer);
"""


def style(font_size: int) -> str:
    return f".card {{ font-size: {font_size}px; text-align: center; }} .context {{ color: gray; }} .translation {{ font-style: italic; }}"


def model(font_size: int = 30) -> dict:
    template = {"name": "Card 1", "qfmt": FRONT, "afmt": BACK, "ord": 0, "did": None, "bqfmt": "", "bafmt": ""}
    fields = [{"name": f, "ord": i, "font": "Arial", "size": 20, "rtl": False, "sticky": False, "media": []} for i, f in enumerate(FIELDS)]
    return {"id": MODEL_ID, "name": MODEL_NAME, "type": 0, "mod": 0, "usn": -1, "sortf": 0, "did": 1, "tmpls": [template], "flds": fields, "css": style(font_size), "req": [[0, "any", [5]]], "tags": [], "vers": [], "latexPre": "", "latexPost": ""}


def base91(digest: str) -> str:
    """The first eight bytes of a digest (hexadecimal) as a number in base 91, the form of guids in packages."""
    n, out = int(digest[:16], 16), ""
    while n:
        n, digit = divmod(n, 91)
        out = DIGITS[digit] + out
    return out


def package(rows: Iterable[tuple], font_size: int) -> bytes:
    """A package of notes: (deck_id, deck_name, guid, author, title, start, end, prev, text, next, translation) in order. The database is made in memory."""
    db = sqlite3.connect(":memory:")
    db.executescript(_TABLES)
    decks: dict[int, str] = {}
    for n, (deck, name, guid, *fields) in enumerate(rows, 1):
        decks[deck] = name
        checksum = int(hashlib.sha1(fields[0].encode()).hexdigest()[:8], 16)
        db.execute("insert into notes values (?, ?, ?, 0, -1, '', ?, ?, ?, 0, '')", (n, base91(guid), MODEL_ID, "\x1f".join(fields), fields[0], checksum))
        db.execute("insert into cards values (?, ?, ?, 0, 0, -1, 0, 0, ?, 0, 0, 0, 0, 0, 0, 0, 0, '')", (n, n, deck, n))
    described = {str(i): {"id": i, "name": name, "mod": 0, "usn": -1, "collapsed": False, "desc": "", "dyn": 0, "conf": 1, "newToday": [0, 0], "revToday": [0, 0], "lrnToday": [0, 0], "timeToday": [0, 0]} for i, name in {1: "Default", **decks}.items()}
    db.execute("insert into col values (1, 0, 0, 0, 11, 0, 0, 0, '{}', ?, ?, ?, '{}')", (json.dumps({str(MODEL_ID): model(font_size)}), json.dumps(described), json.dumps({"1": {"id": 1, "name": "Default"}})))
    db.commit()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in (("collection.anki2", db.serialize()), ("media", b"{}")):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    db.close()
    return out.getvalue()


_COLUMNS = ("deck_id", "deck_name", "guid", "author", "title", "start", "end", "prev", "text", "next", "translation")


def write_anki(cards: DataFrame, path: str, structure: bool = True, font_size: int = 30, most: int = MOST_NOTES, tell: Callable[[int], None] | None = None) -> int:
    """Packages of all cards, a deck a book, written by tasks, and the number of notes.

    A path that ends in ``.apkg`` is one file with all decks; with more than ``most`` notes, others follow it (name-2.apkg, ...), in the order
    of decks and cards. Any other path is a folder with a package for each deck, or several for a large one. No note passes through the
    driver. ``tell`` hears how many packages are finished. A task has one package at a time in memory; it writes a package under a draft name, so a task that runs again leaves the same files.
    """
    spark = cards.sparkSession
    single = path.endswith(".apkg")
    if single and is_folder(spark, path):
        raise IsADirectoryError(path)
    named = notes(with_context(cards), structure).withColumn("_package", F.lit("") if single else F.col("deck_name"))
    placed = numbered(named, ["_package", "deck_name", "ord"], "_package").withColumn("_shard", F.floor(F.col("number") / most))
    root, stem = (path.rpartition("/")[0] or ".", path.rpartition("/")[2].removesuffix(".apkg")) if single else (path, "")
    root = folder_url(spark, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, rows = 0, None, []

        def finish() -> int:
            name = stem or now[0].translate({ord("/"): "_", 0: "_"})
            write_file(root, f"{name}-{now[1] + 1}.apkg" if now[1] else f"{name}.apkg", package(rows, font_size))
            finished()
            return len(rows)

        for batch in batches:
            for deck, shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (deck, shard) != now:
                    if rows:
                        total += finish()
                    now, rows = (deck, shard), []
                rows.append(tuple(row))
        if rows:
            total += finish()
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    together = placed.repartition("_package", "_shard").sortWithinPartitions("_package", "_shard", "number")
    with progress(spark, tell) as finished:
        n = together.select("_package", "_shard", *_COLUMNS).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n and single:
        write_file(root, f"{stem}.apkg", package([], font_size))
    return n
