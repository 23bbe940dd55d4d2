"""Translators that refuse, translations that outlast a run, annotators by name, progress, and streams of metrics."""

import shutil

import pytest
from pyspark.sql import functions as F

from quillspark.operators import annotate, chunking
from quillspark.operators.translate import Asking, Limits, translate_into
from quillspark.plans.pipeline import Pipeline
from quillspark.sinks import jsonl
from quillspark.sources import books as b
from quillspark.streaming.books import stream_complexity

NO_PAUSE = Limits(batch=8, retries=3, pause=0.0)


class Refusal(Exception):
    def __init__(self, status):
        super().__init__(f"status {status}")
        self.http_status_code = status


class Picky:
    """Takes at most ``most`` characters at once, never the text "no", and is busy the first ``busy`` times."""

    def __init__(self, most=20, busy=0, quota=None):
        self.most, self.busy, self.quota, self.asked = most, busy, quota, []

    def translate_text(self, texts, target_lang):
        self.asked.append(list(texts))
        if self.busy:
            self.busy -= 1
            raise Refusal(429)
        if self.quota is not None and sum(map(len, texts)) > self.quota:
            raise Refusal(456)
        if sum(map(len, texts)) > self.most or "no" in texts:
            raise Refusal(413)
        self.quota = self.quota if self.quota is None else self.quota - sum(map(len, texts))
        return [t.upper() for t in texts]


def asking(translator, limits=NO_PAUSE):
    return Asking(lambda: translator, "xx", limits)


def test_batches_that_are_too_large_are_halved():
    picky = Picky(20)
    texts = ["a" * 9, "b" * 9, "c" * 9, "d" * 25, "no", "e"]
    got = asking(picky).ask(texts)
    assert [t for t, _ in got] == ["A" * 9, "B" * 9, "C" * 9, None, None, "E"] and [e is None for _, e in got] == [True, True, True, False, False, True]
    assert all(sum(map(len, x)) > 20 or "no" in x or len(x) <= 2 for x in picky.asked)


def test_busy_services_are_asked_again_and_empty_ones_are_not():
    picky = Picky(100, busy=3)
    assert asking(picky).ask(["a", "b"]) == [("A", None), ("B", None)] and len(picky.asked) == 4
    assert asking(Picky(100, busy=4)).ask(["a"]) == [(None, "Refusal: status 429")]
    poor = asking(Picky(100, quota=3))
    assert [poor.ask(["aaa"]), poor.ask(["b"]), poor.ask(["c"])] == [[("AAA", None)], [(None, "Refusal: status 456")], [(None, "Refusal: status 456")]]
    assert len(poor.translator.asked) == 2


def cards(spark, texts, done=()):
    rows = [("a", "t", i, 0, 1, t, "old" if i in done else "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "author string, title string, ord long, start long, end long, text string, translation string").repartition(3)


class Noted:
    """Upper case; notes what it was asked for in a folder, and dies at the text ``bad``."""

    def __init__(self, folder, bad=None):
        self.folder, self.bad = folder, bad

    def translate_text(self, texts, target_lang):
        import uuid

        (self.folder / uuid.uuid4().hex).write_text("\n".join(texts))
        if self.bad in texts:
            raise KeyboardInterrupt  # as a killed worker: no error of the service
        return [t.upper() for t in texts]


def test_a_run_that_was_killed_asks_for_the_rest_only(spark, tmp_path):
    store, texts = str(tmp_path / "store"), [f"text {i}" for i in range(60)] + ["text 1", "text 2"]
    asked = lambda name: sorted(t for f in (tmp_path / name).iterdir() for t in f.read_text().split("\n"))
    for name in ("one", "two", "three"):
        (tmp_path / name).mkdir()
    folder = tmp_path / "one"
    with pytest.raises(Exception):
        translate_into(store, cards(spark, texts, {0}).coalesce(1), lambda: Noted(folder, "text 33"), "xx", Limits(batch=4))
    kept = {r.key for r in spark.read.parquet(f"{store}/xx").collect()}
    assert 0 < len(kept) < 59
    folder = tmp_path / "two"
    rows = translate_into(store, cards(spark, texts, {0}), lambda: Noted(folder), "xx", Limits(batch=4)).orderBy("ord").collect()
    assert [r.translation for r in rows] == ["old", *(t.upper() for t in texts[1:])] and {r.error for r in rows} == {None}
    assert len(asked("two")) == 59 - len(kept) == len(set(asked("two")))
    folder = tmp_path / "three"
    assert translate_into(store, cards(spark, texts), lambda: Noted(folder), "xx").where("translation = ''").count() == 0 and asked("three") == ["text 0"]
    frame = Pipeline(spark, cards(spark, texts)).translate(lambda: Noted(folder), "xx", store).frame
    assert "error" not in frame.columns and frame.where("translation <> upper(text)").count() == 0 and asked("three") == ["text 0"]


def test_characters_of_a_run(spark, tmp_path):
    texts = [f"{i:04}" for i in range(50)]
    (tmp_path / "asked").mkdir()
    folder = tmp_path / "asked"
    rows = translate_into(str(tmp_path / "store"), cards(spark, texts), lambda: Noted(folder), "xx", Limits(characters=83)).collect()
    assert sum(r.translation != "" for r in rows) == 20 and {r.error for r in rows if not r.translation} == {"beyond the characters of this run"}
    rows = translate_into(str(tmp_path / "store"), cards(spark, texts), lambda: Noted(folder), "xx", Limits(characters=1000)).collect()
    assert all(r.translation for r in rows)


class Token:
    def __init__(self, text, i, head):
        self.text_with_ws, self.i, self.head_i = text, i, head
        self.is_punct = text.strip() in (",", ".", "!")


class Text:
    """As a parsed text is: words and marks, a sentence ends at a full stop; each hangs on the one before."""

    def __init__(self, line):
        import re

        self.tokens = [Token(t, i, max(0, i - 1)) for i, t in enumerate(re.findall(r"[^\s.,!]+ ?|[.,!] ?|\s+", line))]

    def __len__(self):
        return len(self.tokens)

    def __getitem__(self, at):
        return self.tokens[at]

    def retokenize(self):
        text, joins = self, []

        class Joins:
            def __enter__(self):
                return self

            def merge(self, span):
                joins.append(span)

            def __exit__(self, *_):
                gone = {t.i for span in joins for t in span[1:]}
                for span in joins:
                    span[0].text_with_ws = "".join(t.text_with_ws for t in span)
                text.tokens = [t for t in text.tokens if t.i not in gone]
                for i, t in enumerate(text.tokens):
                    t.i, t.head_i = i, max(0, i - 1)

        return Joins()

    @property
    def sents(self):
        start, out = 0, []
        for t in self.tokens:
            if "." in t.text_with_ws or t is self.tokens[-1]:
                out.append(Sentence(self.tokens[start : t.i + 1], start))
                start = t.i + 1
        return out


class Sentence(list):
    def __init__(self, tokens, start):
        super().__init__(tokens)
        self.start = start
        for t in tokens:
            t.head = tokens[max(0, t.head_i - start)]


class Model:
    def pipe(self, texts):
        return map(Text, texts)


LINES = ["One, two. Three!", "a (b, c) d; e.", "x", "  ", "— so, he said, it's \"fine\": yes, no.", "..."]


@pytest.mark.parametrize("tidy", [False, True])
@pytest.mark.parametrize("name", ["rule", "table", "stand-in"])
def test_contract_of_annotators(spark, tmp_path, monkeypatch, name, tidy):
    """Keys and the columns of tokens; lossless; places from 0; a tree a sentence."""
    monkeypatch.setitem(annotate.ANNOTATORS, "stand-in", lambda _: lambda lines, tidy: annotate.model_tokens(lines, Model, tidy))
    books = spark.createDataFrame([("a", "t", "\n".join(LINES)), (None, "u", "other book.")], "author string, title string, text string")
    lines = b.lines_of(books, keep_ends=True)
    if name == "table":
        annotate.annotator("rule")(lines, tidy).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "tokens"))
        with pytest.raises(ValueError, match="no columns"):
            annotate.annotator(f"table:{tmp_path / 'tokens'}")(lines.withColumn("part", F.lit(1)), tidy)
        name, lines = f"table:{tmp_path / 'tokens'}", lines.where("title = 't'")
    got = annotate.annotator(name)(lines, tidy)
    assert set(got.columns) == {"author", "title", *annotate.TOKEN_COLUMNS}
    joined = {}
    for r in sorted(got.collect(), key=lambda r: (r.title, r.line_no, r.sent_no, r.i)):
        joined[r.title, r.line_no] = joined.get((r.title, r.line_no), "") + r.token
    assert joined == {(r.title, r.line_no): r.line for r in lines.collect()}
    assert chunking.depths_of_tokens(got, ["author", "title"]).where("depth < 1").count() == 0
    texts = chunking.chunks_of_tokens(got, ["author", "title"], 12).orderBy("title", "ord").collect()
    assert "".join(r.text for r in texts if r.title == "t") == "\n".join(LINES)


def test_annotators_are_found_by_name(spark):
    with pytest.raises(Exception, match="spacy"):
        annotate.annotator("fi_core_news_sm")(spark.createDataFrame([("a", 0, "x")], "title string, line_no int, line string"), False).collect()
    frame = Pipeline(spark).from_books(spark.createDataFrame([("a", "t", "One, two. Three!")], "author string, title string, text string"))
    assert frame.pipeline(30, model="rule").frame.select("text").collect() == frame.pipeline(30).frame.select("text").collect()


def test_progress_a_book(spark, tmp_path):
    ticks = []
    rows = [("a", f"t{i}", 0, 0, 1, "x", "") for i in range(3)]
    frame = spark.createDataFrame(rows, "author string, title string, ord long, start long, end long, text string, translation string")
    jsonl.write_cards(frame, str(tmp_path / "out"), "folder", tell=ticks.append)
    assert ticks and ticks[-1] == 3 and ticks == sorted(set(ticks))
    ticks.clear()
    Pipeline(spark, frame).to_anki(str(tmp_path / "decks"), tell=ticks.append)
    assert ticks[-1] == 3 and len(list((tmp_path / "decks").iterdir())) == 3


def test_stream_of_metrics_takes_each_batch_once(spark, tmp_path):
    (tmp_path / "in" / "ann").mkdir(parents=True)
    (tmp_path / "in" / "ann" / "one.txt").write_text("One two. Three.")
    run = lambda: stream_complexity(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (tmp_path / "in" / "ann" / "two.txt").write_text("Four.")
    run()
    rows = lambda: sorted((r.title, r.word_count) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert rows() == [("one", 3), ("two", 1)]
    # the last batch is run again, as after a driver that died before it noted the end
    newest = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    shutil.rmtree(tmp_path / "check" / "commits" / f".{newest.name}.crc", ignore_errors=True)
    (tmp_path / "check" / "commits" / f".{newest.name}.crc").unlink(missing_ok=True)
    run()
    assert rows() == [("one", 3), ("two", 1)]


def test_one_file_of_many_parts(spark, tmp_path):
    from quillspark.storage import write_one

    frame = spark.range(5000).select(F.col("id").alias("n"), F.concat(F.lit("é line "), F.col("id")).alias("value")).repartition(7)
    for _ in range(2):
        write_one(frame, ["n"], str(tmp_path / "all.txt"))
        assert (tmp_path / "all.txt").read_text() == "".join(f"é line {i}\n" for i in range(5000))
    write_one(frame.where("n < 0"), ["n"], str(tmp_path / "none.txt"))
    assert (tmp_path / "none.txt").read_text() == "" and sorted(p.name for p in tmp_path.iterdir() if "crc" not in p.name) == ["all.txt", "none.txt"]
