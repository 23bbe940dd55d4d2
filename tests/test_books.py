"""Goldens of the book operators that depend on no parser, invariants, and round trips."""

import random
import sqlite3
import zipfile

import plain_folds
import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions import text as f
from quillspark.operators import annotate, cards, chunking, metrics, translate
from quillspark.plans.pipeline import Pipeline
from quillspark.plans.registry import Backwards
from quillspark.sinks import anki, html, jsonl
from quillspark.sources import books as b
from quillspark.sources import lexicon
from quillspark.sources.cards import read_cards
from quillspark.streaming.books import stream_cards


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def books(spark, *rows):
    return spark.createDataFrame(list(rows), "author string, title string, text string")


def frequencies(spark, ranks):
    return spark.createDataFrame(list(ranks.items()), "word string, rank long")


def profile(spark, text, **how):
    df = books(spark, ("a", "t", text))
    return metrics.complexity(df, b.lines_of(df), ["title", "author"], **how).first()


def test_strip_and_lines(spark):
    assert one(spark, f.strip(F.col("x")), x="\x1c  a b \n") == "a b"
    assert [tuple(r) for r in b.lines_of(books(spark, ("a", "t", "x \r\ny\n\nz".replace("\r\n", "\n"))), keep_ends=True).select("line_no", "line").orderBy("line_no").collect()] == [(0, "x \n"), (1, "y\n"), (2, "\n"), (3, "z")]
    assert one(spark, f.split_lines(F.col("x")), x="a b\r\nc\n") == ["a", "b", "c"]


def test_title_trim(spark):
    cut = lambda t, s, **k: one(spark, f.trim_title(F.col("x"), s, **k), x=t)
    assert (cut("bumledydum_2000", "_"), cut("bumledydum_2000_foo", "_"), cut("abc", "_"), cut("abc", ""), cut("abc", "_", keep_if_absent=True), cut("a.b.c", ".")) == ("bumledydum", "bumledydum_2000", "", "abc", "abc", "a.b")


def test_deck_and_escape(spark):
    assert one(spark, f.deck_id(F.col("x")), x="books::a::b") == 1079569345
    assert one(spark, f.html_escape(F.col("x")), x="<a href='x'>&\"</a>") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;&lt;/a&gt;"


def test_ratios(spark):
    for n, d, want in ((1, 4, 0.2), (3, 4, 0.8), (1, 3, 0.3), (0, 5, 0.0), (5, 0, 0.0), (7, 20, 0.4)):
        assert one(spark, f.ratio(F.col("n"), F.col("d")), n=n, d=d) == want
    assert one(spark, f.percentage(F.col("n"), F.col("d")), n=29, d=100) == 28 and one(spark, f.percentage(F.col("n"), F.col("d")), n=2, d=4) == 50


@pytest.mark.parametrize("text", ["Hi. You! «What?» No 3.5 here... e.g. this", "a  b\tc  ", "", "   ", "don't re-do l’été²", "\x1c x . . y"])
def test_annotation_is_lossless(spark, text):
    got = one(spark, F.transform(annotate.sentences(F.col("x")), annotate.tokens), x=text)
    assert "".join(t for s in got for t in s) == text
    assert sum(map(len, got)) == 0 or all(got)


def test_sentences(spark):
    assert one(spark, annotate.sentences(F.col("x")), x="Hi. You! «What?» No 3.5 a.b") == ["Hi. ", "You! ", "«What?» ", "No 3.5 a.b"]


def test_tidy_punctuation(spark):
    assert one(spark, annotate.tidy(F.split(F.col("x"), "\\|")), x="«|Hi|!|»|x") == ["«", "Hi!»", "x"]
    assert one(spark, annotate.tidy(F.array().cast("array<string>")), x="") == []


def test_known_words(spark):
    known = spark.createDataFrame([("likes",), ("peas",), ("peas",)], "word string")
    got = profile(spark, "Bob likes green peas", known=known)
    assert (got.word_count, got.sentence_count, got.words_known, got.percent_words_known) == (4, 1, 2, 50)


def test_vocabulary_level(spark):
    bands = [(0, 400), (400, 1000), (1000, 3000)]
    words = frequencies(spark, {"peas": 500, "likes": 20, "rare": 2000})
    assert profile(spark, "Bob likes green peas", frequencies=words, levels=bands[:2]).vocab_level == 1
    assert profile(spark, "\n".join(["Bob likes green peas"] * 5 + ["rare"]), frequencies=words, levels=bands).vocab_level == 1


def test_strict_percentile(spark):
    levels = spark.createDataFrame([("x", 0, 19), ("x", 5, 1)], "k string, level int, n long")
    assert metrics.percentile_level(levels, ["k"], "p").first().p == 5


def test_empty_book_has_zeros(spark):
    got = profile(spark, "", known=spark.createDataFrame([("x",)], "word string"), frequencies=frequencies(spark, {"x": 5}))
    assert set(got.asDict().values()) == {"a", "t", 0, 0.0}


def test_own_metric_and_lookup(spark):
    own = metrics.standard_metrics().add(metrics.Metric("capitals", of_token=lambda t: F.when(t.rlike("^[A-Z]"), 1).otherwise(0))).add_ratio(metrics.Ratio("percent_capitals", "capitals", "word_count", percent=True))
    got = profile(spark, "Bob likes Green peas", metrics=own)
    assert (got.capitals, got.percent_capitals) == (2, 50)
    assert own["capitals"].name == "capitals"
    with pytest.raises(KeyError):
        own["none"]


def test_tree_height():
    assert plain_folds.tree_height([1, 1, 1, 2, 3, 1]) == 4
    assert plain_folds.tree_height([]) == 0 and plain_folds.tree_height([0]) == 1
    assert plain_folds.tree_height([0, *range(20_000)]) == 20_001
    assert plain_folds.tree_height(plain_folds.clause_heads(["one ", "two ", "three"])) == 2


def test_consolidation():
    spans, at = [], 0
    for n in (3, 2, 4, 1):
        spans.append((at, at + n, "x" * n))
        at += n
    assert [len(t) for _, _, t in plain_folds.consolidate(spans, 5)] == [5, 5]
    assert plain_folds.consolidate([(0, 9, "x" * 9)], 5) == [(0, 9, "x" * 9)]
    assert len(plain_folds.consolidate(spans, None)) == 1 and len(plain_folds.consolidate([(0, 1, "a"), (2, 3, "b")], 9)) == 2


TEXT = "First line, with a clause (and another), that is rather long indeed, I think. Second!\nThird line\n\nand the end... Or is it? Yes: it is, a very long sentence that goes on, and on, and on, without an end in sight"


@pytest.mark.parametrize("parsed", [True, False])
def test_chunks_are_lossless_and_bounded(spark, parsed):
    rows = chunking.chunks(books(spark, ("a", "t", TEXT), ("a", "u", ""), ("a", "v", "x" * 100)), 40, parsed).orderBy("title", "ord").collect()
    mine = [r for r in rows if r.title == "t"]
    assert "".join(r.text for r in mine) == TEXT and all(len(r.text) <= 40 for r in mine)
    assert [r.ord for r in mine] == list(range(len(mine))) and all(x.start < y.start and x.end <= y.start for x, y in zip(mine, mine[1:]))
    assert all(TEXT[r.start : r.end] == r.text.rstrip(" ") or r.text.endswith("\n") or TEXT[r.start :].startswith(r.text) for r in mine)
    assert [r.text for r in rows if r.title == "v"] == ["x" * 100]


def test_lines_that_fit_are_one_chunk_each(spark):
    rows = chunking.chunks(books(spark, ("a", "t", "A line of 25 characters.\nAnother one of about 28, too")), 30).orderBy("ord").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 25), (25, 53)]


def card_rows(spark, *rows):
    return spark.createDataFrame([(*r, "") for r in rows], "author string, title string, ord long, start long, end long, text string, translation string")


def test_context_stays_in_its_book(spark):
    df = cards.with_context(card_rows(spark, ("a", "t", 0, 0, 1, "x"), ("a", "t", 1, 1, 2, "y"), ("b", "u", 0, 0, 1, "z")))
    assert [(r.prev, r.text, r.next) for r in df.orderBy("author", "ord").collect()] == [("", "x", "y"), ("x", "y", ""), ("", "z", "")]


def test_author_line(spark):
    got = cards.skip_author_line(card_rows(spark, ("A", "1", 0, 0, 6, "A\nfoo\n"), ("A", "2", 0, 0, 1, "A"), ("A", "3", 0, 0, 1, "B"), ("A", "3", 1, 1, 2, "A"), ("A", "4", 0, 0, 0, ""))).orderBy("title", "ord").collect()
    assert [(r.title, r.start, r.end, r.text) for r in got] == [("1", 2, 6, "foo"), ("3", 0, 1, "B"), ("3", 1, 2, "A")]


def test_translation(spark):
    df = card_rows(spark, *(("a", "t", i, i, i + 1, f"x{i}") for i in range(450))).withColumn("translation", F.when(F.col("ord") < 10, "done").otherwise(""))
    got = translate.translate(df, Backwards, "xx").collect()
    assert len(got) == 450 and all(r.translation == ("done" if r.ord < 10 else r.text[::-1]) and r.error is None for r in got)

    class Broken:
        def translate_text(self, texts, target_lang):
            raise ConnectionError("no network")

    bad = translate.translate(df, Broken, "xx").where("ord >= 10").collect()
    assert all(r.translation == "" and "no network" in r.error for r in bad)
    assert translate.dummy_translate(df).where("translation = reverse(text)").count() == 440


def test_jsonl_round_trip_and_validation(spark, tmp_path):
    df = card_rows(spark, ("J.R.R. T", "Vol. 2", 0, 0, 3, "a\"b"), ("J.R.R. T", "Vol. 2", 1, 3, 5, "é"), ("x", "y", 0, 0, 1, "z"))
    one, many, table = (str(tmp_path / x) for x in ("one.jsonl", "many", "table"))
    jsonl.write_cards(df, one)
    jsonl.write_cards(df, many)
    jsonl.write_cards(df, table, layout="table")
    assert (tmp_path / "one.jsonl").is_file() and len((tmp_path / "one.jsonl").read_text().splitlines()) == 3
    assert sorted(str(x.relative_to(many)) for x in (tmp_path / "many").rglob("*.jsonl")) == ["J.R.R. T/Vol. 2.jsonl", "x/y.jsonl"]
    for path in (one, many):
        assert sorted(map(tuple, read_cards(spark, path).collect())) == sorted(map(tuple, df.drop("ord").collect()))
    (tmp_path / "many" / "x" / "other.txt").write_text("stays")
    again = df.where("author = 'x'").withColumn("text", F.lit("new"))
    for path in (one, many):
        jsonl.write_cards(again, path)
    jsonl.write_cards(again, table, layout="table")
    assert [r.text for r in read_cards(spark, one).collect()] == ["new"] and read_cards(spark, many).count() == 3
    assert spark.read.text(table).count() == 3 and (tmp_path / "many" / "x" / "other.txt").read_text() == "stays"
    (tmp_path / "cards.txt").write_text((tmp_path / "one.jsonl").read_text())
    (tmp_path / "odd.jsonl").mkdir()
    (tmp_path / "odd.jsonl" / "in.jsonl").write_text((tmp_path / "one.jsonl").read_text())
    assert read_cards(spark, str(tmp_path / "cards.txt")).count() == read_cards(spark, str(tmp_path / "odd.jsonl")).count() == 1
    with pytest.raises(IsADirectoryError):
        jsonl.write_cards(df, str(tmp_path / "odd.jsonl"))
    for bad in ('{"author": "a"}', '{"author":"a","title":"t","start":0,"end":1,"text":"x","more":1}', "no json"):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception, match="not a card"):
            read_cards(spark, str(tmp_path / "bad.jsonl")).collect()


def library(tmp_path):
    for author, title, text in (("A+ B", "Дом. 1", "Eins zwei.\r\nDrei."), ("A+ B", "Zwei", "x"), ("J.R.R. T", "k", "Some text here.\n")):
        (tmp_path / "lib" / author).mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / author / f"{title}.txt").write_bytes(text.encode())
    (tmp_path / "lib" / "no.md").write_text("no")
    return str(tmp_path / "lib")


def test_read_books(spark, tmp_path):
    got = {(r.author, r.title): r.text for r in b.read_books(spark, library(tmp_path)).collect()}
    assert got == {("A+ B", "Дом. 1"): "Eins zwei.\nDrei.", ("A+ B", "Zwei"): "x", ("J.R.R", "k"): "Some text here.\n"}
    assert b.read_books(spark, library(tmp_path), author_mode="name").where("author = 'J.R.R. T'").count() == 1


def test_word_lists(spark, tmp_path):
    (tmp_path / "known.csv").write_text("lemma,word\nlike,likes\npea,peas\n")
    (tmp_path / "freq.csv").write_text('lemma,inflection\nthe,the\nbe,is\nbe,"w,as"\nx,is\n')
    assert {r.word for r in lexicon.read_known_words(spark, str(tmp_path / "known.csv")).collect()} == {"word", "likes", "peas"}
    (tmp_path / "thin.csv").write_text("alone\nwords\n")
    assert lexicon.read_known_words(spark, str(tmp_path / "thin.csv")).count() == 0
    assert {r.word: r["rank"] for r in lexicon.read_frequencies(spark, str(tmp_path / "freq.csv")).collect()} == {"w,as": 3, "is": 4}


def test_anki_package(spark, tmp_path):
    df = card_rows(spark, ("a<", "t", 0, 0, 1, "x"), ("a<", "t", 1, 1, 2, "y"), ("b", "u", 0, 0, 1, "z"))
    assert anki.write_anki(df, str(tmp_path / "x.apkg")) == 3
    zipfile.ZipFile(tmp_path / "x.apkg").extractall(tmp_path)
    db = sqlite3.connect(tmp_path / "collection.anki2")
    assert [r[0].split("\x1f")[4:7] for r in db.execute("select flds from notes order by id")] == [["", "x", "y"], ["x", "y", ""], ["", "z", ""]]
    assert db.execute("select count(distinct did) from cards").fetchone() == (2,) and "a&lt;" in db.execute("select decks from col").fetchone()[0]
    (tmp_path / "d.apkg").mkdir()
    with pytest.raises(IsADirectoryError):
        anki.write_anki(df, str(tmp_path / "d.apkg"))
    many = card_rows(spark, *((a, "t", i, i, i + 1, f"x{i}") for a in ("a", "b/c") for i in range(25)))
    assert anki.write_anki(many, str(tmp_path / "decks"), most=10) == anki.write_anki(many, str(tmp_path / "all.apkg"), most=30) == 50
    assert sorted(x.name for x in (tmp_path / "decks").iterdir()) == sorted(f"books::{a}::t{n}.apkg" for a in ("a", "b_c") for n in ("", "-2", "-3"))
    found = []
    for name in ("all.apkg", "all-2.apkg"):
        zipfile.ZipFile(tmp_path / name).extract("collection.anki2", tmp_path)
        found += sqlite3.connect(tmp_path / "collection.anki2").execute("select flds, guid from notes order by id").fetchall()
    assert [x[0].split("\x1f")[5] for x in found] == [f"x{i}" for i in range(25)] * 2 and len({x[1] for x in found}) == 50


def test_guid_of_packages():
    digest = "00000000000000ff" + "0" * 48
    assert anki.base91(digest) == "c." and anki.base91("ffffffffffffffff") != anki.base91("fffffffffffffffe") and len(set(anki.DIGITS)) == 91
    value = 0
    for c in anki.base91("fedcba9876543210"):
        value = value * 91 + anki.DIGITS.index(c)
    assert value == 0xFEDCBA9876543210


def test_pipeline_and_side_by_side(spark, tmp_path):
    chain = Pipeline(spark).from_folder(library(tmp_path)).pipeline(30).skip_first_line_if_author().dummy_translate()
    assert chain.frame.where("translation <> reverse(text)").count() == 0
    page = html.side_by_side(chain.frame, 12).where("title = 'k'").first().html
    assert "<td>Some text here.\n</td>" in page and "font-size:12px" in page
    chain.to_jsonl(str(tmp_path / "out"))
    chain.to_sidebyside(str(tmp_path / "pages"))
    assert sorted(str(x.relative_to(tmp_path / "pages")) for x in (tmp_path / "pages").rglob("*.html")) == ["A+ B/Zwei.html", "A+ B/Дом. 1.html", "J.R.R/k.html"]
    with pytest.raises(ValueError, match="30"):
        Pipeline(spark).from_folder(library(tmp_path)).pipeline(10)


def test_stream(spark, tmp_path):
    query = stream_cards(spark, library(tmp_path), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out")).count() == 3


def test_cards_do_not_begin_with_punctuation(spark):
    """A cut goes before the word that carries the punctuation, not between them; an opening quote at the line's start stays alone."""
    text = "aaaaaaaaaa bbbbbbbbbb cccccccc, dddd eeee."
    rows = chunking.chunks(books(spark, ("a", "t", text)), 30, parsed=False).orderBy("ord").collect()
    assert [r.text for r in rows] == ["aaaaaaaaaa bbbbbbbbbb ", "cccccccc, dddd eeee."]
    line = "«Hi!», she said. \"So\" (he)\n"
    got = one(spark, F.flatten(F.transform(annotate.sentences(F.col("x"), tidy=True), annotate.tidy_tokens)), x=line)
    assert got == ["«", "Hi!», ", "she ", "said. \"", "So\" (", "he)", "\n"]
    assert got == one(spark, annotate.tidy(F.flatten(F.transform(annotate.sentences(F.col("x")), annotate.tokens))), x=line)


def test_texts_keep_every_character(spark):
    text = "x\x01y. z\x00\x02. \x01"
    assert one(spark, annotate.sentences(F.col("x")), x=text) == ["x\x01y. ", "z\x00\x02. ", "\x01"]
    rows = chunking.chunks(books(spark, ("a", "t", text)), 30).collect()
    assert "".join(r.text for r in rows) == text
    assert profile(spark, "x\x01y. z").sentence_count == 2


def test_null_keys_have_their_sums(spark):
    df = spark.createDataFrame([(None, "t", "one two three."), ("a", None, "four")], "author string, title string, text string")
    known = spark.createDataFrame([("one",)], "word string")
    got = {(r.author, r.title): (r.word_count, r.words_known, r.mean_grammar_depth) for r in metrics.complexity(df, b.lines_of(df), ["author", "title"], known=known).collect()}
    assert got == {(None, "t"): (3, 1, 2.0), ("a", None): (1, 0, 1.0)}


def token_table(spark, *sentences):
    rows = [("a", "t", line, sent, i, token, head) for line, sent, tokens, heads in sentences for i, (token, head) in enumerate(zip(tokens, heads, strict=True))]
    return spark.createDataFrame(rows, "author string, title string, line_no int, sent_no int, i int, token string, head int").repartition(3)


def test_a_table_of_tokens_gives_trees(spark):
    """A hand-made parse: the old man | who (lived | by (the sea)) | slept."""
    tokens = ["the ", "old ", "man ", "who ", "lived ", "by ", "the ", "sea ", "slept", "\n"]
    heads = [2, 2, 8, 4, 2, 4, 7, 5, 8, 8]
    table = token_table(spark, (0, 0, tokens, heads), (1, 0, ["Yes. "], [0]), (1, 1, ["No."], [0]))
    assert {(r.line_no, r.sent_no): r.depth for r in chunking.depths_of_tokens(table, ["author", "title"]).collect()} == {(0, 0): 6, (1, 0): 1, (1, 1): 1}
    rows = cards.cards_of_tokens(table, 20).orderBy("ord").collect()
    # by the tree: "by the sea " joins first and stays whole; from the left alone it would be "who lived by the "
    assert [r.text for r in rows] == ["the old man ", "who lived ", "by the sea slept\n", "Yes. No."] and "".join(r.text for r in rows) == "".join(tokens) + "Yes. No."
    df = books(spark, ("a", "t", ""))
    got = metrics.complexity(df, b.lines_of(df), ["author", "title"], known=spark.createDataFrame([("sea",)], "word string"), tokens=table).first()
    assert (got.word_count, got.sentence_count, got.words_known, got.mean_grammar_depth) == (11, 3, 1, 2.7)
    assert Pipeline(spark).from_tokens(table, 20).frame.count() == 4
    for wrong in ([0, 1, 2], [1, 0, 1]):
        with pytest.raises(Exception, match="one root"):
            chunking.depths_of_tokens(token_table(spark, (0, 0, ["a ", "b ", "c"], wrong)), ["author", "title"]).collect()


def test_clause_depth_is_the_height_of_its_tree(spark):
    rng = random.Random(4)
    sentences = [[rng.choice(["w ", ", ", "(", "- ", "x1 ", ") "]) for _ in range(rng.randint(1, 9))] for _ in range(600)]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "i int, s array<string>").select("i", chunking.clause_depth(F.col("s")).alias("d")).collect()
    assert all(plain_folds.tree_height(plain_folds.clause_heads(sentences[r.i])) == r.d for r in got)


def test_metric_with_its_own_combination(spark):
    own = metrics.standard_metrics()
    own.add(metrics.Metric("longest", of_words=lambda words: F.array_max(F.transform(words, lambda w: F.length(w))), combine=F.max))
    own.add(metrics.Metric("lengths", of_words=lambda words: F.transform(words, lambda w: F.length(w)), combine=lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))), zero=lambda: F.array().cast("array<int>")))
    got = profile(spark, "One three. Fourteen of", metrics=own)
    assert (got.longest, got.lengths) == (8, [2, 3, 5, 8]) and profile(spark, "", metrics=own).lengths == []


@pytest.mark.parametrize("sink", ["to-anki", "to-jsonl"])
@pytest.mark.parametrize("source", ["from-text", "from-folder", "from-jsonl"])
def test_command_line(spark, tmp_path, source, sink):
    folder = library(tmp_path)
    jsonl.write_cards(card_rows(spark, ("a", "t_1", 0, 0, 2, "xy")), str(tmp_path / "in.jsonl"))
    start = {"from-text": [f"{folder}/A+ B/Zwei.txt", "pipeline", "--maxfieldlen", "40"], "from-folder": [folder, "pipeline"], "from-jsonl": [str(tmp_path / "in.jsonl")]}[source]
    target = str(tmp_path / ("out.apkg" if sink == "to-anki" else "out.jsonl"))
    translated = ["translate", "--lang", "xx", "--translator", "quillspark.plans.registry:Backwards"] if source == "from-jsonl" else ["dummy-translate"]
    assert cli.main(["flashcards", source, *start, "skip-first-line-if-author", *translated, sink, target]) == 0
    if sink == "to-jsonl":
        rows = read_cards(spark, target).collect()
        assert len(rows) == {"from-text": 1, "from-folder": 3, "from-jsonl": 1}[source] and all(r.translation == r.text[::-1] for r in rows)
    else:
        assert zipfile.is_zipfile(target)


def test_command_line_profiles(spark, tmp_path):
    (tmp_path / "known.csv").write_text("lemma,word\nx,x\n")
    out = str(tmp_path / "rows.jsonl")
    assert cli.main(["complexity", library(tmp_path), "--lang", "de", "--knownmorphs", str(tmp_path / "known.csv"), "--outputfilename", out]) == 0
    assert {(r.lang, r.title, r.words_known) for r in spark.read.json(out).collect()} == {("de", "Дом. 1", 0), ("de", "Zwei", 1), ("de", "k", 0)}
    assert cli.main(["complexity", f"{library(tmp_path)}/A+ B/Zwei.txt"]) == 0


def test_observed_chain_counts_cards(spark, tmp_path):
    from pyspark.sql import Observation

    seen = Observation("cards")
    Pipeline(spark, card_rows(spark, ("a", "t", 0, 0, 1, "x")).observe(seen, F.count(F.lit(1)).alias("n"))).observed("more").to_jsonl(str(tmp_path / "o.jsonl"))
    assert seen.get["n"] >= 1


def test_registry_has_sql_for_most_queries():
    from quillspark.plans import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and set(registry.ORACLE_SQL) == set(registry.QUERIES)
