"""What a query does for a character does not grow with its text, and tokens are found without a test of each."""

import time

from pyspark.sql import functions as F

from quillspark.functions.text import BLANK, SPACE, strip
from quillspark.operators import annotate, chunking
from quillspark.sources.books import lines_of


def test_a_line_costs_nothing_of_its_whole_text(spark):
    """Whole texts were measured once a line: 300,000 lines took the square of that."""
    books = spark.range(2).select(F.lit("a").alias("author"), F.col("id").cast("string").alias("title"), F.repeat(F.lit(" ab\n"), 300_000).alias("text"))
    for keep_ends, n in ((False, 2), (True, 4)):
        began = time.time()
        assert lines_of(books, keep_ends).agg(F.count("line"), F.sum(F.length("line")), F.max("line_no")).collect()[0][:] == (600_000, 600_000 * n, 299_999)
        assert time.time() - began < 30


def test_java_knows_the_same_blanks(spark):
    every = spark.range(0x110000).where("id not between 55296 and 57343 and id <> 65279").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert every.where(F.col("c").rlike(rf"\A[{BLANK}]\z") != F.col("c").rlike(rf"\A[{SPACE}]\z")).count() == 0
    assert every.where((strip(F.concat("c", F.lit("x"), "c", F.lit("x"), "c")) == F.concat(F.lit("x"), "c", F.lit("x"))) != F.col("c").rlike(rf"\A[{BLANK}]\z")).count() == 0


TEXTS = ["(a), b: c d; e f.", "one, two (three four), \U00020000-x y, z!  Next: 12 1-2 ², 3a é́ $ €5", "- , - $ , x", ", , $ % ,  ^ , -", "́-a, b c \U0001d7d8\U00020000 d", "a" * 40 + " " + "-," * 30, "", "...(, ,- " * 9, "x \t y\x85z , 7 . . "]


def test_patterns_equal_what_they_stand_for(spark):
    """Depths, words and bare tokens of a sentence come from one pattern each; the steps they stand for test each token."""
    frame = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    tokens = annotate.tokens(F.col("s"))
    got = frame.select(
        (chunking.sentence_depth(F.col("s")) == chunking.clause_depth(tokens)).alias("depth"),
        (annotate.words(F.col("s")) == F.transform(F.filter(tokens, annotate.is_word), lambda t: F.rtrim(t))).alias("words"),
        (annotate.bare_tokens(F.col("s")) == F.transform(tokens, annotate.bare)).alias("bare"),
        (annotate.tidy_tokens(F.col("s")) == annotate.tidy(tokens)).alias("tidy"),
    ).collect()
    assert all(all(row) for row in got)


def test_chunks_begin_at_tokens_of_any_plane(spark):
    """A word of letters beyond 16 bits is one token, and whole sentences that fit are not cut into tokens."""
    books = spark.createDataFrame([("a", "t", "x \U00020000\U0001d7d8\U00020000 y, z")], "author string, title string, text string")
    assert [r.text for r in chunking.chunks(books, 4).orderBy("ord").collect()] == ["x ", "\U00020000\U0001d7d8\U00020000 ", "y, z"]
