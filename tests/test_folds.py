"""The native folds, the folds in parts and the kernel along trees, each against the same spelled out on lists; and texts that are hard on patterns."""

import random
import time

import numpy as np
import pyarrow as pa
import plain_folds
import pytest
from pyspark.sql import functions as F

from quillspark.functions import folds
from quillspark.functions import text as f
from quillspark.operators import annotate, chunking, metrics, trees
from quillspark.plans.pipeline import Pipeline
from quillspark.sources import books as b

WORDS = ["a", "be", "see!", "x-y-z", "word,", "(or", "so)", "one:", "—", ",", "...", "Wait.", "“Yes”", "it's", "long" * 4, "y" * 45, "1.5", "¿qué?", " ", "  ", "\t", "[", "];", "é́a"]


def random_text(rng, lines, words=30):
    joined = lambda: "".join(rng.choice(WORDS) + rng.choice((" ", " ", " ", "", "\n" if rng.random() < 0.05 else " ")) for _ in range(rng.randint(0, words)))
    return "\n".join(joined() if rng.random() < 0.8 else rng.choice(("", "x", ".", "-", "ab.")) for _ in range(lines))


def nested(spark, text):
    """Lines with their ends, as sentences, as tokens, as the library cuts them."""
    parts = text.split("\n")
    lines = [x for x in [p + "\n" for p in parts[:-1]] + [parts[-1]] if x]
    cut = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", F.transform(annotate.sentences(F.col("line"), tidy=True), annotate.tidy_tokens).alias("s"))
    return [r.s for r in cut.orderBy("i").collect()]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, text string")


def spans_of(rows, n):
    return [(r.start, r.end, r.text) for r in sorted(rows, key=lambda r: r.ord) if r.n == n]


@pytest.mark.parametrize(("parsed", "across"), [(True, True), (False, True), (True, False), (False, False)])
def test_native_folds_equal_plain_ones(spark, parsed, across):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randint(1, 25), rng.choice((5, 30, 200))) for _ in range(12)] + ["", "x", " ", "\n\n", "a \nb", "a. \nb. ", "x" * 200, "a " * 3000, "-\n" * 500, ".\n" * 40 + "a " * 60 + "\n.\n.\n"]
    for most in (30, 70, None):
        rows = chunking.chunks(table(spark, texts), most, parsed, across).collect()
        for n, text in enumerate(texts):
            assert spans_of(rows, n) == plain_folds.book_spans(nested(spark, text), most, parsed, across), (most, text)
            assert [r.ord for r in sorted((r for r in rows if r.n == n), key=lambda r: r.ord)] == list(range(sum(r.n == n for r in rows)))


@pytest.mark.parametrize("lines", [1, 2, 7])
def test_parts_equal_whole_books(spark, lines):
    rng = random.Random(lines)
    texts = [random_text(rng, rng.randint(1, 40)) for _ in range(10)] + ["", "-\n" * 300, "a. \n" * 50, "\n" * 100, "x" * 500 + "\n" + "y\n" * 90, "one line"]
    books = table(spark, texts)
    parts = chunking.parts_of(books.withColumn("null", F.lit(None).cast("string")), lines)
    assert parts.groupBy("n").count().agg(F.max("count")).first()[0] > 1
    for most in (30, 70):
        whole = chunking.chunks(books, most).collect()
        got = chunking.chunks_of_parts(parts.repartition(3), ["n", "null"], most).collect()
        for n in range(len(texts)):
            assert spans_of(got, n) == spans_of(whole, n)
        assert sorted((r.n, r.ord) for r in got) == sorted((r.n, r.ord) for r in whole)


def test_no_python_cuts_texts(spark):
    plan = chunking.chunks(table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sums_before(spark):
    numbers = [random.Random(1).randint(0, 9) for _ in range(3000)]
    for some in ([], numbers[:1], numbers[:256], numbers[:257], numbers):
        got = spark.createDataFrame([(some,)], "x array<int>").select(folds.starts_before(F.col("x"))).first()[0]
        assert got == [sum(some[:i]) for i in range(len(some))]


def random_heads(rng, n, shape):
    if shape == "chain":
        return [max(0, i - 1) for i in range(n)]
    if shape == "star":
        root = rng.randrange(n)
        return [root] * n
    order = rng.sample(range(n), n)  # any tree, projective or not
    heads = [0] * n
    for k, i in enumerate(order):
        heads[i] = order[rng.randrange(k)] if k else i
    return heads


def test_kernel_equals_plain_trees():
    rng = random.Random(2)
    sentences = [(["x" * rng.randint(1, 9) + " " for _ in range(n)], random_heads(rng, n, shape)) for n in (1, 2, 3, 9, 40) for shape in ("chain", "star", "any", "any", "any", "any") for _ in range(4)]
    lengths, heads = pa.array([[len(t) for t in ts] for ts, _ in sentences], pa.list_(pa.int32())), pa.array([h for _, h in sentences], pa.list_(pa.int32()))
    assert trees.heights_of(heads).to_pylist() == [plain_folds.tree_height(h) for _, h in sentences]
    for most in (12, 30, None):
        got = trees.begins_of(lengths, heads, most).to_pylist()
        assert got == [[a for a, _, _ in plain_folds.tree_spans(ts, h, most)] for ts, h in sentences]
    assert trees.begins_of(lengths[3:9], heads[3:9], 30).to_pylist() == trees.begins_of(lengths, heads, 30).to_pylist()[3:9]
    assert trees.begins_of(lengths[:0], heads[:0], 30).to_pylist() == [] and trees.heights_of(pa.array([[]], pa.list_(pa.int32()))).to_pylist() == [0]


def test_kernel_takes_deep_and_long_sentences():
    began, n = time.time(), 200_000
    deep = trees.Trees(np.array([n]), np.maximum(np.arange(n) - 1, 0))
    assert deep.heights().tolist() == [n] and deep.begins(np.full(n, 5), 70).sum() > n // 15 and time.time() - began < 20


def tokens(spark, *sentences, key="t"):
    rows = [("a", key, line, sent, i, token, head) for line, sent, ts, hs in sentences for i, (token, head) in enumerate(zip(ts, hs, strict=True))]
    return spark.createDataFrame(rows, "author string, title string, line_no int, sent_no int, i int, token string, head int").repartition(3)


@pytest.mark.parametrize(("heads", "says"), [([0, 2, 1], "circle"), ([0, 3, 0], "token of its sentence"), ([0, -1, 0], "token of its sentence"), ([0, None, 0], "token of its sentence"), ([0, 1, 0], "one root"), ([1, 2, 0], "one root")])
def test_what_is_no_tree_is_an_error(spark, heads, says):
    frame = tokens(spark, (0, 0, ["aaaa ", "bbbb ", "cccc"], heads), (0, 1, ["fine."], [0]))
    for work in (chunking.depths_of_tokens, lambda t, k: chunking.chunks_of_tokens(t, k, 5)):
        with pytest.raises(Exception, match=says):
            work(frame, ["author", "title"]).collect()


def test_places_must_count(spark):
    frame = tokens(spark, (0, 0, ["a ", "b ", "c"], [0, 0, 0]))
    for wrong in (frame.where("i <> 1"), frame.unionByName(frame.where("i = 2")), frame.withColumn("token", F.when(F.col("i") != 1, F.col("token")))):
        with pytest.raises(Exception, match="count from 0"):
            chunking.chunks_of_tokens(wrong, ["author", "title"]).collect()


@pytest.mark.parametrize("across", [True, False])
def test_tables_of_tokens_equal_plain_folds(spark, across, monkeypatch):
    """Trees of many lines, in parts of three lines."""
    monkeypatch.setattr(chunking, "PART_LINES", 3)
    rng = random.Random(8)
    lines, rows = [], []
    for line in range(23):
        sentences = []
        for sent in range(rng.randint(1, 3)):
            ts = [rng.choice(WORDS[:10]) + rng.choice((" ", " ", "")) for _ in range(rng.randint(1, 14))]
            if rng.random() < 0.3:
                ts[-1] = "\n"
            sentences.append((ts, random_heads(rng, len(ts), rng.choice(("any", "chain", "star")))))
            rows.append((line, sent, *sentences[-1]))
        lines.append(sentences)
    got = chunking.chunks_of_tokens(tokens(spark, *rows), ["author", "title"], 30, across).collect()
    want = plain_folds.book_spans([[ts for ts, _ in s] for s in lines], 30, True, across, [[hs for _, hs in s] for s in lines])
    assert [(r.start, r.end, r.text) for r in sorted(got, key=lambda r: r.ord)] == want


HARD = ["." * 200_000, "a" + "-a" * 500_000, "a" + "\t" * 1_000_000 + "b", "…" * 200_000 + " end. ", ", " * 100_000, "(-) " * 50_000 + "a", ".)" * 100_000, " " * 1_000_000]


def test_hard_texts_are_cut_in_seconds(spark):
    """Hundreds of thousands of marks, hyphens or blanks in one line overflow no stack and take no square time."""
    began = time.time()
    hard = spark.createDataFrame([("a", str(i), x) for i, x in enumerate(HARD)], "author string, title string, text string").repartition(4)
    for parsed in (True, False):
        rows = chunking.chunks(hard, 70, parsed).select("title", F.length("text").alias("n")).groupBy("title").sum("n").collect()
        assert {r.title: r[1] for r in rows} == {str(i): len(x) for i, x in enumerate(HARD)}
    assert hard.select(F.sum(F.length(f.strip(F.col("text"))))).first()[0] == sum(len(x.strip()) for x in HARD)
    counts = metrics.complexity(hard, b.lines_of(hard), ["author", "title"], known=hard.select(F.lit("a").alias("word"))).collect()
    assert len(counts) == len(HARD) and Pipeline(spark).from_books(hard).pipeline(70).frame.count() > len(HARD)
    assert time.time() - began < 150


def test_files_are_read_in_parts(spark, tmp_path):
    """Splits of a few hundred bytes; files with all line ends, with and without a last one."""
    rng = random.Random(9)
    (tmp_path / "ann").mkdir()
    texts = {"long": random_text(rng, 120), "ended": random_text(rng, 30) + "\n", "dos": "a b\r\nc\rd\r\n\r\ne. f\r\n", "one": "x", "blank": "\n"}
    for name, text in texts.items():
        (tmp_path / "ann" / f"{name}.txt").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        parts = b.read_book_parts(spark, str(tmp_path), lines=4)
        whole = {r.title: r.text for r in b.read_books(spark, str(tmp_path)).collect()}
        joined = {}
        for r in sorted(parts.collect(), key=lambda r: (r.title, r.part)):
            joined[r.title] = joined.get(r.title, "") + r.text
        assert joined == whole and parts.count() > 30
        cut = lambda frame: sorted((r.title, r.ord, r.start, r.end, r.text) for r in frame.collect())
        assert cut(chunking.chunks_of_parts(parts, ["author", "title"], 30)) == cut(chunking.chunks(b.read_books(spark, str(tmp_path)), 30))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
