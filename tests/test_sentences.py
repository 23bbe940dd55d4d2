"""Tables of sentences: the rule makes them without gathering tokens, and folds of their spans are kernels over lengths."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_cost import TEXTS
from test_folds import random_text

from quillspark.operators import annotate, chunking, trees
from quillspark.sources import books as b


def lines_of(spark, *texts):
    return b.lines_of(spark.createDataFrame([("a", str(i), t) for i, t in enumerate(texts)], "author string, title string, text string"), keep_ends=True)


@pytest.mark.parametrize("tidy", [True, False])
def test_sentences_of_the_rule_are_its_tokens_gathered(spark, tidy):
    rng = random.Random(4)
    lines = lines_of(spark, *TEXTS, *(random_text(rng, 20) for _ in range(10)))
    got = annotate.rule_sentences(lines, tidy)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    keys = ["author", "title"]
    rows = lambda frame: sorted((r.title, r.line_no, r.sent_no, r.tokens, r.heads) for r in frame.collect())
    cut = annotate.tidy_tokens if tidy else annotate.tokens
    plain = lines.select(*keys, "line_no", F.posexplode(annotate.sentences(F.col("line"), tidy)).alias("sent_no", "_s")).withColumn("tokens", cut(F.col("_s"))).withColumn("heads", chunking.clause_heads(F.col("tokens")))
    assert rows(got) == rows(plain) == rows(annotate.sentences_of(annotate.rule_tokens(lines, tidy), keys))


def test_many_clauses_take_no_square_time(spark):
    """Each token's clause was looked for among all clauses of its sentence."""
    began = time.time()
    lines = lines_of(spark, "a b, " * 60_000)
    got = annotate.rule_sentences(lines, True).select(F.size("tokens").alias("n"), F.element_at("heads", -1).alias("last")).collect()
    assert [(r.n, r.last) for r in got] == [(120_000, 119_998)] and time.time() - began < 60


def plain(lengths, most, opened):
    size = lambda n: n if n >= 0 else ~n
    out, long, can = [], opened, opened > 0
    for i, n in enumerate(lengths):
        if can and long + size(n) <= most:
            long += size(n)
        else:
            out.append(i)
            long = size(n)
        can = n >= 0
    return out, (long if can and long <= most else 0), [sum(map(size, lengths[:i])) for i in (*out, len(lengths))]


def test_folds_of_lengths_equal_plain_ones():
    rng = random.Random(3)
    kind = pa.list_(pa.int32())
    for _ in range(1500):
        most = rng.choice((1, 5, 12))
        lengths = [n if rng.random() < 0.85 else ~n for n in (rng.choice((0, 1, 1, 2, 3, 4, 7, 13)) for _ in range(rng.randint(0, 14)))]
        for opened in range(most + 1):
            found = trees.spans_of(pa.array([[2], lengths, [~3]], kind), pa.array([0, opened, 0], pa.int32()), most).to_pylist()
            begins, _, at = plain(lengths, most, opened)
            assert [(x["i"], x["at"], x["end"]) for x in found[1]] == list(zip(begins, at, at[1:], strict=False)) and len(found[0]) == len(found[2]) == 1
        for first in (True, False):
            (ends,) = trees.ends_of(pa.array([lengths], kind), pa.array([first]), most).to_pylist()
            wanted = [plain(lengths, most, opened) for opened in range(1 if first else most + 1)]
            assert [(x["open"], x["n"]) for x in ends] == [(long if lengths else opened, len(begins)) for opened, (begins, long, _) in enumerate(wanted)]


def test_parts_numbered_from_anywhere(spark):
    """Below 0 and with gaps; a chunk goes over the ends of several parts."""
    texts = {-3: "one two\n", -1: "a\n", 5: "b\n", 6: "and so on and on\n"}
    parts = spark.createDataFrame([("t", k, v) for k, v in texts.items()] + [("u", 5, "first\n"), ("u", 9, "last")], "title string, part int, text string")
    got = sorted((r.title, r.ord, r.start, r.end, r.text) for r in chunking.chunks_of_parts(parts, ["title"], 30).collect())
    whole = spark.createDataFrame([("t", "".join(texts.values())), ("u", "first\nlast")], "title string, text string")
    assert got == sorted((r.title, r.ord, r.start, r.end, r.text) for r in chunking.chunks(whole, 30).collect())
