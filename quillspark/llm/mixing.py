"""Operator 1, mixing sources to target weights. DataFrame functions only.

Every document gets a hash-random key, of its id and its text. Rows are sorted by range of (source, key), so that a hot source or a
repeated row is split over many tasks like any other; a distributed prefix sum of their sizes tells how many words of its source
stand before a document, and the source is cut at its exact budget. A source whose target exceeds its size is repeated: whole
epochs, then a cut one. The mix itself is a map over the documents: each row's key is held against its source's cut, and no text is
moved.

Nulls and edge cases: a null text has size 0; a null source is a source of its own, sorted last; a null id is kept and ordered
like any other; rows that are repeated whole count as often as they occur; a document that is longer than a source's budget is cut
within; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


#: Sources up to which their cuts are broadcast; beyond, documents are joined with them.
BROADCAST_SOURCES = 50_000


def _key(doc_id: Column, text: Column) -> Column:
    """52 random bits of a document, the same in every run and in any SQL engine."""
    name = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _prefix(df: DataFrame, ws: Workspace, name: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, its total over all rows before this one in ``order``; columns keep their names.

    Range partitions are written once, so that their limits are fixed; each is summed in its own task, and only one row a
    partition goes through the window over all of them.
    """
    dealt = ws.save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_all_{k}") for k, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_all_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the range exchange: a bounded table
    return (
        dealt.withColumns({f"_in_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
        .join(F.broadcast(starts), "_part")
        .select(*df.columns, *((F.col(f"_in_{k}") + F.col(f"_all_{k}")).alias(k) for k in sums))
    )


def source_targets(sizes: DataFrame, ws: Workspace, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """A row a source (source, source_size) with its target: ``share`` of all words by weight, none above ``max_epochs`` sizes.

    Sources get the weights in turn, by code point with null last. The excess of capped sources goes to the others by weight.
    With sources sorted by cap / weight, the level after capping the first k is (total - caps) / (weights left); the largest of
    these levels is the one at which nobody is above the cap.
    """
    ranked = _prefix(sizes, ws, "sources", [F.col("source").asc_nulls_last()], {"_nth": F.lit(1)})
    turn = F.lit(float(weights[-1]))
    for i, w in reversed(list(enumerate(weights[:-1]))):
        turn = F.when(F.col("_nth") % len(weights) == i, F.lit(float(w))).otherwise(turn)
    capped = ranked.withColumn("weight", turn).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = [F.col("ratio"), F.col("_nth")]
    steps = ws.save(_prefix(capped.withColumn("ratio", F.col("cap") / F.col("weight")), ws, "ratios", order, {"_caps": F.col("cap"), "_weights": F.col("weight")}), "steps")
    words, weight = steps.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    levels = (F.lit(words).cast("double") * share - F.col("_caps")) / (F.lit(weight).cast("double") - F.col("_weights"))
    (level,) = steps.agg(F.max(levels)).first()
    return steps.select("source", "source_size", F.least("cap", F.lit(level).cast("double") * F.col("weight")).alias("target"))


def _placed(sized: DataFrame, ws: Workspace, order: list[str], **how) -> DataFrame:
    """``sized`` (source, size and the columns of ``order``) with start, the words of its source before a row, source_size and target."""
    dealt = ws.save(sized.repartitionByRange(F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id()), "dealt")
    # a row for each source and for each part that holds some of it
    sums = ws.save(dealt.groupBy("source", "part").agg(F.sum("size").alias("in_part")), "sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("in_part").alias("source_size")), ws, **how)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("in_part").over(earlier), F.lit(0))).alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).selectExpr("b.source", "part", "before", "source_size", "target")
    inside = Window.partitionBy("part", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d").join(starts.alias("s"), F.expr("d.part = s.part and d.source <=> s.source"))
    return placed.select("d.*", (F.col("before") + F.col("inside")).alias("start"), "source_size", "target")


def _budget() -> tuple[Column, Column]:
    """Whole epochs of a source, and the words of the cut one."""
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    return whole, budget - whole * F.col("source_size")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target, taken (words that the mix takes of it, repeats counted)."""
    ws = Workspace(docs.sparkSession, "mix")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("row"))
    placed = _placed(ws.save(sized, "sized"), ws, ["key", "row"], weights=weights, share=share, max_epochs=max_epochs)
    whole, rest = _budget()
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each epoch of a document that the mix takes.

    A document that is cut keeps its first words, up to the last word that still fits. Documents without words are not taken.
    Where whole rows repeat just at the cut, as many of them are taken as the budget asks.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    names = docs.columns
    every = docs.select(*(F.col(c).alias(f"in_{c}") for c in names))
    key, tie = _key(F.col(f"in_{id_col}"), F.col(f"in_{text_col}")).alias("key"), F.xxhash64(*(F.col(f"in_{c}").cast("string") for c in names)).alias("tie")
    sized = every.select(F.col(f"in_{source_col}").alias("source"), _size(F.col(f"in_{text_col}")).alias("size"), key, tie, F.monotonically_increasing_id().alias("row"))
    placed = _placed(ws.save(sized, "sized"), ws, ["key", "tie", "row"], weights=weights, share=share, max_epochs=max_epochs)
    whole, rest = _budget()
    placed = ws.save(placed.where("size > 0").select("source", "size", "key", "tie", "start", whole.cast("long").alias("whole"), rest.cast("long").alias("rest")), "placed")
    # a source's cut: its first row that is not taken whole; equal rows around the cut are taken together
    cut = placed.groupBy("source").agg(F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.min(F.when(F.col("start") + F.col("size") > F.col("rest"), F.struct("key", "tie"))).alias("cut"))
    at_cut = placed.alias("p").join(cut.select("source", "cut").alias("c"), F.expr("p.source <=> c.source and p.key = c.cut.key and p.tie = c.cut.tie"))
    group = at_cut.groupBy("p.source").agg(F.min("start").alias("before"), F.count(F.lit(1)).alias("equal"))
    cuts = cut.alias("c").join(group.alias("g"), F.expr("c.source <=> g.source"), "left").select("c.source", "whole", "cut.key", "cut.tie", (F.col("rest") - F.col("before")).alias("words"), "equal")
    cuts = ws.save(cuts, "cuts").select(*(F.col(c).alias(f"_{c}") for c in ("source", "whole", "key", "tie", "words", "equal")))
    n, equal = cuts.agg(F.count(F.lit(1)), F.coalesce(F.max("_equal"), F.lit(0))).first()
    ws.keep("cuts")

    cuts = F.broadcast(cuts) if n <= BROADCAST_SOURCES else cuts
    met = every.where(F.col(f"in_{text_col}").rlike(WORD)).select("*", key, tie).join(cuts, F.col(f"in_{source_col}").eqNullSafe(F.col("_source")))
    here = F.struct("key", "tie")
    at, before = here == F.struct("_key", "_tie"), F.col("_key").isNull() | (here < F.struct("_key", "_tie"))
    # a source without a cut is taken whole once more
    alone = at & (F.col("_equal") == 1) & (F.col("_words") > 0)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("_whole").cast("int") + F.when(before, 1).otherwise(0)), F.when(alone, F.array("_words")).otherwise(F.array().cast("array<bigint>")))
    out = met.withColumn("_take", F.explode(copies)).select(*every.columns, "_take")
    if equal > 1:
        size = _size(F.col(f"in_{text_col}"))
        group = met.where(at & (F.col("_equal") > 1)).groupBy("_source", "_words").agg(F.expr("first(struct(" + ", ".join(f"`{c}`" for c in every.columns) + ")) as one")).select("one.*", "_words")
        shares = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("_words") / size).cast("int")), F.filter(F.array(F.col("_words") % size), lambda x: x > 0))
        out = out.unionByName(group.withColumn("_take", F.explode(shares)).select(*every.columns, "_take"))
    words = F.regexp_extract_all(F.col(f"in_{text_col}"), F.lit(rf"\G[\x20\x09-\x0D]*+{WORD}+"), F.lit(0))
    text = F.when(F.col("_take") >= 0, F.array_join(F.slice(words, 1, F.col("_take").cast("int")), "")).otherwise(F.col(f"in_{text_col}"))
    return out.select(*((text if c == text_col else F.col(f"in_{c}")).alias(c) for c in names))
