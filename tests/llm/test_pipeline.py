"""The stages, each on what the one before kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import mixing, neardup, packing, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_language_keeps_documents_as_they_are(steps):
    before, after = ({r.doc_id: tuple(r) for r in s.collect()} for s in steps[:2])
    assert after.items() <= before.items() and len(after) > 0.9 * len(before)
    assert all(any(map(str.isalpha, r[1] or "")) for r in after.values())


def test_one_document_of_each_group_stays(steps):
    groups = neardup.dedup_components(steps[1], shingle=corpus_pipeline.SHINGLE).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(r.doc_id for r in groups)


def test_secrets_are_masked(steps):
    assert steps[3].count() == steps[2].count()
    assert secrets.scan(steps[3]).where("n_assign + n_access + n_hex > 0").count() == 0
    assert steps[3].where("n_chars <> length(text)").count() == 0


def test_mix_takes_what_its_plan_says(steps):
    plan = mixing.mix_counts(steps[3]).selectExpr("sum(taken)", "sum(size)").first()
    words = steps[4].select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()
    assert words[0] == plan[0] and abs(plan[0] - 1.5 * plan[1]) < 20


def test_packing_holds_every_document_once(steps):
    rows = steps[5].collect()
    assert len({(r.doc_id, r.row) for r in rows}) == steps[4].count()
    encoder = packing.encoder_of(packing.VOCABULARY)
    checksums = Counter()
    for text in (r.text for r in steps[4].collect()):
        ids = np.frombuffer(next(encoder.encode([text])) + bytes(2), "<u2").astype("<u4")
        checksums.update(zlib.crc32(ids[i : i + 2048].tobytes()) for i in range(0, len(ids), 2048))
    assert Counter(r.ids_crc32 for r in rows) == checksums
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("row", "chunk", "tie", "_take", "lang_pred", "spans", "key", "_text", "in_text", "score", "kept_row", "component_id")


def hard_rows():
    prose = "the old house stands by the river and nobody knows who built it or why it was left so long ago "
    texts = [None, "", "   ", "12 34", "word", prose * 3, prose * 3, prose * 3 + "again", f"password = hunter2hunter2 {prose}", prose * 4000, "été " * 20, "x" * 300_000]
    rows = [(i, t, "en" if i % 3 else None, ("web", None, "book")[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return rows + rows[5:7] + [(None, "no id at all, but some words of prose", None, None, None)] * 2 + [(None, None, None, None, None)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, stage):
    rows = hard_rows()
    docs = spark.createDataFrame(rows, SHAPE)
    name, step = corpus_pipeline.STAGES[stage]
    plain = step(spark, docs, SF)
    clash = step(spark, docs.withColumns({c: F.lit("z") for c in CLASHES}), SF)
    if stage == 4:
        ends = plain.groupBy("doc_id", "row").agg(F.sum("length").alias("n")).collect()
        assert len(ends) == len(rows) == clash.select("row").distinct().count() and plain.agg(F.max("length")).first()[0] == 2048
        return
    assert plain.columns == docs.columns and clash.columns == [*docs.columns, *CLASHES]
    got = plain.collect()
    assert sorted(map(str, got)) == sorted(map(str, clash.select(*docs.columns).collect()))
    before = Counter(rows)
    if stage == 0:  # what has no letter goes, the rest is as it was
        assert all(any(map(str.isalpha, r.text or "")) for r in got) and not Counter(map(tuple, got)) - before
    if stage == 1:
        assert not Counter(map(tuple, got)) - before and sum(r.text is not None and r.text.startswith("the old house") for r in got) == 1
        assert sum(not (r.text or "").strip() for r in got) == sum(not (r[1] or "").strip() for r in rows)
    if stage == 2:
        assert len(got) == len(rows) and not any("hunter2" in (r.text or "") for r in got) and sum(r.text is None for r in got) == sum(r[1] is None for r in rows)
    if stage == 3:
        assert all((r.text or "").split() for r in got) and {r.source for r in got} <= {"web", "book", None}


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_an_empty_table(spark, stage):
    docs = spark.createDataFrame([], SHAPE)
    found = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert found.count() == 0 and (stage == 4 or found.columns == docs.columns)
