"""The corpus pipeline: language ID, near-dedup, secret scan, mix and packing, one after the other.

Each stage works on all documents that its predecessor kept. A stage may be given documents whose ids repeat (the mix repeats
documents): every row stands for itself. Ids may be null too. Columns beyond those of ``documents`` are carried along whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language, mixing, neardup, packing, secrets
from quillspark.llm.workspace import Workspace

#: Words of a shingle, by which near-duplicates are found here: stages take five, where ``op10_neardup`` has two by its own contract.
SHINGLE = 5
#: Documents whose language is less certain than this are rejected, as are those without any letter.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told; the others are unchanged.

    Null, empty and letterless texts are rejected. Rows that repeat stay or go together. A null ``lang`` or id only keeps a row from
    being learned from. Texts are scored whole, whatever their length.
    """
    scored = language.predict(docs, language.learn(docs), keep=tuple(docs.columns))
    kept = scored.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id.

    Texts without words are no one's duplicates and stay, as many as there are; of rows that repeat whole, one stays, as of rows with
    one id and similar texts; a null id stands after all others.
    """
    found = neardup.near_duplicates(docs, keep=tuple(docs.columns), shingle=SHINGLE)
    return found.where("kept_row").select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; all documents stay. ``n_chars`` follows the text; a null text stays null, with a null count."""
    return _counted(secrets.redact(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents are repeated, left out or cut as their source's target asks.

    A null source is a source of its own. Documents without words are left out. Rows that repeat are rows of their own.
    """
    return _counted(mixing.mix(docs), docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece with its sequence, its place there and the checksum of its ids. ``row`` tells the repeats of a document apart.

    ``packing.pack`` gives the ids themselves too, if asked; they follow from the texts, which a trainer reads anyway. A null text
    is empty and leaves its end id alone; long texts are cut into pieces; rows that repeat are packed each.
    """
    return packing.pack(docs, with_ids=False, added_tokens=True)


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_documents),
]

#: SQL can express neither the language model nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``. Each result is written, so that the next stage reads it instead of making it again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = ws.save(docs, f"stage-{k}")
            ws.keep(f"stage-{k}")
    return docs
