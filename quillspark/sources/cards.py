"""Cards from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CARD, REQUIRED
from ..storage import is_file


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """One file, whatever its name, or all ``*.jsonl`` below a folder. A missing or unknown key is an error; ``translation`` may be missing and is then ''."""
    reader = spark.read.option("recursiveFileLookup", True)
    if not is_file(spark, path):
        reader = reader.option("pathGlobFilter", "*.jsonl")
    raw = reader.text(path).where(F.trim("value") != "").select("value", F.from_json("value", CARD).alias("card"), F.json_object_keys("value").alias("keys"))
    known = F.array(*(F.lit(f.name) for f in CARD.fields))
    required = F.array(*map(F.lit, REQUIRED))
    wrong = F.col("keys").isNull() | (F.size(F.array_except("keys", known)) > 0) | (F.size(F.array_except(required, "keys")) > 0)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not a card: "), F.col("value"))).cast(CARD)).otherwise(F.col("card"))
    return raw.select(checked.alias("card")).select("card.*").withColumn("translation", F.coalesce("translation", F.lit("")))
