"""A table of texts kept once in the shared folder, in buckets by chunk, so that several passes read it without moving texts."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, shuffle_partitions

#: Input bytes of a chunk, by the session's size of input partitions.
CHUNK_BYTES = 4 << 20


def buckets_of(spark) -> int:
    return min(shuffle_partitions(spark), 100_000)


def chunk_table(docs: DataFrame, ws: Workspace, columns: dict[str, Column]) -> DataFrame:
    """``columns`` of ``docs`` with ``row``, a number for each row, and ``chunk``, which is part of an input partition."""
    spark = docs.sparkSession
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = max(1, math.ceil(size / CHUNK_BYTES))
    kept = docs.select(*(c.alias(k) for k, c in columns.items()), F.monotonically_increasing_id().alias("row"))
    kept = kept.withColumn("chunk", F.spark_partition_id().cast("long") * parts + F.pmod("row", F.lit(parts)))
    name = f"chunks_{uuid.uuid4().hex}"
    kept.write.option("compression", "zstd").option("path", ws.path("chunks")).bucketBy(buckets_of(spark), "chunk").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the name alone: the files are outside of the catalog, and the plan has their buckets
    return table
