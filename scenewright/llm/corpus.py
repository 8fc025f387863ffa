"""What the operators share on the Spark side: whole tables, clean columns, reliable cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.session import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds.

    Rows without an id cannot be named in a result and are left out.
    """
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
                       ).where(F.col("doc_id").isNotNull())


def buckets(docs: DataFrame, unit_bytes: int, least: int = 16) -> int:
    """How many groups keep each at about ``unit_bytes`` of text; at least ``least``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-total // unit_bytes))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends in files that outlive executors."""
    path = f"{scratch_folder(df.sparkSession, purpose)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
