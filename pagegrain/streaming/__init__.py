"""Structured Streaming over pages: every operator of pages works row by row, so it runs in append mode without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_pages(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """doc_id, url, html from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).select(F.col("page_id").alias("doc_id"), "url", "html")


def write_stream(df: DataFrame, folder: str, checkpoint: str):
    """Append to Parquet what is there now, then stop; a restart goes on from the checkpoint."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
