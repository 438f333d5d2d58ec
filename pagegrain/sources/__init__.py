"""Readers of pages: files of text or bytes, and page tables."""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """(path, content): whole files as bytes; decode or parse them with their encoding found from the bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content")


def read_text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, html): whole files as UTF-8."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def spread(df: DataFrame, small: int = 4 << 20) -> DataFrame:
    """Deal a small table of one file to all threads: the file may be one row group, and parsing takes far longer than reading. Larger
    tables have enough splits of their own and aren't shuffled."""
    files = df.inputFiles()
    if len(files) != 1:
        return df
    threads = int(df.sparkSession.conf.get("spark.default.parallelism", None) or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        fs, path = pafs.FileSystem.from_uri(files[0])
        size = fs.get_file_info(path).size or 0
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):  # a store that Spark alone knows
        return df
    return df.repartition(max(1, min(2 * threads, size >> 17))) if size < small * threads else df


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    """(doc_id, html) with what the standard input holds as one page; empty input is an error."""
    text = (stream or sys.stdin).read()
    if not text:
        raise ValueError("no input")
    return spark.createDataFrame([(0, text)], "doc_id long, html string")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table: doc_id, url, html."""
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), "url", "html"))
