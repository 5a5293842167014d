"""Files that each hold one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def html_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, html), bytes read as UTF-8 with what isn't replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.expr("make_valid_utf8(cast(content as string))").alias("html"))


def html_streams(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """(path, html) of files as they arrive."""
    text = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_at_once).load(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
