"""Text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """Rows (path, line) of text files, one for each line; a byte-order mark is dropped. Encodings other than
    UTF-8 are decoded per file, so such files must fit into a task."""
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8", "utf-8-sig"):
        lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
        return lines.withColumn("line", F.regexp_replace("line", "^﻿", ""))
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.explode(F.split(F.decode("content", encoding), "\r?\n")).alias("line"))
