"""Picked files: images and page documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import is_pdf


def read_picked(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with path, length, content and kind ('pdf' or 'image'). The content is read only if it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("kind", F.when(is_pdf(F.col("path")), "pdf").otherwise("image"))


def png_size(content: str = "content") -> Column:
    """struct(width, height) from a PNG's header, null for what isn't a PNG."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))
