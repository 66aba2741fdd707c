"""Local and distributed files as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, pattern: str, on_error: str = "Fail") -> DataFrame:
    """(kind, location, html, error) of each file that the glob matches; gzip is unpacked by name.  Bytes that
    are not UTF-8 raise under Fail; under SkipAndLog they give a null page with an error."""
    if pattern.endswith(".gz"):
        raw = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("location"), F.col("value").alias("html"))
        return raw.select(F.lit("PATH").alias("kind"), "location", "html", F.lit(None).cast("string").alias("error"))
    raw = spark.read.format("binaryFile").load(pattern)
    decode = F.decode("content", "utf-8") if on_error == "Fail" else F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    html = F.validate_utf8(F.col("content").cast("string")) if on_error == "Fail" else decode
    error = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.lit(None)).otherwise(F.lit("not UTF-8"))
    return raw.select(F.lit("PATH").alias("kind"), F.col("path").alias("location"), html.alias("html"), error.cast("string").alias("error"))


def seed_pages(spark: SparkSession, urls: list[str]) -> DataFrame:
    """(url, ord) as given, repetitions included."""
    return spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, ord int")
