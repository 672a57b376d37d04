"""Reading a tree of playlists and the list of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _relative(root: str) -> Column:
    marker = root.rstrip("/").split("://")[-1] + "/"
    path = F.url_decode(F.replace(F.col("_path"), F.lit("+"), F.lit("%2B")))
    return F.substr(path, F.locate(marker, path) + len(marker))


def _split(df: DataFrame, root: str) -> DataFrame:
    """Content folder (first component) and the path below it; hidden folders are left out."""
    df = df.withColumn("_relative", _relative(root))
    return df.withColumns(
        {
            "content_id": F.substring_index("_relative", "/", 1),
            "path": F.regexp_replace("_relative", "^[^/]*/", ""),
        }
    ).where(~F.col("content_id").startswith(".") & F.col("_relative").contains("/"))


def read_playlists(spark: SparkSession, root: str) -> DataFrame:
    """(content_id, path, body) of every ``*.m3u8`` file."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.m3u8")
        .text(root, wholetext=True)
        .select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("_path"))
    )
    return _split(files, root).select("content_id", "path", "body")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(content_id, path, bytes) of every file; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(F.col("path").alias("_path"), F.col("length").alias("bytes"))
    )
    return _split(files, root).select("content_id", "path", "bytes")
