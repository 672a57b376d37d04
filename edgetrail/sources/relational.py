"""Relational tables with their fixed schemas, from Parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_catalog_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in TABLES}


def read_jdbc_table(
    spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A table of a running database, read in key ranges so that no single task holds it."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions
    )
    return reader.options(**options).load()
