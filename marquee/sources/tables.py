"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.schemas import SCHEMAS


def parquet_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the model under its declared schema; no inference."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def jdbc_table(
    spark: SparkSession, url: str, name: str, column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """A database table read in `partitions` ranges of `column`."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=column, lowerBound=lower, upperBound=upper)
        .options(numPartitions=str(partitions), fetchsize="10000", **options)
        .load()
    )
