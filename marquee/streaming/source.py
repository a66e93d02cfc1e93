"""Streams of payment events and login attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.payments import split_feed
from marquee.schemas import PAYMENT_EVENT

TOPIC = "payment-events"


def kafka_records(
    spark: SparkSession, servers: str, topic: str = TOPIC, max_offsets: int = 5_000_000, **options: str
) -> DataFrame:
    """Topic records from the earliest offset; one task per topic partition and trigger.

    `max_offsets` bounds a micro-batch, and with it what one key can hold in a task.
    """
    return (
        spark.readStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"})
        .options(maxOffsetsPerTrigger=str(max_offsets), **options)
        .load()
        .select(
            F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("event_id"),
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
        )
    )


def feed_events(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of topic records."""
    return split_feed(records)


def event_files(spark: SparkSession, path: str, schema: str = PAYMENT_EVENT, files_per_trigger: int = 1_000) -> DataFrame:
    """Events that arrive as parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_metrics(events: DataFrame, name: str = "payment_events") -> DataFrame:
    """Count and latest event of every micro-batch, reported in the query's progress."""
    return events.observe(name, F.count(F.lit(1)).alias("processed"), F.max("event_time").alias("latest_event"))
