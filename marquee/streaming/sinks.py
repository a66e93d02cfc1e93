"""Sinks for `foreachBatch`; every one may see a batch again and ends up the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.session import materialize

Writer = Callable[[DataFrame, int], None]


def upsert_by_date(spark: SparkSession, path: str, keys: list[str], schema: str) -> Writer:
    """Keep the latest row per key in a table partitioned by `date`; only touched dates are rewritten."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("date").parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = materialize(batch)
        low, high = new.agg(F.min("date"), F.max("date")).first()
        if low is None and new.isEmpty():
            return
        stored = batch.sparkSession.read.schema(schema).parquet(path)
        # literals, so that partitions outside the batch's dates are not even listed for reading
        stored = stored.filter(F.col("date").between(F.lit(low), F.lit(high)))
        kept = stored.join(F.broadcast(new.select("date").distinct()), "date", "left_semi").join(new, keys, "left_anti")
        merged = materialize(new.unionByName(kept))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return write


def append_once(path: str, publish: Writer | None = None, key: str | None = None, pieces: int = 16) -> Writer:
    """Append a batch under its own id, so that a replay replaces it; with `publish`, also hand its rows on, once.

    What is handed on goes through an outbox beside the table, see `publish_once`; `key` names the column that tells the
    rows of a batch apart.
    """
    if publish:
        return publish_once(path, publish, key or "log_id", pieces)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


SENT = "batch_id long, piece int"


def publish_once(outbox: str, publish: Writer, key: str, pieces: int = 16) -> Writer:
    """Store a batch in the outbox under its id, then publish it piece by piece and log each piece that was sent.

    A replay finds the batch in the outbox as it was stored first, whatever the stream makes of it now, and publishes
    the pieces the log does not have: nothing again that is known to be sent, and everything that is not. A piece that
    was sent when the log entry failed is the one case that is sent twice; so every row carries a `message_id` of batch
    and `key`, the same each time, by which a receiver drops it.
    """
    log = f"{outbox.rstrip('/')}_sent"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], SENT).write.mode("ignore").partitionBy("batch_id").parquet(log)
        sent = spark.read.schema(SENT).parquet(log).filter(F.col("batch_id") == batch_id)
        folder = f"{outbox}/batch_id={batch_id}"
        # piece -1 says that the outbox has the whole batch
        if sent.filter("piece = -1").isEmpty():
            named = F.concat_ws(":", F.lit(str(batch_id)), F.col(key).cast("string"))
            batch.withColumn("message_id", named).write.mode("overwrite").parquet(folder)
            _enter(spark, log, batch_id, -1)
        rows = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("message_id", T.StringType())])).parquet(folder)
        piece = F.pmod(F.xxhash64("message_id"), F.lit(pieces)).cast("int")
        full = rows.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n")).join(sent, "piece", "left_anti")
        todo = full.agg(F.array_sort(F.collect_list("piece"))).first()[0]  # at most `pieces` numbers
        for p in todo:
            publish(rows.filter(piece == p), batch_id)
            _enter(spark, log, batch_id, p)

    return write


def _enter(spark: SparkSession, log: str, batch_id: int, piece: int) -> None:
    spark.createDataFrame([(batch_id, piece)], SENT).coalesce(1).write.mode("append").partitionBy("batch_id").parquet(log)


def kafka_publisher(servers: str, topic: str, key: str) -> Writer:
    """Publish rows as JSON without null fields."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")).write.format(
            "kafka"
        ).options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()

    return write


def start(df: DataFrame, writer: Writer, checkpoint: str, mode: str = "append", available_now: bool = False):
    stream = df.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
