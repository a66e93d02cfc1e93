"""Events split before a stream's watermark: on time, late, or without what a window needs; none vanishes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.late import LATENESS_SECONDS, reject_reason
from marquee.schemas import PAYMENT_EVENT
from marquee.session import materialize
from marquee.streaming.sinks import Writer
from marquee.streaming.source import event_files

ON_TIME, LATE, REJECT = "on_time", "late", "reject"
MARKS = "batch_id long, high timestamp"


def split_arrivals(
    spark: SparkSession, folder: str, lateness_seconds: int = LATENESS_SECONDS, key: str = "payment_id", ts: str = "event_time"
) -> Writer:
    """A `foreachBatch` writer that deals events out to `folder`/kind=on_time, kind=late and kind=reject by batch.

    An event is late if one up to and in its batch is more than the lateness younger. A stream with a watermark of that
    lateness over the events on time therefore drops none of them, in whatever order and portions it reads them: its
    watermark never passes what the batch was judged by. Rejects bear their reason. A replayed batch takes its own place.
    """
    marks = f"{folder}/_marks"
    spark.createDataFrame([], MARKS).write.mode("ignore").partitionBy("batch_id").parquet(marks)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.withColumn("reason", reject_reason(key, ts)))
        own = rows.filter("reason IS NULL").agg(F.max(F.col(ts).cast("timestamp")).alias("high"))
        mark = own.select(F.lit(batch_id).cast("long").alias("batch_id"), "high")
        mark.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(marks)
        seen = batch.sparkSession.read.schema(MARKS).parquet(marks).filter(F.col("batch_id") <= batch_id)
        high = seen.agg(F.unix_micros(F.max("high"))).first()[0]
        bound = F.lit(high).cast("long") - lateness_seconds * 1_000_000
        late = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) < bound, F.lit(False))
        kind = F.when(F.col("reason").isNotNull(), REJECT).when(late, LATE).otherwise(ON_TIME)
        dealt = rows.withColumns({"kind": kind, "batch_id": F.lit(batch_id).cast("long")})
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch_id").parquet(folder)

    return write


def arrived(spark: SparkSession, folder: str, kind: str, schema: str = PAYMENT_EVENT) -> DataFrame:
    """The events of one kind so far, with their batch and, for rejects, the reason."""
    return spark.read.schema(f"{schema}, reason string, batch_id long, kind string").parquet(folder).filter(F.col("kind") == kind)


def on_time(spark: SparkSession, folder: str, schema: str = PAYMENT_EVENT, files_per_trigger: int = 1_000) -> DataFrame:
    """A stream of the events on time, once `folder` has some."""
    return event_files(spark, f"{folder}/kind={ON_TIME}", schema, files_per_trigger)
