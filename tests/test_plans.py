"""The plans are the ones a large cluster needs."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marquee.operators import anomaly as A
from marquee.operators import bookings as B
from marquee.operators import revenue as R
from marquee.plans.all import PLANS
from marquee.session import checkpoint_dir, materialize
from marquee.sources.tables import parquet_table
from marquee.sources.testdata import Views

PACKAGE = Path(__file__).resolve().parent.parent / "marquee"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(PLANS))
def test_no_product_of_rows_and_no_row_udf(spark, tiny, name):
    plan = physical(PLANS[name](Views(spark, tiny)))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan


def test_one_shuffle_per_key(spark, tiny):
    v = Views(spark, tiny)
    accepted = R.dedup_events(v.payment_events, 86_400)
    assert len(re.findall("Exchange hash", physical(accepted))) == 1
    # By payment for the duplicates, by user for all history rules together.
    assert len(re.findall("Exchange hash", physical(A.anomaly_logs(A.with_history(accepted))))) == 2
    assert len(re.findall("Exchange hash", physical(R.hourly_revenue(accepted)))) == 2


def test_top_lists_are_cut_before_the_shuffle(spark, tiny):
    v = Views(spark, tiny)
    for df in (R.top_movies(R.movie_daily_counts(v.payment_events)), A.recent_payments(v.payment_events)):
        plan = physical(df)
        assert plan.count("WindowGroupLimit") == 2
        assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hash")  # the partial one lies below


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    folder = str(tmp_path)
    spark.sql(
        "SELECT 'b' AS booking_id, 'u' AS user_id, 's' AS show_id, 'PENDING' AS status, "
        "timestamp_ntz'2024-01-01' AS create_at, timestamp_ntz'2024-01-01' AS update_at"
    ).write.parquet(f"{folder}/bookings")
    bookings = parquet_table(spark, folder, "bookings")
    plan = physical(B.by_status(bookings, "PENDING").filter(F.col("user_id") == "u").select("booking_id"))
    assert "EqualTo(status,PENDING)" in plan and "EqualTo(user_id,u)" in plan
    assert re.search(r"ReadSchema: struct<booking_id:string,user_id:string,status:string>", plan)


def test_checkpoints_go_to_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == named
    materialize(spark.range(3))
    used = spark.sparkContext.getCheckpointDir()
    assert used.startswith(named) or used.startswith(f"file:{named}")


def test_nothing_is_collected_by_the_package():
    # the text operators gather short lists, which their own tests name
    source = "\n".join(p.read_text() for p in PACKAGE.rglob("*.py") if p.parent.name != "llm")
    for call in (".collect()", ".toPandas(", ".toLocalIterator(", "localCheckpoint", "crossJoin", ".rdd"):
        assert call not in source, call
