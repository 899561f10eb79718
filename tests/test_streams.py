"""The registered streams over a table of several files."""

from pathlib import Path

from pyspark.sql import functions as F

from meterframe.plans import streams
from meterframe.session import shared_folder


def test_a_micro_batch_is_written_and_read_by_many_tasks(spark, tmp_path):
    """Two parts of the events, each as many files as the table has; both are evaluated at their own time."""
    usage = F.array(F.lit("view"), F.lit("click"))
    rows = spark.range(0, 400, 1, 4).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-25 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 2)).alias("ts"),
        (F.col("id") % 9).alias("user_id"),
        F.element_at(usage, (F.col("id") % 2 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 7 + 1).cast("double").alias("value"),
        F.lit('{"k": 1}').alias("props"),
    )
    # Every file has events of both parts.
    rows.repartition(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    before = set(Path(shared_folder(spark)).glob("stream-alerts-*-input"))
    times = {r[0] for r in streams.stream_alert_states(spark, str(tmp_path)).select("evaluated_at").distinct().collect()}
    (folder,) = set(Path(shared_folder(spark)).glob("stream-alerts-*-input")) - before
    assert len(list(folder.glob("*.parquet"))) > 2
    assert [t.isoformat() for t in times] == ["2024-01-25T12:00:00"]
