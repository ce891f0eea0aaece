"""Writing events, alerts, slices and reports."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.dataprep import time_slices


def write_event_lines(events: DataFrame, path: str) -> None:
    """JSON lines; null optional fields are left out."""
    events.select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_alert_lines(alerts: DataFrame, path: str, condition=None) -> None:
    """Alerts, optionally filtered, as JSON lines."""
    (alerts if condition is None else alerts.filter(condition)).write.mode("overwrite").json(path)


def write_time_slices(events: DataFrame, path: str, parts: int) -> DataFrame:
    """One folder per equal time slice; returns the report of each slice's window."""
    s = time_slices(events, parts)
    s.write.mode("overwrite").partitionBy("part").parquet(path)
    return events.sparkSession.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def write_report(summary: DataFrame, path: str) -> None:
    """A summary (few rows by construction) as nested JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
