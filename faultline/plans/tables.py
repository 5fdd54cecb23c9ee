"""The given tables as log events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.schema import DEBUG, ERROR, INFO, TRACE, WARN

# Severity of each event type in the given `events` table.
EVENT_TYPE_SEVERITY = {"error": ERROR, "purchase": WARN, "signup": INFO, "click": DEBUG, "view": TRACE}


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table with a zoned timestamp (the file stores it without a zone, in UTC)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table in the event schema plus `seq`, which makes (ts, seq) a total order."""
    e = base_events(spark, sf_dir)
    severity = F.lit(None).cast("int")
    for name, level in EVENT_TYPE_SEVERITY.items():
        severity = F.when(F.col("event_type") == name, F.lit(level)).otherwise(severity)
    k = F.get_json_object("props", "$.k")
    trace = F.when(
        k.cast("int") % 2 == 1, F.concat(k, F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    )
    return e.select(
        "ts",
        F.col("ts").alias("raw_ts"),
        F.concat(F.lit("src-"), (F.col("event_id") % 3).cast("string")).alias("source"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service"),
        severity.alias("severity"),
        F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("message"),
        trace.alias("trace_id"),
        F.create_map(F.lit("k"), k).alias("fields"),
        F.lit(None).cast("string").alias("drift_warning"),
        F.col("event_id").alias("seq"),
    )
