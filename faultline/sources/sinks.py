"""Results out: one JSON object per line, Parquet sessions, and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.render import render_rfc3339
from faultline.functions.severity import severity_text
from faultline.schema import SILENCE_TYPE, present


def _empty_to_null(col: Column) -> Column:
    return F.when(F.size(col) > 0, col)


def result_columns(df: DataFrame) -> DataFrame:
    """The columns of a written result, in order; empty parts are NULL."""
    have = set(df.columns)

    def optional(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    silence = F.col("silence") if "silence" in have else F.lit(None).cast(SILENCE_TYPE)
    return df.select(
        render_rfc3339("ts").alias("timestamp"),
        present("service").alias("service"),
        present("source").alias("source"),
        severity_text("severity").alias("severity"),
        F.coalesce("message", F.lit("")).alias("message"),
        present("trace_id").alias("trace_id"),
        F.coalesce(optional("is_signal", "boolean"), F.lit(False)).alias("is_signal"),
        optional("signal_type").alias("signal_type"),
        optional("cascade_from").alias("cascade_from"),
        _empty_to_null(F.col("fields")).alias("fields"),
        _empty_to_null(silence).alias("silence"),
        present(optional("drift_warning")).alias("drift_warning"),
    )


def to_result_json(df: DataFrame) -> DataFrame:
    """One column `value`: a JSON object per result, absent parts left out."""
    flat = result_columns(df)
    return flat.select(F.to_json(F.struct(*flat.columns)).alias("value"))


def write_results(df: DataFrame, path: str, mode: str = "errorifexists", seq: str = "seq") -> None:
    """Write results as JSON lines in (ts, seq) order, in each file and from file to file by name.

    The rows are dealt by ranges of the order and sorted there; on equal places rows follow source and service.
    """
    ties = [c for c in (seq, "source", "service") if c in df.columns]
    to_result_json(df.orderBy("ts", *ties)).write.mode(mode).text(path)


def save_session(events: DataFrame, path: str, mode: str = "append") -> None:
    """Keep events for replay, one folder per day, so old days can be dropped as folders."""
    events.withColumn("day", F.to_date("ts")).write.mode(mode).partitionBy("day").parquet(path)


def replay_session(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Saved events again; a time range prunes the day folders it does not touch."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.where((F.col("day") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since)))
    if until is not None:
        df = df.where((F.col("day") <= F.to_date(F.lit(until))) & (F.col("ts") <= F.lit(until)))
    return df.drop("day")
