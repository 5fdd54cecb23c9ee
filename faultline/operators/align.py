"""Bringing sources onto one clock and into one order, and cutting the stream down."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.timestamps import resolve_time
from faultline.operators.scan import Run, running
from faultline.session import materialize


def settings_table(spark: SparkSession, settings: list[dict]) -> DataFrame:
    """Per-source settings: dicts with source, offset_ms and labels (both optional)."""
    rows = [
        (s["source"], int(s.get("offset_ms", 0)), dict(s.get("labels") or {})) for s in settings
    ]
    return spark.createDataFrame(
        rows, "source string, offset_ms bigint, labels map<string,string>"
    )


def with_source_settings(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Left join of the settings on source; Spark broadcasts them if they are small."""
    return df.join(settings, "source", "left")


def clock_offset(df: DataFrame, offsets: dict[str, int] | DataFrame) -> DataFrame:
    """Shift `ts` by the source's offset in ms (positive = forward); `raw_ts` keeps the old time.

    A dict becomes an expression, so the event rows are not joined at all; a table (source,
    offset_ms) is joined.
    """
    if isinstance(offsets, DataFrame):
        columns = df.columns
        shift = offsets.select(F.col("source").alias("o_source"), F.col("offset_ms").alias("o_ms"))
        joined = df.join(shift, F.col("source") == F.col("o_source"), "left")
        ms = F.coalesce("o_ms", F.lit(0).cast("bigint"))
        return joined.withColumn("raw_ts", F.col("ts")).withColumn(
            "ts", F.timestamp_micros(F.unix_micros("raw_ts") + ms * 1000)
        ).select(*columns, *([] if "raw_ts" in columns else ["raw_ts"]))
    us = F.lit(0).cast("bigint")
    for source, ms in offsets.items():
        us = F.when(F.col("source") == source, F.lit(int(ms) * 1000).cast("bigint")).otherwise(us)
    return df.withColumn("raw_ts", F.col("ts")).withColumn(
        "ts", F.timestamp_micros(F.unix_micros("raw_ts") + us)
    )


def choose_anchor(df: DataFrame, anchor: str = "sender") -> DataFrame:
    """Order by the sender's corrected clock, or by the time the event was received (`ingest_ts`)."""
    if anchor == "sender":
        return df
    if anchor == "receiver":
        return df.withColumn("ts", F.coalesce("ingest_ts", "ts"))
    raise ValueError("anchor must be 'sender' or 'receiver'")


def time_range(
    df: DataFrame,
    since: datetime | None = None,
    until: datetime | None = None,
    raw_column: str | None = None,
    offsets: dict[str, int] | None = None,
) -> DataFrame:
    """Events from `since` to `until`, both included, on the corrected time.

    The corrected time is computed and cannot prune files. With `raw_column` (the stored time) and
    the offsets in use, a wider range on that column is added, which the scan can push down.
    """
    shifts = [0, *(offsets or {}).values()]
    if since is not None:
        df = df.where(F.col("ts") >= F.lit(since))
        if raw_column:
            df = df.where(
                F.col(raw_column) >= F.lit(since - timedelta(milliseconds=max(shifts)))
            )
    if until is not None:
        df = df.where(F.col("ts") <= F.lit(until))
        if raw_column:
            df = df.where(
                F.col(raw_column) <= F.lit(until - timedelta(milliseconds=min(shifts)))
            )
    return df


def time_range_args(
    df: DataFrame, since: str | None, until: str | None, now: datetime, **options
) -> DataFrame:
    """`time_range` with arguments such as `15m` or an RFC3339 time, relative to `now`."""
    return time_range(df, resolve_time(since, now), resolve_time(until, now), **options)


def label_filter(
    df: DataFrame, labels: dict[str, str] | None = None, expr: str | Column | None = None
) -> DataFrame:
    """Events whose fields carry all the labels and for which the filter expression holds."""
    for key, value in (labels or {}).items():
        df = df.where(F.try_element_at("fields", F.lit(key)) == F.lit(value))
    return df if expr is None else df.where(expr)


def services_filter(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep named services. Apply it after detection, so that others still count as origins."""
    return df.where(F.col("service").isin(*names))


def signal_only(df: DataFrame) -> DataFrame:
    return df.where("is_signal")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources as one table; columns a source lacks are NULL.

    Detection needs (ts, seq) to be unique for a service, and for events that are to tell of silence altogether; use with_seq
    on the union where sources number their own rows.
    """
    if not sources:
        raise ValueError("no sources given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def time_ordered(df: DataFrame, order_cols: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Globally sorted rows, for a sink; detection itself needs no sorted input."""
    return df.orderBy(*order_cols)


def with_place(df: DataFrame, order_cols: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Add `place`, each row's number in the merged stream, counted in slices."""
    return running(df, [], list(order_cols), {"place": Run("sum", F.lit(1).cast("bigint"))})


def with_seq(df: DataFrame) -> DataFrame:
    """Add a unique `seq` that follows (ts, hash of the row); for sources without a number of their own.

    Equal rows get different numbers, in no matter which order. They are spread over slices by a
    row number of the scan, so a table that is mostly copies of one row still splits.
    """
    hashed = [c for c in ("ts", "source", "service", "trace_id", "message") if c in df.columns]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["ts", "_h", "_u"]
    placed = (
        df.withColumns({"_h": F.xxhash64(*hashed), "_u": F.monotonically_increasing_id()})
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .drop("_h", "_u")
        .withColumn("seq", F.monotonically_increasing_id())
    )
    # Written once: numbers made on the fly would change if a task were run again.
    return materialize(placed)


def suggest_offsets(df: DataFrame, reference: str, seq: str = "seq") -> DataFrame:
    """Clock offset of each source against `reference`, from the traces both saw.

    The exact median over shared traces of (first time in reference - first time in source), in ms. Differences are counted
    first and then summed up in slices, so the traces of a source are never gathered.
    """
    first = (
        df.where(F.nullif("trace_id", F.lit("")).isNotNull())
        .groupBy("trace_id", "source")
        .agg(F.min(F.unix_micros("ts")).alias("first"))
    )
    ref = first.where(F.col("source") == reference).select(
        F.col("trace_id").alias("r_trace"), F.col("first").alias("r_first")
    )
    apart = (
        first.where(F.col("source") != reference)
        .join(ref, F.col("trace_id") == F.col("r_trace"))
        .groupBy("source", (F.col("r_first") - F.col("first")).alias("us"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    summed = running(apart, ["source"], ["us"], {"upto": Run("sum", F.col("n"))})
    totals = summed.groupBy(F.col("source").alias("t_source")).agg(F.sum("n").alias("traces"))
    reached = summed.join(totals, F.col("source").eqNullSafe(F.col("t_source")))
    lower = F.min(F.when(2 * F.col("upto") >= F.col("traces"), F.col("us")))
    upper = F.min(F.when(2 * F.col("upto") >= F.col("traces") + F.lit(2) - F.col("traces") % 2, F.col("us")))
    return reached.groupBy("source").agg(
        ((lower / 1000 + upper / 1000) / 2).alias("offset_ms"), F.max("traces").alias("traces")
    )
