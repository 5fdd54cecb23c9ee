"""The event record every source is normalised to, and the position that orders it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severity levels and their labels.
UNKNOWN, TRACE, DEBUG, INFO, WARN, ERROR, FATAL = range(7)
SEVERITY_LABELS = {
    UNKNOWN: "UNKNOWN",
    TRACE: "TRACE",
    DEBUG: "DEBUG",
    INFO: "INFO",
    WARN: "WARN",
    ERROR: "ERROR",
    FATAL: "FATAL",
}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("raw_ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("drift_warning", T.StringType()),
    ]
)

SILENCE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("service", T.StringType()),
            T.StructField("drop_pct", T.DoubleType()),
            T.StructField("baseline_rate", T.DoubleType()),
            T.StructField("current_rate", T.DoubleType()),
        ]
    )
)


def is_error(severity: Column | str = "severity") -> Column:
    """True for ERROR and FATAL."""
    severity = F.col(severity) if isinstance(severity, str) else severity
    return severity >= F.lit(ERROR)


def present(col: Column | str) -> Column:
    """The text, or NULL where it is empty."""
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(""))


def micros(col: Column | str = "ts") -> Column:
    """Event time as microseconds since the epoch."""
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def cell_of(micros_col: Column, width: int) -> Column:
    """Index of the fixed-width time cell, exact in 64-bit integers."""
    return F.call_function("div", micros_col - F.pmod(micros_col, F.lit(width)), F.lit(width))


def as_event(df: DataFrame, *extra: str) -> DataFrame:
    """Project to the event schema, adding NULL for columns the source lacks."""
    have = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in EVENT_SCHEMA
    ]
    return df.select(*cols, *[c for c in extra if c in have])
