"""Several configured sources in one call: each read by its type, put on one clock, filtered, and numbered together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import align
from faultline.schema import ERROR, as_event
from faultline.sources import registry
from faultline.sources.payloads import OTHER_PREFIX

_CLOUDWATCH = "log_group string, timestamp bigint, message string, logStreamName string"
#: Types whose landed files hold one response a line.
_RESPONSES = ("loki", "elasticsearch", "datadog", "googlecloud", "gcp")


@dataclass(frozen=True)
class SourceSpec:
    """A source: its type, where its lines or landed responses lie, its clock's offset, and what of it is kept."""

    name: str
    path: str
    kind: str = "file"
    offset_ms: int = 0
    labels: dict[str, str] = field(default_factory=dict)
    where: str | None = None


def _unreadable(spark: SparkSession, spec: SourceSpec, why: str, ingest_ts: Column) -> DataFrame:
    """The one ERROR event of a source that can't be read."""
    row = spark.range(1).select(
        ingest_ts.cast("timestamp").alias("ts"),
        ingest_ts.cast("timestamp").alias("raw_ts"),
        F.lit(spec.name).alias("source"),
        F.lit(spec.name).alias("service"),
        F.lit(ERROR).alias("severity"),
        F.lit(OTHER_PREFIX + why).alias("message"),
        F.create_map().cast("map<string,string>").alias("fields"),
        F.lit(False).alias("ts_missing"),
    )
    return as_event(row, "ts_missing")


def read_source(spark: SparkSession, spec: SourceSpec, ingest_ts: Column | None = None) -> DataFrame:
    """Events of one source; what can't be read, the whole source or a record of it, is an ERROR event."""
    now = F.current_timestamp() if ingest_ts is None else ingest_ts
    try:
        if spec.kind == "cloudwatch":
            landed = spark.read.schema(_CLOUDWATCH).json(spec.path)
        else:
            landed = spark.read.text(spec.path)
    except AnalysisException as missing:
        return _unreadable(spark, spec, (missing.getMessage() or str(missing)).splitlines()[0], now)
    if spec.kind in _RESPONSES:
        blank = F.trim("value") == ""
        df = landed.where(~blank).withColumnRenamed("value", "payload")
        events = registry.normalize(df, spec.kind, spec.name, ingest_ts=now, failures=True)
    else:
        events = registry.normalize(landed, spec.kind, spec.name, ingest_ts=now)
    return align.label_filter(events, spec.labels, spec.where)


def read_sources(
    spark: SparkSession, specs: list[SourceSpec], since=None, until=None, ingest_ts: Column | None = None
) -> DataFrame:
    """All sources as one event table in the order (ts, seq), on one clock, cut to the time range.

    The table is written once, numbered, so detectors read it and parse nothing again. Names must differ: they tell the
    sources' clocks apart.
    """
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise ValueError("two sources have one name")
    events = align.union_sources(*[read_source(spark, s, ingest_ts) for s in specs])
    events = align.clock_offset(events, {s.name: s.offset_ms for s in specs if s.offset_ms})
    return align.with_seq(align.time_range(events, since, until))
