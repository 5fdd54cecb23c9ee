"""One query per operator over the given tables, with plain scalar result columns."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.render import display_name, render_fields, render_rfc3339, render_time
from faultline.functions.severity import parse_severity, severity_text
from faultline.functions.timestamps import parse_timestamp
from faultline.operators import align, anomaly, cascade, rates, report, silence
from faultline.plans import landed
from faultline.plans.correlate import Settings, annotate, correlate, detect, signal_history
from faultline.plans.tables import base_events, log_events
from faultline.schema import is_error
from faultline.session import materialize
from faultline.sources import lines, payloads, sinks

# The given events are minutes apart, so spans are longer than the defaults.
HOUR_US = 3_600_000_000
WINDOW_MS = 6 * 3_600_000
TOLERANCE_MS = 1_800_000
ANOMALY_US = 96 * HOUR_US
ANOMALY_MULTIPLIER = 1.3
SILENCE_US = 24 * HOUR_US
SILENCE_PCT = 50.0
OFFSETS_MS = {"src-0": -200, "src-2": 1500}
SINCE = datetime(2024, 1, 8, tzinfo=timezone.utc)
UNTIL = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)
ALL_SIGNALS = Settings(
    window_ms=WINDOW_MS,
    anomaly_multiplier=ANOMALY_MULTIPLIER,
    baseline_us=ANOMALY_US,
    silence_us=SILENCE_US,
    silence_threshold_pct=SILENCE_PCT,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn

    return add


def _us(col: str = "ts"):
    return F.unix_micros(col)


# --- sources -------------------------------------------------------------------------------------


@query("scan_lines")
def scan_lines(spark, sf_dir):
    kept = lines.scan_lines(landed.log_lines(spark, sf_dir))
    return kept.select(
        "event_id",
        F.col("object").isNotNull().cast("int").alias("is_object"),
        F.length("line").cast("bigint").alias("n_chars"),
    )


def _event_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        _us().alias("ts_us"),
        "service",
        F.col("severity").cast("bigint").alias("severity"),
        "message",
        "trace_id",
        render_fields("fields").alias("fields_text"),
    )


def _line_events(df: DataFrame, normaliser) -> DataFrame:
    out = normaliser(df, "app", ingest_ts=F.col("ingest_ts"), keep=("event_id",))
    return _event_columns(out, "event_id", "source", "ts_missing").withColumn(
        "ts_missing", F.col("ts_missing").cast("int")
    )


@query("normalize_json")
def normalize_json(spark, sf_dir):
    return _line_events(landed.log_lines(spark, sf_dir), lines.normalize_json)


@query("normalize_text")
def normalize_text(spark, sf_dir):
    return _line_events(landed.log_lines(spark, sf_dir), lines.normalize_text)


@query("normalize_lines")
def normalize_lines(spark, sf_dir):
    return _line_events(landed.log_lines(spark, sf_dir), lines.normalize_lines)


@query("normalize_loki")
def normalize_loki(spark, sf_dir):
    df = landed.loki_payloads(spark, sf_dir)
    return _event_columns(payloads.normalize_loki(df, "loki"), "ts_ns")


@query("normalize_es")
def normalize_es(spark, sf_dir):
    df = landed.es_payloads(spark, sf_dir)
    return _event_columns(payloads.normalize_es(df, "es"))


@query("normalize_cloudwatch")
def normalize_cloudwatch(spark, sf_dir):
    df = landed.cloudwatch_records(spark, sf_dir)
    return _event_columns(payloads.normalize_cloudwatch(df, "cw", keep=("event_id",)), "event_id")


@query("normalize_datadog")
def normalize_datadog(spark, sf_dir):
    df = landed.datadog_payloads(spark, sf_dir)
    return _event_columns(payloads.normalize_datadog(df, "dd"))


@query("normalize_gcl")
def normalize_gcl(spark, sf_dir):
    df = landed.google_payloads(spark, sf_dir)
    return _event_columns(payloads.normalize_gcl(df, "gcl"))


@query("error_events")
def error_events(spark, sf_dir):
    df = landed.damaged_payloads(spark, sf_dir)
    read = payloads.normalize_datadog(df, "dd", F.col("ingest_ts"), failures=True)
    return (
        read.groupBy("service", "severity")
        .agg(F.count("*").alias("events"), F.max(_us()).alias("last_us"))
        .withColumn("severity", F.col("severity").cast("bigint"))
    )


@query("damaged_responses")
def damaged_responses(spark, sf_dir):
    """Every record of damaged responses of four stores is an event or an error."""
    parts = []
    for kind, read in (
        ("loki", payloads.normalize_loki),
        ("elasticsearch", payloads.normalize_es),
        ("datadog", payloads.normalize_datadog),
        ("googlecloud", payloads.normalize_gcl),
    ):
        df = landed.responses(spark, sf_dir, kind)
        parts.append(read(df, kind, F.col("ingest_ts"), failures=True))
    return (
        align.union_sources(*parts)
        .groupBy("source", F.coalesce(F.col("service") == F.col("source"), F.lit(False)).alias("failed"))
        .agg(F.count("*").alias("events"), F.max(_us()).alias("last_us"))
    )


@query("merge_sources")
def merge_sources(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    parts = [ev.where(F.col("source") == f"src-{i}") for i in range(3)]
    merged = align.with_place(align.union_sources(*parts).select("ts", "seq", "source"))
    return merged.select("place", _us().alias("ts_us"), F.col("seq").alias("event_id"), "source")


@query("result_json")
def result_json(spark, sf_dir):
    """The lines, with the entries of `silence` set apart: their numbers are rounded before they are compared."""
    out = sinks.to_result_json(correlate(log_events(spark, sf_dir), ALL_SIGNALS))
    told = F.from_json("value", "silence array<struct<service string, drop_pct double>>")["silence"]
    drops = F.aggregate(told, F.lit(0.0), lambda a, x: a + x["drop_pct"])
    return out.select(
        F.regexp_replace("value", r',"silence":\[[^\]]*\]', "").alias("value"),
        F.array_join(F.transform(told, lambda x: x["service"]), ",").alias("silent_services"),
        F.round(drops, 6).alias("drop_pct_sum"),
    )


# --- projections and filters -----------------------------------------------------------------------


@query("clock_offset")
def clock_offset(spark, sf_dir):
    settings = align.settings_table(
        spark, [{"source": s, "offset_ms": ms} for s, ms in OFFSETS_MS.items()]
    )
    out = align.clock_offset(log_events(spark, sf_dir), settings)
    return out.select(
        F.col("seq").alias("event_id"), _us().alias("ts_us"), _us("raw_ts").alias("raw_us")
    )


@query("choose_anchor")
def choose_anchor(spark, sf_dir):
    received = F.timestamp_micros(_us() + (F.col("seq") % 7) * 1000)
    out = align.choose_anchor(
        log_events(spark, sf_dir).withColumn("ingest_ts", received), "receiver"
    )
    return out.select(F.col("seq").alias("event_id"), _us().alias("ts_us"))


@query("time_range")
def time_range(spark, sf_dir):
    shifted = align.clock_offset(log_events(spark, sf_dir), OFFSETS_MS)
    out = align.time_range(shifted, SINCE, UNTIL, raw_column="raw_ts", offsets=OFFSETS_MS)
    return out.select(F.col("seq").alias("event_id"), _us().alias("ts_us"))


@query("since_argument")
def since_argument(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    latest = ev.agg(F.max("ts")).first()[0].replace(tzinfo=timezone.utc)
    out = align.time_range_args(ev, "72h", None, now=latest)
    return out.select(F.col("seq").alias("event_id"), _us().alias("ts_us"))


@query("parse_timestamp")
def parse_timestamps(spark, sf_dir):
    e = base_events(spark, sf_dir)
    form = F.col("event_id") % 8
    us = _us()
    text = (
        F.when(form == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(form == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(form == 3, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .when(form == 4, F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '-0700'"))
        .when(form == 5, F.concat(F.unix_seconds("ts").cast("string"), F.lit(".75 s")))
        .when(form == 6, F.unix_millis("ts").cast("string"))
        .otherwise(F.concat(F.lit("at "), us.cast("string")))
    )
    return e.select("event_id", F.unix_micros(parse_timestamp(text)).alias("ts_us"))


@query("severity_counts")
def severity_counts(spark, sf_dir):
    e = base_events(spark, sf_dir)
    word = F.element_at(
        F.array(*[F.lit(w) for w in ("error", "ERR", "Warning", "WARN", "information", "critical", "x")]),
        (F.col("event_id") % 7 + 1).cast("int"),
    )
    return (
        e.groupBy(parse_severity(word).alias("level"))
        .agg(F.count("*").alias("events"))
        .select(severity_text("level").alias("severity"), "events")
    )


@query("render_time")
def render_times(spark, sf_dir):
    return log_events(spark, sf_dir).select(
        F.col("seq").alias("event_id"),
        render_time("ts", "absolute").alias("absolute"),
        render_time("ts", "unix").alias("unix"),
        render_time("ts", "relative").alias("clock"),
        render_rfc3339("ts").alias("rfc3339"),
        render_fields("fields").alias("fields_text"),
        display_name().alias("name"),
    )


@query("label_filter")
def label_filter(spark, sf_dir):
    out = align.label_filter(log_events(spark, sf_dir), {"k": "7"}, "severity >= 3")
    return out.select(F.col("seq").alias("event_id"), "source", "service")


@query("errors_only")
def errors_only(spark, sf_dir):
    return log_events(spark, sf_dir).where(is_error()).select(F.col("seq").alias("event_id"))


@query("signal_only")
def signal_only(spark, sf_dir):
    out = align.signal_only(correlate(log_events(spark, sf_dir), ALL_SIGNALS))
    return out.select(F.col("seq").alias("event_id"), "service", "signal_type", "cascade_from")


@query("services_filter")
def services_filter(spark, sf_dir):
    out = cascade.cascade_origins(log_events(spark, sf_dir), WINDOW_MS)
    return align.services_filter(out, ["svc-1", "svc-2"]).select(
        F.col("s").alias("event_id"), "service", "cascade_from"
    )


# --- cascades --------------------------------------------------------------------------------------


@query("error_bursts")
def error_bursts(spark, sf_dir):
    out = cascade.error_bursts(log_events(spark, sf_dir), WINDOW_MS)
    return out.select(
        "service",
        F.col("onset.t").alias("onset_us"),
        F.col("last.t").alias("last_us"),
        "errors",
        F.col("closed.t").alias("closed_us"),
    )


@query("trace_first_error")
def trace_first_error(spark, sf_dir):
    out = cascade.trace_first_error(log_events(spark, sf_dir))
    return out.select("trace_id", "service", F.col("first_error.t").alias("first_us"))


def _origins(spark, sf_dir, by_trace: bool) -> DataFrame:
    out = cascade.cascade_origins(log_events(spark, sf_dir), WINDOW_MS, by="trace" if by_trace else "overlap")
    return out.select(F.col("s").alias("event_id"), "service", "cascade_from")


@query("cascade_trace")
def cascade_trace(spark, sf_dir):
    return _origins(spark, sf_dir, True)


@query("cascade_temporal")
def cascade_temporal(spark, sf_dir):
    return _origins(spark, sf_dir, False)


@query("cascades")
def cascades(spark, sf_dir):
    """Flagship on small data: every error that follows another service's error."""
    out = cascade.mark_new(
        materialize(cascade.cascade_origins(log_events(spark, sf_dir), WINDOW_MS))
    )
    return out.select(
        F.col("s").alias("event_id"),
        F.col("t").alias("ts_us"),
        "service",
        "cascade_from",
        F.col("new_cascade").cast("int").alias("new_cascade"),
    )


def _edges(spark, sf_dir) -> DataFrame:
    found = cascade.cascade_origins(log_events(spark, sf_dir), WINDOW_MS)
    return report.cascade_edges(
        found.select("cascade_from", "service", F.timestamp_micros("t").alias("ts"), F.col("s").alias("seq"))
    )


@query("cascade_edges")
def cascade_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select(
        "cascade_from", "service", _us("first_ts").alias("first_us"), "errors"
    )


@query("cascade_chains")
def cascade_chains(spark, sf_dir):
    out = report.cascade_chains(_edges(spark, sf_dir))
    return out.select(
        F.col("first_seq").alias("event_id"),
        "chain_id",
        "hop",
        F.array_join("chain", " > ").alias("chain"),
    )


@query("drift_warnings")
def drift_warnings(spark, sf_dir):
    out = cascade.drift_origins(log_events(spark, sf_dir), WINDOW_MS, TOLERANCE_MS)
    return out.select(F.col("s").alias("event_id"), "service", "cascade_from")


# --- rates, anomalies, silence -----------------------------------------------------------------------


@query("error_rates")
def error_rates(spark, sf_dir):
    rows = anomaly.error_rows(cascade.error_table(log_events(spark, sf_dir)))
    out = rates.half_window_rates(rows, ANOMALY_US)
    return out.select(F.col("k").alias("service"), F.col("s").alias("event_id"), "older", "recent")


@query("volume_rates")
def volume_rates(spark, sf_dir):
    rows = log_events(spark, sf_dir).select(
        F.col("service").alias("k"), _us().alias("t"), F.col("seq").alias("s")
    )
    out = rates.half_window_rates(rows, SILENCE_US, inclusive_span=True)
    return out.select(F.col("k").alias("service"), F.col("s").alias("event_id"), "older", "recent")


@query("trailing_count")
def trailing_count(spark, sf_dir):
    rows = log_events(spark, sf_dir).select(
        F.col("source").alias("k"), _us().alias("t"), F.col("seq").alias("s")
    )
    out = rates.trailing_count(rows, HOUR_US)
    return out.select(F.col("k").alias("source"), F.col("s").alias("event_id"), "n")


@query("anomaly")
def anomalies(spark, sf_dir):
    out = anomaly.find_anomalies(log_events(spark, sf_dir), ANOMALY_US, ANOMALY_MULTIPLIER)
    return out.select("service", F.col("s").alias("event_id"), "older", "recent")


def _silence(spark, sf_dir, **options) -> DataFrame:
    return silence.detect_silence(log_events(spark, sf_dir), SILENCE_US, SILENCE_PCT, **options)


@query("silence")
def silence_events(spark, sf_dir):
    return _silence(spark, sf_dir).select(
        "service",
        F.col("s").alias("event_id"),
        "older",
        "recent",
        F.round("drop_pct", 6).alias("drop_pct"),
        F.round("baseline_rate", 9).alias("baseline_rate"),
        F.round("current_rate", 9).alias("current_rate"),
    )


@query("silence_ticks")
def silence_ticks(spark, sf_dir):
    out = _silence(spark, sf_dir, check="tick", tick_us=HOUR_US)
    return out.select("service", F.col("t").alias("tick_us"), "older", "recent")


# --- the whole run -----------------------------------------------------------------------------------


@query("correlate")
def correlated(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    out = correlate(ev, ALL_SIGNALS)
    return out.select(
        F.col("seq").alias("event_id"),
        _us().alias("ts_us"),
        "source",
        "service",
        severity_text().alias("severity"),
        "message",
        F.col("is_signal").cast("int").alias("is_signal"),
        "signal_type",
        "cascade_from",
        F.col("new_cascade").cast("int").alias("new_cascade"),
        F.array_join("silence.service", ",").alias("silent_services"),
    )


@query("run_summary")
def run_summary(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    found = detect(ev, ALL_SIGNALS)
    return report.run_summary(annotate(ev, found), found.silence)


@query("signal_history")
def history(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    found = detect(ev, ALL_SIGNALS)
    out = signal_history(annotate(ev, found), found.silence)
    return out.select(_us().alias("ts_us"), "signal_type", "service", "cascade_from")


@query("suppress")
def suppressed(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    found = detect(ev, ALL_SIGNALS).signals.select(
        F.timestamp_micros("t").alias("ts"), "s", "service", "signal_type"
    )
    rules = spark.createDataFrame(
        [("svc-3", None, None), ("svc-4", SINCE, UNTIL)],
        "service string, from_ts timestamp, to_ts timestamp",
    )
    return report.suppress(found, rules).select(
        F.col("s").alias("event_id"), "service", "signal_type"
    )


@query("suggest_offsets")
def suggest_offsets(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    out = align.suggest_offsets(ev, "src-0")
    return out.select("source", F.round("offset_ms", 3).alias("offset_ms"), "traces")


@query("source_health")
def source_health(spark, sf_dir):
    ev = log_events(spark, sf_dir)
    now = ev.agg(F.max(_us())).first()[0]
    out = report.source_health(ev, now, quiet_after_us=600_000_000, bad_share=0.2)
    return out.select(
        "source", "events", "errors", "last_us", F.round("per_minute", 6).alias("per_minute"), "state"
    )
