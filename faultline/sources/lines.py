"""Line logs: one JSON object or one plain-text record per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.maps import json_map, present_key, residual_fields
from faultline.functions.severity import parse_severity
from faultline.functions.timestamps import parse_timestamp
from faultline.schema import UNKNOWN, as_event, present

# Keys that name each part of an event, in order of preference.
TIME_KEYS = ("timestamp", "time", "ts", "@timestamp", "logged_at")
SEVERITY_KEYS = ("level", "severity", "lvl", "log_level")
MESSAGE_KEYS = ("message", "msg", "log", "text")
SERVICE_KEYS = ("service", "service_name", "app", "application", "component")
TRACE_KEYS = ("trace_id", "traceId", "trace", "x-trace-id", "request_id", "requestId")

# White space in the Unicode sense.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
_SPACE = r"[\s\x85\p{Z}]+"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def scan_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed non-blank lines with the parsed object where the line is one (`object`)."""
    kept = df.withColumn("line", trimmed(F.col(column))).where(F.col("line") != "")
    return kept.withColumn("object", json_map(F.col("line")))


def _any_time(obj: Column) -> Column:
    """(key, ts) of the first time key whose value parses; for objects whose first one does not."""
    tried = F.transform(
        F.array(*[F.lit(k) for k in TIME_KEYS]),
        lambda k: F.struct(k.alias("key"), parse_timestamp(F.try_element_at(obj, k)).alias("ts")),
    )
    return F.get(F.filter(tried, lambda x: x["ts"].isNotNull()), F.lit(0))


def _parts(df: DataFrame, extra_layouts: bool) -> DataFrame:
    """Add the event parts of `object`, or of the plain text in `line` where there is no object.

    Written in steps, so that no expression is worked out twice and the code of each step stays
    small enough to be compiled.
    """
    obj, token = F.col("object"), F.get("tokens", F.lit(0))
    is_object = obj.isNotNull()
    pair = F.concat(token, F.lit("T"), F.get("tokens", F.lit(1)))
    spaced = F.regexp_replace(F.concat(token, F.lit(" "), F.get("tokens", F.lit(1))), r"[\[\]]", "")
    second = parse_timestamp(pair)
    if extra_layouts:
        second = F.coalesce(second, parse_timestamp(spaced))
    promoted = [F.col(k) for k in ("k_time", "k_severity", "k_message", "k_service", "k_trace")]

    def level(i: int) -> Column:
        word = F.get("tokens", F.col("skip") + i)
        return parse_severity(F.btrim(word, F.lit("[]()<>")))

    text_message = F.array_join(
        F.slice("tokens", F.col("skip") + F.col("at") + 1, F.size("tokens")), " "
    )
    return (
        df.withColumns(
            {
                "tokens": F.when(obj.isNull(), F.split("line", _SPACE)),
                "k_first": present_key(obj, TIME_KEYS),
                "k_severity": present_key(obj, SEVERITY_KEYS),
                "k_message": present_key(obj, MESSAGE_KEYS),
                "k_service": present_key(obj, SERVICE_KEYS),
                "k_trace": present_key(obj, TRACE_KEYS),
            }
        )
        .withColumn("time_text", F.coalesce(F.try_element_at(obj, F.col("k_first")), token))
        .withColumn("ts1", parse_timestamp(F.col("time_text")))
        .withColumn("ts2", F.when(F.col("ts1").isNull() & obj.isNull(), second))
        .withColumn(
            "tried",
            F.when(F.col("ts1").isNull() & F.col("k_first").isNotNull(), _any_time(obj)),
        )
        .withColumns(
            {
                "ts": F.coalesce("ts1", "ts2", "tried.ts"),
                "k_time": F.when(F.col("ts1").isNotNull(), F.col("k_first")).otherwise(
                    F.col("tried.key")
                ),
                "skip": F.when(is_object, None)
                .when(F.col("ts1").isNotNull(), F.lit(1))
                .when(F.col("ts2").isNotNull(), F.lit(2))
                .otherwise(F.lit(0)),
            }
        )
        .withColumns({f"level{i}": level(i) for i in range(3)})
        .withColumn(
            "at",
            F.when(F.col("level0") != UNKNOWN, F.lit(1))
            .when(F.col("level1") != UNKNOWN, F.lit(2))
            .when(F.col("level2") != UNKNOWN, F.lit(3))
            .otherwise(F.lit(0)),
        )
        .withColumns(
            {
                "severity": F.when(
                    is_object, parse_severity(F.try_element_at(obj, F.col("k_severity")))
                ).otherwise(
                    F.when(F.col("at") == 1, F.col("level0"))
                    .when(F.col("at") == 2, F.col("level1"))
                    .otherwise(F.col("level2"))
                ),
                "message": F.when(
                    is_object, F.coalesce(F.try_element_at(obj, F.col("k_message")), F.lit(""))
                ).otherwise(text_message),
                "service": F.try_element_at(obj, F.col("k_service")),
                "trace_id": F.try_element_at(obj, F.col("k_trace")),
                "fields": F.coalesce(
                    residual_fields(obj, *promoted), F.create_map().cast("map<string,string>")
                ),
            }
        )
    )


def finish(
    df: DataFrame, source: str | None, ingest_ts: Column | None, keep: tuple = ()
) -> DataFrame:
    """The event schema; a missing time becomes the ingest time and is told by `ts_missing`."""
    now = F.current_timestamp() if ingest_ts is None else ingest_ts.cast("timestamp")
    out = df.withColumn("ts_missing", F.col("ts").isNull()).withColumn("ts", F.coalesce("ts", now))
    if source is not None:
        out = out.withColumn("source", F.lit(source))
    out = out.withColumns(
        {
            "raw_ts": F.col("ts"),
            "service": present("service"),
            "trace_id": present("trace_id"),
            "severity": F.coalesce("severity", F.lit(UNKNOWN)),
        }
    )
    return as_event(out, "ts_missing", *keep)


def normalize_lines(
    df: DataFrame,
    source: str | None = None,
    ingest_ts: Column | None = None,
    keep: tuple = (),
    column: str = "value",
    extra_layouts: bool = False,
) -> DataFrame:
    """Events from raw lines, in one pass: JSON objects where they parse, else plain text.

    In an object, known keys are promoted in order of preference and leave `fields`. Plain text is
    a leading time (the first token, or the first two joined by `T`), then a severity word among the
    next three tokens, then the message. With `extra_layouts` the first two tokens are also tried
    joined by a space, which lets slash dates and access-log times match.
    """
    parts = _parts(scan_lines(df, column), extra_layouts)
    return finish(parts, source, ingest_ts, keep)


def normalize_json(df: DataFrame, source: str | None = None, **options) -> DataFrame:
    """Events of the lines that are JSON objects."""
    column = options.get("column", "value")
    line = trimmed(F.col(column))
    return normalize_lines(df.where(json_map(line).isNotNull()), source, **options)


def normalize_text(df: DataFrame, source: str | None = None, **options) -> DataFrame:
    """Events of the lines that are not JSON objects."""
    column = options.get("column", "value")
    line = trimmed(F.col(column))
    return normalize_lines(df.where(json_map(line).isNull()), source, **options)


def read_logs(spark: SparkSession, path: str | list[str], source: str, **options) -> DataFrame:
    """Events of the line logs under `path`; large files are split over tasks."""
    return normalize_lines(spark.read.text(path), source, **options)


def stream_logs(
    spark: SparkSession, path: str, source: str, skip_existing_before=None, **options
) -> DataFrame:
    """Events of line logs as files appear under `path`.

    With `skip_existing_before`, lines of files last changed before that time are skipped.
    """
    lines = spark.readStream.text(path)
    if skip_existing_before is not None:
        lines = lines.where(
            F.col("_metadata.file_modification_time") >= F.lit(skip_existing_before)
        )
    return normalize_lines(lines, source, **options)
