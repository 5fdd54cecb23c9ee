"""Export payloads of log stores, one JSON text per row, to events.

Each normaliser takes landed API responses (column `payload` by default) and returns the event
schema. A response is split into its records on the cluster; nothing is fetched here. With `failures`, what can't be
read is an ERROR event among the others, from the same pass; else it is left out, and `failed_records_as_events` gives it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from faultline.functions.maps import first_present, guard_name, json_map, without_keys
from faultline.functions.severity import (
    parse_severity,
    parse_severity_datadog,
    parse_severity_google,
)
from faultline.functions.timestamps import parse_iso
from faultline.schema import ERROR, cell_of, present
from faultline.sources.lines import finish

# Keys that name each part, in order of preference.
STREAM_SERVICE_LABELS = ("service", "app", "job", "container")
LINE_SEVERITY_KEYS = ("level", "severity", "lvl")
LINE_MESSAGE_KEYS = ("message", "msg", "log")
LINE_TRACE_KEYS = ("trace_id", "traceId", "request_id")
DOC_TIME_KEYS = ("@timestamp", "timestamp", "time", "ts")
DOC_SEVERITY_KEYS = ("level", "severity", "log.level", "lvl")
DOC_MESSAGE_KEYS = ("message", "msg", "log.message", "log")
DOC_SERVICE_KEYS = ("service.name", "service", "app", "application")
DOC_TRACE_KEYS = ("trace.id", "trace_id", "traceId", "request_id")
ATTRIBUTE_TRACE_KEYS = ("trace_id", "dd.trace_id", "traceId")
RESOURCE_SERVICE_LABELS = ("container_name", "service_name", "module_id")

# Where each store's responses hold their records, and the prefixes of failure messages.
RECORDS = {
    "loki": (("data", "result"), "stream map<string,string>, values array<array<string>>"),
    "elasticsearch": (("hits", "hits"), "_source map<string,string>"),
    "datadog": (
        ("data",),
        "attributes struct<timestamp string, status string, message string, service string, "
        "attributes map<string,string>>",
    ),
    "googlecloud": (
        ("entries",),
        "logName string, resource struct<type string, labels map<string,string>>, severity string, "
        "textPayload string, jsonPayload map<string,string>, timestamp string, "
        "labels map<string,string>, trace string",
    ),
}
FAILURE_PREFIX = {"elasticsearch": "elasticsearch adapter error: ", "cloudwatch": "cloudwatch adapter error (group "}
OTHER_PREFIX = "adapter error: "

_EMPTY = "map<string,string>"
_CORRUPT = "_corrupt_record"


def read_records(df: DataFrame, kind: str, column: str = "payload") -> DataFrame:
    """One row per record: `record`, or `failed_text` of a record or a whole response that can't be read.

    A response of the right shape is parsed once. Any other is taken apart: it fails as a whole if it isn't one JSON object
    with a list (or nothing) at the place of the records, or if text follows the object; else record by record. So
    every record of a response gives one row.
    """
    path, fields = RECORDS[kind]
    guard = guard_name()

    def response(records: str) -> str:
        for name in reversed(path):
            records = f"struct<{name} {records}>"
        return f"struct<r {records}, {guard} boolean, {_CORRUPT} string>"

    def member(parsed: str) -> Column:
        return F.col(".".join((parsed, "r", *path)))

    def sound(parsed: str) -> Column:
        ended = F.coalesce(F.col(f"{parsed}.{guard}"), F.lit(False))
        return ended & F.col(f"{parsed}.{_CORRUPT}").isNull() & F.col(f"{parsed}.r").isNotNull()

    # what is put after the payload is only read if nothing else follows its value; no payload can name it
    whole = F.concat(F.lit('{"r":'), F.col(column), F.lit(f',"{guard}":true}}'))
    schema = StructType.fromDDL(fields)
    names = schema.fieldNames()
    # members whose shape is checked by hand: the parser makes some of them NULL without a word
    inner = [(f.name,) for f in schema if not isinstance(f.dataType, StringType)]
    inner += [
        (f.name, g.name)
        for f in schema
        if isinstance(f.dataType, StructType)
        for g in f.dataType
        if not isinstance(g.dataType, StringType)
    ]
    no_text = F.lit(None).cast("string")
    no_record = F.lit(None).cast(f"struct<{fields}>")

    def outcome(record: Column, text: Column) -> Column:
        return F.struct(record.alias("record"), text.alias("failed_text"))

    def one(text: Column) -> Column:
        parsed = F.from_json(text, f"struct<{fields}, {_CORRUPT} string>")
        bad = ~F.coalesce(F.startswith(F.ltrim(text), F.lit("{")), F.lit(False)) | parsed[_CORRUPT].isNotNull()
        for place in inner:
            value = parsed[place[0]] if len(place) == 1 else parsed[place[0]][place[1]]
            bad = bad | (F.get_json_object(text, "$." + ".".join(place)).isNotNull() & value.isNull())
        record = F.struct(*[parsed[n].alias(n) for n in names])
        return F.when(bad, outcome(no_record, F.coalesce(text, F.lit("null")))).otherwise(outcome(record, no_text))

    parts = F.from_json(member("apart"), "array<string>")
    results = (
        F.when(sound("fast"), F.transform(member("fast"), lambda x: F.when(x.isNull(), outcome(no_record, F.lit("null"))).otherwise(outcome(x, no_text))))
        .when(sound("apart") & F.startswith(member("apart"), F.lit("[")) & parts.isNotNull(), F.transform(parts, one))
        .otherwise(F.array(outcome(no_record, F.coalesce(F.col(column), F.lit("no payload")))))
    )
    return (
        df.withColumn("fast", F.from_json(whole, response(f"array<struct<{fields}>>")))
        .withColumn("apart", F.when(~sound("fast"), F.from_json(whole, response("string"))))
        .withColumn("outcome", F.explode(results))
        .withColumns({"record": F.col("outcome.record"), "failed_text": F.col("outcome.failed_text")})
        .drop("fast", "apart", "outcome")
    )


def _records(df: DataFrame, kind: str, column: str, failures: bool) -> DataFrame:
    records = read_records(df, kind, column)
    return records if failures else records.where(F.col("failed_text").isNull())


def _failure(kind: str, source: Column, ingest_ts: Column) -> dict[str, Column]:
    """The event parts of a record or response that can't be read."""
    return {
        "ts": ingest_ts.cast("timestamp"),
        "service": source,
        "severity": F.lit(ERROR),
        "message": F.concat(F.lit(FAILURE_PREFIX.get(kind, OTHER_PREFIX)), F.col("failed_text")),
        "trace_id": F.lit(None).cast("string"),
        "fields": F.create_map().cast(_EMPTY),
    }


def _finish(df: DataFrame, kind: str, source: str | None, ingest_ts: Column | None, keep: tuple, failures: bool) -> DataFrame:
    """`finish`, with rows of a failed_text turned into their errors where these are wanted."""
    if failures:
        now = F.current_timestamp() if ingest_ts is None else ingest_ts
        name = F.lit(source) if source is not None else F.col("source")
        failed = F.col("failed_text").isNotNull()
        df = df.withColumns({c: F.when(failed, v).otherwise(F.col(c)) for c, v in _failure(kind, name, now).items()})
    return finish(df, source, ingest_ts, keep)


def _line_parts(df: DataFrame, line: str) -> DataFrame:
    """Severity, message and trace of an embedded log line: JSON with a message, else the text."""
    obj = F.col("line_object")
    text = F.coalesce(F.col(line), F.lit(""))
    return df.withColumn("line_object", json_map(F.col(line))).withColumns(
        {
            "severity": parse_severity(first_present(obj, LINE_SEVERITY_KEYS)),
            "message": F.coalesce(present(first_present(obj, LINE_MESSAGE_KEYS)), text),
            "trace_id": first_present(obj, LINE_TRACE_KEYS),
        }
    )


def normalize_loki(
    df: DataFrame,
    source: str | None = None,
    ingest_ts: Column | None = None,
    keep: tuple = (),
    column: str = "payload",
    failures: bool = False,
) -> DataFrame:
    """Query-range responses: every value of every stream; a value without a numeric time is left out.

    `ts_ns` keeps the nanoseconds for ordering.
    """
    out = (
        _records(df, "loki", column, failures)
        .withColumn("stream", F.col("record"))
        .withColumn(
            "entry",
            F.explode(F.when(F.col("failed_text").isNotNull(), F.array(F.array().cast("array<string>"))).otherwise(F.col("stream.values"))),
        )
        .withColumn("ts_ns", F.get("entry", F.lit(0)).try_cast("bigint"))
        .where(F.col("ts_ns").isNotNull() | F.col("failed_text").isNotNull())
        .withColumns(
            {
                "ts": F.timestamp_micros(cell_of(F.col("ts_ns"), 1000)),
                "labels": F.col("stream.stream"),
                "entry_line": F.get("entry", F.lit(1)),
            }
        )
        .withColumns(
            {
                "service": first_present(F.col("labels"), STREAM_SERVICE_LABELS),
                "fields": F.coalesce(
                    without_keys(F.col("labels"), STREAM_SERVICE_LABELS),
                    F.create_map().cast(_EMPTY),
                ),
            }
        )
    )
    return _finish(_line_parts(out, "entry_line"), "loki", source, ingest_ts, ("ts_ns", *keep), failures)


def normalize_es(
    df: DataFrame,
    source: str | None = None,
    ingest_ts: Column | None = None,
    keep: tuple = (),
    column: str = "payload",
    failures: bool = False,
) -> DataFrame:
    """Search responses: every hit's flat document. Names with a dot are keys as they stand."""
    doc = F.col("doc")
    every_key = (
        DOC_TIME_KEYS + DOC_SEVERITY_KEYS + DOC_MESSAGE_KEYS + DOC_SERVICE_KEYS + DOC_TRACE_KEYS
    )
    out = (
        _records(df, "elasticsearch", column, failures)
        .withColumn("doc", F.coalesce("record._source", F.create_map().cast(_EMPTY)))
        .withColumns(
            {
                "ts": F.coalesce(
                    *[parse_iso(F.try_element_at(doc, F.lit(k))) for k in DOC_TIME_KEYS]
                ),
                "severity": parse_severity(first_present(doc, DOC_SEVERITY_KEYS)),
                "message": F.coalesce(first_present(doc, DOC_MESSAGE_KEYS), F.lit("")),
                "service": first_present(doc, DOC_SERVICE_KEYS),
                "trace_id": first_present(doc, DOC_TRACE_KEYS),
                "fields": without_keys(doc, every_key),
            }
        )
    )
    return _finish(out, "elasticsearch", source, ingest_ts, keep, failures)


def normalize_cloudwatch(
    df: DataFrame,
    source: str | None = None,
    ingest_ts: Column | None = None,
    keep: tuple = (),
) -> DataFrame:
    """Records with log_group, timestamp (epoch ms), message and logStreamName columns."""
    stream = F.when(
        F.col("logStreamName").isNotNull(),
        F.create_map(
            F.lit("log_group"), "log_group", F.lit("log_stream"), F.col("logStreamName")
        ),
    )
    out = df.withColumns(
        {
            "ts": F.timestamp_millis(F.coalesce("timestamp", F.lit(0).cast("bigint"))),
            "service": F.substring_index("log_group", "/", -1),
            "fields": F.coalesce(stream, F.create_map(F.lit("log_group"), "log_group")),
        }
    )
    return finish(_line_parts(out, "message"), source, ingest_ts, keep)


def normalize_datadog(
    df: DataFrame,
    source: str | None = None,
    ingest_ts: Column | None = None,
    keep: tuple = (),
    column: str = "payload",
    failures: bool = False,
) -> DataFrame:
    """Search responses: every entry of `data`. Attributes give the trace and are not copied."""
    out = (
        _records(df, "datadog", column, failures)
        .withColumn("a", F.col("record.attributes"))
        .withColumns(
            {
                "ts": parse_iso(F.col("a.timestamp")),
                "severity": parse_severity_datadog(F.coalesce("a.status", F.lit(""))),
                "message": F.coalesce("a.message", F.lit("")),
                "service": F.col("a.service"),
                "trace_id": first_present(F.col("a.attributes"), ATTRIBUTE_TRACE_KEYS),
                "fields": F.create_map().cast(_EMPTY),
            }
        )
    )
    return _finish(out, "datadog", source, ingest_ts, keep, failures)


def normalize_gcl(
    df: DataFrame,
    source: str | None = None,
    ingest_ts: Column | None = None,
    keep: tuple = (),
    column: str = "payload",
    failures: bool = False,
) -> DataFrame:
    """Entry lists: text or JSON payload; the service from labels, else from the log name."""
    body, text = F.col("e.jsonPayload"), present("e.textPayload")
    from_body = F.when(text.isNull(), present(first_present(body, LINE_TRACE_KEYS)))
    from_path = F.when(
        F.contains("e.trace", F.lit("/")), F.substring_index("e.trace", "/", -1)
    )
    log_name = F.when(
        F.contains("e.logName", F.lit("/logs/")), F.substring_index("e.logName", "/logs/", -1)
    )
    resource = F.col("e.resource.labels")
    out = (
        _records(df, "googlecloud", column, failures)
        .withColumn("e", F.col("record"))
        .withColumns(
            {
                "ts": parse_iso(F.col("e.timestamp")),
                "severity": parse_severity_google(F.coalesce("e.severity", F.lit(""))),
                "message": F.coalesce(text, first_present(body, LINE_MESSAGE_KEYS), F.lit("")),
                "trace_id": F.coalesce(from_body, from_path),
                "service": F.coalesce(
                    present(F.try_element_at("e.labels", F.lit("service"))),
                    *[
                        present(F.try_element_at(resource, F.lit(k)))
                        for k in RESOURCE_SERVICE_LABELS
                    ],
                    F.replace(log_name, F.lit("%2F"), F.lit("/")),
                ),
                "fields": F.create_map().cast(_EMPTY),
            }
        )
    )
    return _finish(out, "googlecloud", source, ingest_ts, keep, failures)


def failed_records_as_events(
    df: DataFrame, kind: str, source: Column | str, ingest_ts: Column, column: str = "payload",
    keep: tuple = (),
) -> DataFrame:
    """One ERROR event per response or record that cannot be read; the run over the others goes on.

    The failing source is both source and service of the event; the message holds the text that failed. An object
    without the member that holds records is an empty response, not a failure. For "cloudwatch", `column` holds a
    response that isn't JSON, and the message names the log group of its row.
    """
    source = F.lit(source) if isinstance(source, str) else source
    if kind == "cloudwatch":
        broken = df.withColumn("failed_text", F.coalesce(F.col(column), F.lit("no payload")))
        broken = broken.where(F.try_parse_json(F.col(column)).isNull())
        group = F.coalesce("log_group", F.lit("")) if "log_group" in df.columns else F.lit("")
        message = F.concat(F.lit(FAILURE_PREFIX[kind]), group, F.lit("): "), F.col("failed_text"))
        parts = _failure(kind, source, ingest_ts) | {"message": message}
    else:
        broken = read_records(df, kind, column).where(F.col("failed_text").isNotNull())
        parts = _failure(kind, source, ingest_ts)
    return finish(broken.withColumns(parts | {"source": source}), None, ingest_ts, keep)
