"""The given events as the raw lines and export payloads that log sources deliver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.tables import base_events
from faultline.schema import cell_of

# Records per exported response; a response never grows with the table.
RECORDS_PER_RESPONSE = 8

# The severity word each event type is logged with.
LEVEL_WORD = {
    "error": "error",
    "purchase": "warning",
    "signup": "info",
    "click": "debug",
    "view": "trace",
}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the given file is one split; rows are dealt out before the texts are built and parsed
    e = base_events(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    word = F.lit(None).cast("string")
    for name, level in LEVEL_WORD.items():
        word = F.when(F.col("event_type") == name, F.lit(level)).otherwise(word)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        "ts",
        F.unix_micros("ts").alias("t"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service"),
        "event_type",
        "value",
        word.alias("word"),
        F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("message"),
        k.alias("k"),
        F.when(k % 2 == 1, F.concat(F.lit("t-"), k.cast("string"))).alias("trace"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"),
    )


def _pick(by: str, n: int, options: list[Column]) -> Column:
    chosen = options[-1]
    for i, option in reversed(list(enumerate(options[:-1]))):
        chosen = F.when(F.col(by) % n == i, option).otherwise(chosen)
    return chosen


def _json(**members: Column | str) -> Column:
    return F.to_json(
        F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in members.items()])
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as files hold them: three JSON dialects, two plain-text forms, some padding."""
    p = _parts(spark, sf_dir)
    spaced = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = _pick(
        "event_id",
        6,
        [
            _json(timestamp="iso", level="word", service="service", message="message",
                  trace_id="trace", k="k"),
            _json(ts=F.unix_millis("ts"), lvl=F.upper("word"), app="service", msg="message",
                  requestId="trace", value="value"),
            _json(**{"time": F.lit("no time"), "@timestamp": spaced, "severity": F.initcap("word"),
                     "component": "service", "text": "message", "x-trace-id": "trace"}),
            F.concat("iso", F.lit(" ["), F.upper("word"), F.lit("]  "), "message"),
            F.concat(F.lit("  "), spaced, F.lit(" <"), "service", F.lit("> "), "word",
                     F.lit(": "), "message", F.lit("\t")),
            F.when(F.col("event_id") % 5 == 0, F.lit("   ")).otherwise(
                F.concat(
                    F.when(F.col("event_id") % 5 == 1, F.lit('{"broken":"x"} ')).otherwise(F.lit('{"broken": ')),
                    "message",
                )
            ),
        ],
    )
    return p.select("event_id", F.col("ts").alias("ingest_ts"), line.alias("value"))


def _responses(p: DataFrame, record: Column, *by: str) -> DataFrame:
    """Group records to responses of bounded size."""
    return p.groupBy(
        cell_of(F.col("event_id"), RECORDS_PER_RESPONSE).alias("response_id"), *by
    ).agg(F.collect_list(record).alias("records"), F.max("ts").alias("ingest_ts"))


def loki_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    line = _pick(
        "event_id",
        3,
        [
            _json(level="word", msg="message", traceId="trace"),
            F.concat("word", F.lit(": "), "message"),
            _json(level=F.upper("word"), detail="message"),
        ],
    )
    ns = F.when(F.col("event_id") % 11 == 0, F.lit("soon")).otherwise(
        (F.col("t") * 1000 + F.col("event_id") % 1000).cast("string")
    )
    grouped = _responses(p, F.array(ns, line), "service")
    labels = F.when(
        F.col("response_id") % 2 == 0,
        F.create_map(F.lit("service"), "service", F.lit("app"), F.lit("other"), F.lit("env"), F.lit("prod")),
    ).otherwise(F.create_map(F.lit("job"), "service", F.lit("zone"), F.lit("z1")))
    stream = F.struct(labels.alias("stream"), F.col("records").alias("values"))
    return grouped.select(
        "response_id",
        "ingest_ts",
        F.to_json(F.struct(F.struct(F.array(stream).alias("result")).alias("data"))).alias("payload"),
    )


def es_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).withColumn("k", F.col("k").cast("string"))
    docs = []
    for names in (
        {"@timestamp": "iso", "log.level": "word", "message": "message", "service.name": "service",
         "trace.id": "trace", "k": "k", "host.name": F.lit("h1")},
        {"timestamp": "iso", "severity": F.upper("word"), "msg": "message", "app": "service",
         "request_id": "trace", "k": "k"},
        {"@timestamp": F.lit("yesterday"), "ts": "iso", "lvl": "word", "log.message": "message",
         "application": "service", "traceId": "trace", "log": F.lit("unused"), "k": "k"},
    ):
        pairs = [c for n, v in names.items() for c in (F.lit(n), F.col(v) if isinstance(v, str) else v)]
        docs.append(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))
    grouped = _responses(p, _pick("event_id", 3, docs))
    hits = F.transform("records", lambda d: F.struct(d.alias("_source")))
    return grouped.select(
        "response_id",
        "ingest_ts",
        F.to_json(F.struct(F.lit("next").alias("_scroll_id"), F.struct(hits.alias("hits")).alias("hits"))).alias("payload"),
    )


def cloudwatch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    message = _pick(
        "event_id",
        3,
        [
            _json(severity="word", log="message", request_id="trace"),
            F.concat(F.lit("INFO "), "message"),
            F.concat(F.lit("{not json "), "message"),
        ],
    )
    return p.select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/ecs/"), "service"))
        .otherwise(F.col("service"))
        .alias("log_group"),
        F.unix_millis("ts").alias("timestamp"),
        message.alias("message"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("stream-"), (F.col("event_id") % 4).cast("string")))
        .alias("logStreamName"),
    )


# Status words of the two stores that have their own severity scale.
DATADOG_STATUS = ("emergency", "warning", "notice", "debug", "unheard-of")
GOOGLE_SEVERITY = ("CRITICAL", "warning", "NOTICE", "DEBUG", "DEFAULT")


def datadog_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    status = _pick("event_id", len(DATADOG_STATUS), [F.lit(w) for w in DATADOG_STATUS])
    key = _pick("event_id", 3, [F.lit("trace_id"), F.lit("dd.trace_id"), F.lit("traceId")])
    attributes = F.when(
        F.col("trace").isNotNull(),
        F.create_map(key, F.col("trace"), F.lit("k"), F.col("k").cast("string")),
    )
    entry = F.struct(
        F.struct(
            F.col("iso").alias("timestamp"),
            status.alias("status"),
            "message",
            "service",
            attributes.alias("attributes"),
        ).alias("attributes")
    )
    return _responses(p, entry).select(
        "response_id", "ingest_ts", F.to_json(F.struct(F.col("records").alias("data"))).alias("payload")
    )


def google_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    n = F.col("event_id") % 4
    none = F.lit(None)
    body = F.map_filter(
        F.create_map(F.lit("msg"), F.col("message"), F.lit("traceId"), F.col("trace")),
        lambda _, v: v.isNotNull(),
    )
    entry = F.struct(
        F.concat(F.lit("projects/p/logs/"), "service", F.lit("%2Fhttp")).alias("logName"),
        F.struct(
            F.lit("k8s").alias("type"),
            F.when(n == 1, F.create_map(F.lit("container_name"), F.lit(""), F.lit("module_id"), F.col("service")))
            .otherwise(none.cast("map<string,string>")).alias("labels"),
        ).alias("resource"),
        _pick("event_id", len(GOOGLE_SEVERITY), [F.lit(w) for w in GOOGLE_SEVERITY]).alias("severity"),
        F.when(F.col("event_id") % 2 == 0, F.col("message")).alias("textPayload"),
        F.when(F.col("event_id") % 2 == 1, body).alias("jsonPayload"),
        F.col("iso").alias("timestamp"),
        F.when(n == 0, F.create_map(F.lit("service"), F.concat(F.lit("label-"), "service"))).alias("labels"),
        F.concat(F.lit("projects/p/traces/top-"), F.col("k").cast("string")).alias("trace"),
    )
    return _responses(p, entry).select(
        "response_id", "ingest_ts", F.to_json(F.struct(F.col("records").alias("entries"))).alias("payload")
    )


def responses(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Responses of a store of which a fifth each was cut off, holds a number among its records, is followed by text."""
    make, opening = {
        "loki": (loki_payloads, '"result":['),
        "elasticsearch": (es_payloads, '"hits":['),
        "datadog": (datadog_payloads, '"data":['),
        "googlecloud": (google_payloads, '"entries":['),
    }[kind]
    how = F.col("response_id") % 5
    damaged = (
        F.when(how == 0, F.expr("substring(payload, 1, length(payload) - 1)"))
        .when(how == 1, F.replace("payload", F.lit(opening), F.lit(f"{opening}5,")))
        .when(how == 2, F.concat("payload", F.lit(" "), "payload"))
        .otherwise(F.col("payload"))
    )
    return make(spark, sf_dir).withColumn("payload", damaged)


def damaged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of which every fifth was cut off in transfer."""
    whole = datadog_payloads(spark, sf_dir)
    cut = F.expr("substring(payload, 1, length(payload) - 1)")
    return whole.withColumn(
        "payload", F.when(F.col("response_id") % 5 == 0, cut).otherwise(F.col("payload"))
    )
