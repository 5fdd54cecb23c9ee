"""Line and payload parsing, case by case."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from faultline.functions.render import quoted, render_rfc3339
from faultline.functions.severity import (
    parse_severity,
    parse_severity_datadog,
    parse_severity_google,
    severity_text,
)
from faultline.functions.timestamps import parse_duration, parse_timestamp, resolve_time
from faultline.operators import align
from faultline.sources import lines, payloads, registry, sinks

INGEST = datetime(2030, 1, 1, tzinfo=timezone.utc)


def one_column(spark, values, name="value"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def events_of(spark, texts, **options):
    df = lines.normalize_lines(
        one_column(spark, texts), "app", ingest_ts=F.lit(INGEST), keep=("i",), **options
    )
    return df.orderBy("i").withColumn("us", F.unix_micros("ts")).collect()


def micros(text):
    return int(datetime.fromisoformat(text).timestamp() * 1_000_000)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps(spark, zone):
    day = "2024-01-15T14:22:03+00:00"
    cases = {
        "2024-01-15T14:22:03.441Z": micros(day) + 441_000,
        "2024-01-15T14:22:03Z": micros(day),
        "2024-01-15T14:22:03.123456789Z": micros(day) + 123_456,
        "2024-01-15T14:22:03,5+01:00": micros(day) + 500_000 - 3_600_000_000,
        "2024-01-15T14:22:03.25": micros(day) + 250_000,
        "2024-01-15 14:22:03": micros(day),
        "2024/01/15 14:22:03": micros(day),
        "15/Jan/2024:14:22:03 -0700": micros(day) + 7 * 3_600_000_000,
        "1705328523": 1705328523_000_000,
        "1705328523.9": 1705328523_000_000,
        "1705328523441": 1705328523_441_000,
        "1.705328523441e12": 1705328523_441_000,
        "1705328523 tail": 1705328523_000_000,
        "not-a-timestamp": None,
        "": None,
        "2024-02-30T00:00:00Z": None,
        "2024-01-15": None,
        "12345": None,
        "1000000000": None,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = one_column(spark, cases).select(
            "value", F.unix_micros(parse_timestamp("value")).alias("us")
        )
        assert {r.value: r.us for r in df.collect()} == cases
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_severities(spark):
    words = {
        "error": 5, "ERROR": 5, "ERR": 5, "err": 5, "warn": 4, "WARNING": 4, "info": 3,
        "INFORMATION": 3, "debug": 2, "DEBUG": 2, "fatal": 6, "CRITICAL": 6, "trace": 1,
        "garbage": 0, "": 0, "Error": 0,
    }
    df = one_column(spark, words).select("value", parse_severity("value").alias("v"))
    assert {r.value: r.v for r in df.collect()} == words
    own = {"emergency": 5, "alert": 5, "warn": 4, "notice": 3, "debug": 2, "odd": 3, "ERROR": 3}
    df = one_column(spark, own).select("value", parse_severity_datadog("value").alias("v"))
    assert {r.value: r.v for r in df.collect()} == own
    cloud = {"alert": 5, "Warning": 4, "WARN": 3, "DEFAULT": 3, "debug": 2, "": 3}
    df = one_column(spark, cloud).select("value", parse_severity_google("value").alias("v"))
    assert {r.value: r.v for r in df.collect()} == cloud
    labels = spark.range(8).select(severity_text(F.col("id").cast("int")).alias("l")).collect()
    assert [r.l for r in labels] == [
        "UNKNOWN", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN",
    ]


def test_json_lines(spark):
    got = events_of(
        spark,
        [
            '{"ts":"2024-01-15T14:22:03Z","lvl":"error","app":"pay","msg":"full","pool_size":20,"waiting":47}',
            '{"time":"bad","@timestamp":1705328523441,"message":"m","requestId":"r1","nested":{"a":[1]}}',
            '  {"message":null,"msg":"second","service":"","level":"Error"}  ',
            '{"broken"',
            "{'single': 'quotes'}",
            "",
            "   \t ",
        ],
    )
    assert len(got) == 5
    first, second, third, fourth, fifth = got
    assert (first.service, first.severity, first.message) == ("pay", 5, "full")
    assert first.fields == {"pool_size": "20", "waiting": "47"}
    assert second.us == 1705328523_441_000 and second.trace_id == "r1"
    assert second.fields == {"time": "bad", "nested": '{"a":[1]}'}
    # The first key present wins although its value is null; an unknown word is used up too.
    assert (third.message, third.service, third.severity) == ("", None, 0)
    assert third.fields == {"msg": "second"}
    assert third.ts_missing and third.ts == INGEST.replace(tzinfo=None)
    assert fourth.message == '{"broken"' and fifth.message == "{'single': 'quotes'}"


def test_text_lines(spark):
    got = events_of(
        spark,
        [
            "2024-01-15T14:22:03Z [ERROR] 3 of 40 shards lost",
            "2024-01-15 14:22:03 <warn>  slow   query",
            "WARN no time here",
            "just words, a b ERROR",
            "2024/01/15 14:22:03 INFO slash",
            "2024-01-15T14:22:03Z",
        ],
    )
    assert [(r.severity, r.message) for r in got] == [
        (5, "3 of 40 shards lost"),
        (4, "slow query"),
        (4, "no time here"),
        (0, "just words, a b ERROR"),
        (3, "slash"),
        (0, ""),
    ]
    assert [r.ts_missing for r in got] == [False, False, True, True, True, False]
    (extra,) = events_of(spark, ["2024/01/15 14:22:03 INFO slash"], extra_layouts=True)
    assert not extra.ts_missing and extra.us == micros("2024-01-15T14:22:03+00:00")


def test_clock_offset_keeps_the_raw_time(spark):
    df = lines.normalize_lines(
        one_column(spark, ["2024-01-15T14:22:03Z x"]), "legacy", ingest_ts=F.lit(INGEST)
    )
    for offsets in (
        {"legacy": -200},
        align.settings_table(spark, [{"source": "legacy", "offset_ms": -200}]),
    ):
        row = align.clock_offset(df, offsets).first()
        assert row.raw_ts - row.ts == timedelta(milliseconds=200)


def test_loki(spark):
    line = json.dumps({"level": "error", "msg": "boom", "traceId": "abc"})
    payload = json.dumps(
        {"data": {"result": [{"stream": {"service": "pay", "app": "x", "env": "prod"},
          "values": [["1705328523441000123", line], ["x", "skipped"], ["1705328522000000000", "plain"],
                     ["1705328521000000000", '{"level":"warn"}']]}]}}
    )
    got = payloads.normalize_loki(one_column(spark, [payload], "payload"), "loki").orderBy("ts_ns").collect()
    assert [r.message for r in got] == ['{"level":"warn"}', "plain", "boom"]
    assert [r.severity for r in got] == [4, 0, 5]
    last = got[-1]
    assert (last.service, last.fields, last.trace_id) == ("pay", {"env": "prod"}, "abc")
    assert last.ts_ns == 1705328523441000123 and last.ts.microsecond == 441000


def test_elasticsearch(spark):
    docs = [
        {"@timestamp": "2024-01-15T14:22:03Z", "log.level": "error", "message": "m",
         "service.name": "pay", "trace.id": "t", "host": "h", "time": "unused", "n": 5},
        {"@timestamp": "1705328523", "ts": "2024-01-15T14:22:04+01:00", "msg": "n", "app": "x"},
    ]
    payload = json.dumps({"hits": {"hits": [{"_source": d} for d in docs]}})
    a, b = payloads.normalize_es(one_column(spark, [payload], "payload"), "es").orderBy("message").collect()
    assert (a.service, a.severity, a.trace_id, a.fields) == ("pay", 5, "t", {"host": "h", "n": "5"})
    assert b.ts == datetime(2024, 1, 15, 13, 22, 4) and b.service == "x"


def test_cloudwatch(spark):
    rows = [
        ("/ecs/payment-service", 1705328523441, '{"level":"error","msg":"m","request_id":"r"}', "s"),
        ("payment-service", 1705328523441, "plain", None),
        ("/", 1705328523441, "{bad", None),
    ]
    df = spark.createDataFrame(rows, "log_group string, timestamp bigint, message string, logStreamName string")
    got = {r.message: r for r in payloads.normalize_cloudwatch(df, "cw").collect()}
    assert got["m"].fields == {"log_group": "/ecs/payment-service", "log_stream": "s"}
    assert (got["m"].service, got["m"].severity, got["m"].trace_id) == ("payment-service", 5, "r")
    assert got["plain"].service == "payment-service" and got["{bad"].service is None


def test_datadog(spark):
    entries = [
        {"attributes": {"timestamp": "2024-01-15T14:22:03Z", "status": "critical", "message": "a",
                        "service": "s", "attributes": {"dd.trace_id": 77, "k": "v"}}},
        {"attributes": {"status": "unknown", "message": "b"}},
    ]
    df = one_column(spark, [json.dumps({"data": entries})], "payload")
    a, b = payloads.normalize_datadog(df, "dd", ingest_ts=F.lit(INGEST)).orderBy("message").collect()
    assert (a.severity, a.trace_id, a.fields) == (5, "77", {})
    assert (b.severity, b.ts_missing, b.service) == (3, True, None)


def test_google(spark):
    def entry(**e):
        return {"timestamp": "2024-01-15T14:22:03Z", **e}

    entries = [
        entry(textPayload="1", labels={"service": "lab"}, trace="projects/blue-77/traces/9c41e0"),
        entry(jsonPayload={"msg": "2", "trace_id": "own"}, trace="projects/blue-77/traces/9c41e0",
              resource={"labels": {"container_name": "", "service_name": "sn"}}),
        entry(textPayload="3", logName="projects/blue-77/logs/edge%2Fgrpc", severity="warning"),
        entry(textPayload="4", logName="none", trace="noslash"),
    ]
    df = one_column(spark, [json.dumps({"entries": entries})], "payload")
    got = payloads.normalize_gcl(df, "gcl").orderBy("message").collect()
    assert [r.service for r in got] == ["lab", "sn", "edge/grpc", None]
    assert [r.trace_id for r in got] == ["9c41e0", "own", None, None]
    assert got[2].severity == 4


PREFIX = {"elasticsearch": "elasticsearch adapter error: ", "cloudwatch": "cloudwatch adapter error (group g): "}


@pytest.mark.parametrize("kind", ["loki", "elasticsearch", "datadog", "googlecloud", "cloudwatch"])
def test_failed_payload_is_one_error_event(spark, kind):
    df = one_column(spark, ['{"data": [', "{}"], "payload").withColumn("log_group", F.lit("g"))
    got = payloads.failed_records_as_events(df, kind, "src", F.lit(INGEST)).collect()
    assert len(got) == 1
    assert (got[0].severity, got[0].service, got[0].source) == (5, "src", "src")
    assert got[0].message == PREFIX.get(kind, "adapter error: ") + '{"data": ['


NORMALISERS = {
    "loki": payloads.normalize_loki, "elasticsearch": payloads.normalize_es,
    "datadog": payloads.normalize_datadog, "googlecloud": payloads.normalize_gcl,
}
GOOD = {
    "loki": ('{"stream":{"app":"a"},"values":[["1705328523441000000","m"]]}', '{"data":{"result":%s}}'),
    "elasticsearch": ('{"_source":{"message":"m","ts":"2024-01-15T14:22:03Z"}}', '{"hits":{"hits":%s}}'),
    "datadog": ('{"attributes":{"message":"m","attributes":{"trace_id":"1"}}}', '{"data":%s}'),
    "googlecloud": ('{"textPayload":"m","timestamp":"2024-01-15T14:22:03Z"}', '{"entries":%s}'),
}
WRONG = {
    "loki": '{"stream":"x","values":[]}', "elasticsearch": '{"_source":"text"}',
    "datadog": '{"attributes":{"attributes":"text"}}', "googlecloud": '{"jsonPayload":"text"}',
}


@pytest.mark.parametrize("kind", sorted(NORMALISERS))
def test_no_record_is_lost(spark, kind):
    record, outer = GOOD[kind]
    whole = outer % f"[{record},{record}]"
    cases = {  # payload: (events, errors)
        whole: (2, 0),
        outer % f"[{record},5,{WRONG[kind]},null,{record}]": (2, 3),
        outer % f"[{WRONG[kind]}]": (0, 1), outer % f"[{record},{WRONG[kind]}]": (1, 1),
        outer % "[]": (0, 0), "{}": (0, 0), outer % "null": (0, 0),
        outer % '{"a":1}': (0, 1), outer % '"x"': (0, 1), outer % "5": (0, 1),
        "[1]": (0, 1), '"x"': (0, 1), "null": (0, 1), "": (0, 1),
        whole + " trailing": (0, 1), whole + whole: (0, 1), whole + "\n" + whole: (0, 1), whole + "}": (0, 1),
        "  " + whole + "\n": (2, 0),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, payload string")
    events = NORMALISERS[kind](df, "s", F.lit(INGEST), keep=("id",)).groupBy("id").count().collect()
    errors = payloads.failed_records_as_events(df, kind, "s", F.lit(INGEST), keep=("id",)).groupBy("id").count().collect()
    events, errors = ({r["id"]: r["count"] for r in x} for x in (events, errors))
    got = {p: (events.get(i, 0), errors.get(i, 0)) for i, p in enumerate(cases)}
    assert got == cases


def test_text_after_an_object_makes_a_plain_line(spark):
    lines_ = ['{"level":"error","message":"x"} trailing', '{"message":"a"}{"message":"b"}', '{"message":"a"},{"message":"b"}', '{"message":"a"}]']
    got = events_of(spark, [*lines_, '{"message":"alone"}'])
    assert sorted(r.message for r in got) == sorted([*lines_, "alone"])


def test_registry(spark):
    assert registry.normaliser_for("gcp") is payloads.normalize_gcl
    assert registry.normaliser_for("no such type") is lines.normalize_lines
    registry.register("own", lambda df, source: df)
    assert registry.normalize(spark.range(1), "own", "s").count() == 1


def test_result_json(spark):
    rows = [(datetime(2024, 1, 15, 14, 22, 3, 441000), "a", "s", 5, 'say "hi"', None, {"k": "v"}),
            (datetime(2024, 1, 15, 14, 22, 3), "", None, 0, "", "t", {})]
    df = spark.createDataFrame(
        rows, "ts timestamp, source string, service string, severity int, message string, "
        "trace_id string, fields map<string,string>"
    ).withColumns(
        {
            "silence": F.when(
                F.col("source") == "a",
                F.array(F.struct(F.lit("q").alias("service"), F.lit(95.0).alias("drop_pct"),
                                 F.lit(2.0).alias("baseline_rate"), F.lit(0.1).alias("current_rate"))),
            ),
        }
    )
    a, b = [json.loads(r.value) for r in sinks.to_result_json(df).collect()]
    assert a == {
        "timestamp": "2024-01-15T14:22:03.441Z", "service": "s", "source": "a", "severity": "ERROR",
        "message": 'say "hi"', "is_signal": False, "fields": {"k": "v"},
        "silence": [{"service": "q", "drop_pct": 95.0, "baseline_rate": 2.0, "current_rate": 0.1}],
    }
    assert b == {"timestamp": "2024-01-15T14:22:03Z", "severity": "UNKNOWN", "message": "",
                 "trace_id": "t", "is_signal": False}


def test_rendering(spark):
    df = spark.sql("select timestamp'2024-01-15 14:22:03.441' ts, 'a\"b' q")
    row = df.select(render_rfc3339().alias("r"), quoted(F.col("q")).alias("q")).first()
    assert (row.r, row.q) == ("2024-01-15T14:22:03.441Z", '"a\\"b"')


def test_time_arguments():
    now = datetime(2024, 1, 15, tzinfo=timezone.utc)
    assert resolve_time("15m", now) == now - timedelta(minutes=15)
    assert resolve_time("1h30m", now) == now - timedelta(minutes=90)
    assert resolve_time("2024-01-01T00:00:00+01:00", now) == datetime(2023, 12, 31, 23, tzinfo=timezone.utc)
    assert resolve_time("", now) is None
    assert parse_duration("1.5s") == timedelta(milliseconds=1500)
    for bad in ("15x", "soon", "m", "2024-01-01"):
        with pytest.raises(ValueError):
            resolve_time(bad, now)


def test_session_save_and_replay(spark, tmp_path):
    rows = [(datetime(2024, 1, d, 12), d) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "ts timestamp, seq int")
    sinks.save_session(df, f"{tmp_path}/s")
    back = sinks.replay_session(spark, f"{tmp_path}/s", since=datetime(2024, 1, 2))
    assert sorted(r.seq for r in back.collect()) == [2, 3]


def test_seq_of_equal_rows_is_unique_and_follows_time(spark):
    df = spark.range(1000).select(
        F.timestamp_seconds(F.col("id") % 3).alias("ts"), F.lit("same").alias("message")
    )
    got = align.with_seq(df).orderBy("seq").collect()
    assert len({r.seq for r in got}) == 1000
    assert [r.ts for r in got] == sorted(r.ts for r in got)


def test_stream_of_lines_skips_old_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('{"message":"m","level":"error"}\nplain\n')

    def read(name, **options):
        stream = lines.stream_logs(spark, f"{tmp_path}/in", "app", **options)
        query = (
            stream.select("message", "severity").writeStream.format("memory").queryName(name)
            .option("checkpointLocation", f"{tmp_path}/{name}").start()
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.message, r.severity) for r in spark.table(name).collect())

    assert read("all_lines") == [("m", 5), ("plain", 0)]
    assert read("new_lines", skip_existing_before=datetime(2100, 1, 1)) == []


def test_text_after_an_object_is_never_lost(spark):
    """Text that holds what the parser's own guard might be is still text after the object."""
    given = ['{"message":"x"},{}] lost tail', '{"message":"x"},{"g":"1"}]', '{"message":"x"} ]', '{"message":"whole"}']
    got = lines.normalize_lines(spark.createDataFrame([(x,) for x in given], "value string"), "app").select("message").collect()
    assert sorted(r.message for r in got) == sorted([*given[:3], "whole"])
    tail = '{"data":[]},"end":true} {"data":[{"attributes":{"message":"lost"}}]}'
    df = spark.createDataFrame([(tail,), ('{"data":[{"attributes":{"message":"m"}}, 5]}',)], "payload string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    both = payloads.normalize_datadog(df, "dd", now, failures=True).select("message", "severity", "service").collect()
    assert sorted(map(tuple, both)) == sorted(
        [("adapter error: " + tail, 5, "dd"), ("adapter error: 5", 5, "dd"), ("m", 3, None)]
    )
    apart = payloads.normalize_datadog(df, "dd", now).unionByName(payloads.failed_records_as_events(df, "datadog", "dd", now))
    assert sorted(map(tuple, apart.select("message", "severity", "service").collect())) == sorted(map(tuple, both))
