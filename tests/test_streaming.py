"""Streams cut into files give what the batch operators give on the whole table."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import anomaly, silence
from faultline.plans.correlate import Settings, correlate, detect
from faultline.streaming.live import LiveTables, process_batch, with_lateness, write_stream
from faultline.streaming.stateful import stream_anomalies, stream_silence
from tests.test_detectors_against_fold import SECOND, random_events

SCHEMA = "ts timestamp, seq bigint, source string, service string, severity int, trace_id string, message string, fields map<string,string>"


@pytest.fixture(scope="module")
def events():
    return random_events(21, n=450, gap=SECOND)


def table(spark, events):
    rows = [
        (e["t"], e["s"], "a", e["service"], 5 if e["err"] else 3, e["trace"], "m") for e in events
    ]
    return spark.createDataFrame(
        rows,
        "t bigint, seq bigint, source string, service string, severity int, trace_id string, message string",
    ).select(
        F.timestamp_micros("t").alias("ts"),
        "seq",
        "source",
        "service",
        "severity",
        "trace_id",
        "message",
        F.create_map().cast("map<string,string>").alias("fields"),
    )


def stream_of(spark, events, files, path):
    size = -(-len(events) // files)
    for i in range(files):
        part = table(spark, events[i * size : (i + 1) * size]).coalesce(1)
        part.write.mode("append").parquet(f"{path}/in")
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    )


def run_to_memory(spark, stream, name, path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    query = (
        stream.writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", f"{path}/ckpt")
        .outputMode("append")
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


@pytest.mark.parametrize("files", [1, 3])
def test_live_equals_batch(spark, events, tmp_path, files):
    settings = Settings(
        window_ms=4000,
        anomaly_multiplier=1.2,
        baseline_us=60 * SECOND,
        silence_threshold_pct=50.0,
    )
    size = -(-len(events) // files)
    tables = LiveTables(str(tmp_path))
    for i in range(files):
        process_batch(table(spark, events[i * size : (i + 1) * size]), i, tables, settings)
    # The last batch once more, as after a failure.
    process_batch(table(spark, events[(files - 1) * size :]), files - 1, tables, settings)
    columns = ["ts", "seq", "is_signal", "signal_type", "cascade_from", "new_cascade", "silence"]
    got = spark.read.parquet(tables.results).select(*columns).collect()
    want = correlate(table(spark, events), settings).select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(r.silence for r in want) and any(r.new_cascade for r in want)
    told = spark.read.parquet(tables.silence).count()
    assert told == detect(table(spark, events), settings).silence.count()


def test_write_stream_runs_every_batch(spark, events, tmp_path):
    stream = stream_of(spark, events[:200], 2, tmp_path)
    settings = Settings(window_ms=4000, silence=False)
    query = write_stream(
        stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", settings, availableNow=True
    )
    query.awaitTermination(300)
    assert query.exception() is None
    results = spark.read.parquet(LiveTables(f"{tmp_path}/out").results)
    assert results.count() == 200
    assert results.select("batch").distinct().count() == 2


@pytest.mark.parametrize("files", [1, 3])
def test_stateful_anomalies_equal_batch(spark, events, tmp_path, files):
    stream = with_lateness(stream_of(spark, events, files, tmp_path), 1000)
    got = run_to_memory(
        spark, stream_anomalies(stream, 240 * SECOND, 1.0), f"anomalies_{files}", tmp_path
    )
    want = anomaly.find_anomalies(table(spark, events), 240 * SECOND, 1.0).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
    assert want


@pytest.mark.parametrize("files", [1, 3])
def test_stateful_silence_equals_batch_at_every_instant(spark, events, tmp_path, files):
    start = events[0]["t"]
    end = events[-1]["t"]
    # A last event far ahead lets the watermark pass all timers before it.
    ahead = {"t": end + 600 * SECOND, "s": 10_000, "service": "late", "err": False, "trace": None}
    stream = with_lateness(stream_of(spark, events + [ahead], files, tmp_path), 1000)
    got = run_to_memory(
        spark,
        stream_silence(stream, 60 * SECOND, 50.0, log_start_us=start),
        f"silence_{files}",
        tmp_path,
    )
    want = silence.detect_silence(
        table(spark, events + [ahead]), 60 * SECOND, 50.0, check="tick", tick_us=1
    ).collect()
    assert {(r.service, r.t, r.older, r.recent) for r in got} == {
        (r.service, r.t, r.older, r.recent) for r in want
    }
    assert len(got) == len(want) > 3


def test_quiet_start_rerun_and_lines_without_number(spark, tmp_path):
    """A log without errors finds no pair; then errors come, that batch fails and runs again; events have no seq."""
    settings = Settings(window_ms=5000, silence=False)
    tables = LiveTables(str(tmp_path))

    def batch(*rows):
        rows = [{"t": t * SECOND, "s": 0, "service": s, "err": e, "trace": None} for t, s, e in rows]
        return table(spark, rows).drop("seq")

    process_batch(batch((1000, "a", False), (1001, "b", False)), 0, tables, settings)
    process_batch(batch((1002, "a", False)), 1, tables, settings)
    process_batch(batch((1003, "a", True), (1004, "b", True)), 2, tables, settings)
    process_batch(batch((1005, "a", False)), 2, tables, settings)
    process_batch(batch((1006, "a", True), (1007, "b", True)), 3, tables, settings)
    out = {(r.ts.timestamp(), r.service): r for r in spark.read.parquet(tables.results).collect()}
    assert sorted(out) == [(1000, "a"), (1001, "b"), (1002, "a"), (1005, "a"), (1006, "a"), (1007, "b")]
    last = out[(1007, "b")]
    assert (last.cascade_from, last.new_cascade) == ("a", True)
    pairs = spark.read.parquet(tables.pairs).collect()
    assert [(r.cascade_from, r.service, r.batch) for r in pairs] == [("a", "b", 3)]
