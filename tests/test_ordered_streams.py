"""The reorder buffer and the keyed cascades: streams out of order give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import anomaly, silence
from faultline.operators.cascade import cascade_origins, mark_new
from faultline.streaming.live import with_lateness
from faultline.streaming.reorder import reorder, write_ordered
from faultline.streaming.stateful import stream_anomalies, stream_cascades, stream_silence
from tests.test_detectors_against_fold import SECOND, random_events
from tests.test_streaming import SCHEMA, run_to_memory, stream_of, table


def shuffled(events, reach, seed=0):
    """The events in another order, none more than `reach` microseconds behind one that comes before it."""
    rng = random.Random(seed)
    return sorted(events, key=lambda e: e["t"] + rng.randrange(reach))


def far(events, seconds=7200):
    """An event far ahead, which lets the watermark pass all others."""
    return {"t": max(e["t"] for e in events) + seconds * SECOND, "s": 10**6, "service": "late", "err": False, "trace": None}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def traced_events(seed):
    """Errors of five services on few traces, many at the same time."""
    rng = random.Random(seed)
    events, t = [], 1_700_000_000 * SECOND
    for i in range(400):
        t += rng.choice([0, 0, SECOND, 8 * SECOND])
        events.append(
            {"t": t, "s": i, "service": rng.choice("abcde"), "err": rng.random() < 0.9, "trace": rng.choice([None, "", f"x{t // (8 * SECOND)}", "long"])}
        )
    return events


@pytest.mark.parametrize("files, reach", [(1, 1), (3, 15 * SECOND)])
def test_keyed_cascades_equal_batch(spark, tmp_path, files, reach):
    events = traced_events(3)
    arrivals = [*shuffled(events, reach), far(events)]
    stream = with_lateness(stream_of(spark, arrivals, files, tmp_path), 20_000)
    got = run_to_memory(spark, stream_cascades(stream, 4000, keep_ms=10**8), f"cascades_{files}", tmp_path)
    origins = cascade_origins(table(spark, events), 4000).where("by_trace").drop("by_trace")
    want = mark_new(origins).collect()
    assert sorted(tuple(r) for r in got) == sorted((r.service, r.t, r.s, r.cascade_from, r.new_cascade) for r in want)
    assert len(want) > 15 and sum(r.new_cascade for r in want) > 3


def test_keyed_cascades_forget(spark, tmp_path):
    """Bursts and traces leave no state behind; only pairs stay. A trace that is forgotten begins anew."""
    at = 1_700_000_000 * SECOND
    first = [{"t": at + i * SECOND, "s": i, "service": "ab"[i % 2], "err": True, "trace": "x"} for i in range(4)]
    again = [{**e, "t": e["t"] + 3600 * SECOND, "s": e["s"] + 10, "service": "cd"[i % 2]} for i, e in enumerate(first)]
    events = [*first, *again, far(again), far(again, 9000), far(again, 9600)]
    stream = with_lateness(stream_of(spark, events, len(events), tmp_path), 1000)
    query = (
        stream_cascades(stream, 4000, keep_ms=60_000)
        .writeStream.format("memory").queryName("forget").option("checkpointLocation", f"{tmp_path}/ckpt").start()
    )
    try:
        query.processAllAvailable()
        left = [op["numRowsTotal"] for op in query.lastProgress["stateOperators"]]
    finally:
        query.stop()
    found = {(r.cascade_from, r.service) for r in spark.table("forget").collect()}
    assert found == {("a", "b"), ("c", "d")}
    assert sorted(left)[:2] == [0, 0], left


def test_reorder_lets_go_in_order_and_keeps_nothing(spark, tmp_path):
    events = random_events(5, n=400, gap=SECOND)
    arrivals = [*shuffled(events, 30 * SECOND, 2), far(events), far(events, 9000)]
    stream = with_lateness(stream_of(spark, arrivals, 8, tmp_path), 40_000).withColumn(
        "fields", F.create_map(F.lit("k"), F.lit(None).cast("string"), F.lit("é"), F.col("service"))
    ).withColumn("source", F.when(F.col("seq") % 3 > 0, F.concat(F.lit("s"), F.col("seq") % 3)))
    seen = []

    def write(batch, number):
        seen.append([(r.ts, r.seq, r.service, r.source, tuple(sorted(r.fields.items()))) for r in batch.collect()])

    query = write_ordered(stream, write, f"{tmp_path}/ckpt", slice_ms=5000, availableNow=True)
    query.awaitTermination(300)
    assert query.exception() is None
    rows = [r for batch in seen for r in batch]
    assert [r[:2] for r in rows] == sorted(r[:2] for r in rows)
    assert len([b for b in seen if b]) > 2
    assert sorted(r[1] for r in rows)[:400] == sorted(e["s"] for e in events)
    one = next(r for r in rows if r[1] == 7)
    assert one[3] == "s1" and dict(one[4]) == {"k": None, "é": one[2]}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # the events far ahead


def test_reorder_drops_and_counts_what_is_too_late(spark, tmp_path):
    at = 1_700_000_000 * SECOND
    events = [{"t": at + i * SECOND, "s": s, "service": "a", "err": False, "trace": None} for s, i in enumerate((0, 100, 101, 3, 102, 200, 300))]
    stream = with_lateness(stream_of(spark, events, len(events), tmp_path), 10_000)
    query = reorder(stream).writeStream.format("memory").queryName("too_late").option("checkpointLocation", f"{tmp_path}/ckpt").start()
    try:
        query.processAllAvailable()
        dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    finally:
        query.stop()
    assert dropped == 1
    assert sorted(r.seq for r in spark.table("too_late").collect()) == [0, 1, 2, 4, 5]
    assert spark.table("too_late").schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()


@pytest.mark.parametrize("files, reach", [(4, 15 * SECOND)])
def test_spread_anomalies_equal_batch(spark, tmp_path, files, reach):
    """One service has all the errors; they wait under many keys."""
    events = [{**e, "service": "hot"} for e in random_events(21, n=350, gap=SECOND)]
    arrivals = [*shuffled(events, reach), far(events)]
    stream = with_lateness(stream_of(spark, arrivals, files, tmp_path), 20_000)
    got = run_to_memory(spark, stream_anomalies(stream, 240 * SECOND, 1.0, spread_ms=5000), f"spread_anomalies_{files}", tmp_path)
    want = anomaly.find_anomalies(table(spark, events), 240 * SECOND, 1.0).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == len(want) > 0


def test_spread_silence_equals_batch_at_every_instant(spark, tmp_path):
    events = random_events(21, n=350, gap=SECOND)
    ahead = [*events, far(events, 600)]
    arrivals = [*shuffled(events, 15 * SECOND), far(events, 600)]
    stream = with_lateness(stream_of(spark, arrivals, 4, tmp_path), 20_000)
    got = run_to_memory(
        spark, stream_silence(stream, 60 * SECOND, 50.0, log_start_us=events[0]["t"], spread_ms=5000), "spread_silence", tmp_path
    )
    want = silence.detect_silence(table(spark, ahead), 60 * SECOND, 50.0, check="tick", tick_us=1).collect()
    named = lambda rows: sorted((r.service, r.t, r.older, r.recent) for r in rows)
    assert named(got) == named(want) and len(got) > 3


def test_a_hot_service_waits_under_many_keys(spark, tmp_path):
    """What a service's own key gets is one row for each slice, in order."""
    from faultline.schema import is_error
    from faultline.streaming.stateful import _keyed

    at = 1_700_000_000 * SECOND
    events = [{"t": at + i * 10_000, "s": i, "service": "hot", "err": True, "trace": None} for i in range(1000)]
    stream = with_lateness(stream_of(spark, [*shuffled(events, SECOND), far(events)], 1, tmp_path), 2000)
    rows = run_to_memory(spark, _keyed(stream, "seq", is_error(), 1000), "hot_slices", tmp_path)
    assert len(rows) == 10 and {len(r.times) for r in rows} == {100}
    assert sorted(n for r in rows for n in r.numbers) == list(range(1000))
    assert all(list(r.times) == sorted(r.times) for r in rows)
