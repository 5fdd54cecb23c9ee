"""What the plans must and must not hold."""

import re

import pytest

from faultline.operators import anomaly, cascade, silence
from faultline.plans import queries as q
from faultline.plans.tables import log_events

SF = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["cascades", "anomaly", "silence", "correlate", "volume_rates", "error_bursts", "cascade_chains"]
)
def test_no_all_pairs_join(spark, name):
    text = plan(q.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cells_are_folded_before_the_shuffle_by_hash_aggregation(spark):
    narrow = cascade._narrow(log_events(spark, SF), "seq")
    text = plan(cascade.error_cells(narrow, 5_000_000))
    scan = text[text.rindex("Exchange hashpartitioning") :]
    assert "HashAggregate" in scan and "SortAggregate" not in text
    assert "Window" not in scan


def test_columns_that_detection_does_not_use_are_not_read(spark):
    text = plan(cascade.error_table(log_events(spark, SF)).limit(1))
    assert "message" not in text
    df = cascade.error_cells(cascade._narrow(log_events(spark, SF), "seq"), 5_000_000)
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)))
    assert "value" not in schema


def test_time_range_reaches_the_scan(spark, tmp_path):
    from faultline.operators import align
    from faultline.sources.sinks import replay_session, save_session

    save_session(log_events(spark, SF), f"{tmp_path}/s")
    saved = replay_session(spark, f"{tmp_path}/s")
    shifted = align.clock_offset(saved.drop("raw_ts"), q.OFFSETS_MS)
    ranged = align.time_range(shifted, q.SINCE, q.UNTIL, raw_column="raw_ts", offsets=q.OFFSETS_MS)
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan(ranged)).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed
    days = plan(replay_session(spark, f"{tmp_path}/s", since=q.SINCE))
    assert re.search(r"PartitionFilters: \[[^\]]*day", days)


def test_errors_alone_are_shuffled_for_annotation(spark):
    ev = log_events(spark, SF)
    found = anomaly.find_anomalies(ev, q.ANOMALY_US, 1.0).select("service", "t", "s")
    text = plan(cascade.attach(ev, found))
    other = text[text.index("Union") :]
    assert other.count("Exchange") <= text.count("Exchange")
    assert "Union" in text


def test_hot_service_is_cut_into_slices(spark):
    """One service with nearly all rows still spreads over the slices of a running value."""
    from pyspark.sql import functions as F

    from faultline.operators.scan import Run, running

    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("o")
    )
    out = running(df, ["k"], ["o"], {"place": Run("sum", F.lit(1))}, slices=8)
    top = out.groupBy("k").agg(F.max("place").alias("top")).collect()
    assert {r.k: r.top for r in top} == {"hot": n - n // 50, "cold": n // 50}
    assert "_slice" in plan(out)
    files = re.search(r"file:([^\s,\]]+)", plan(out)).group(1)
    sizes = spark.read.parquet(files).groupBy("_slice").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < n / 4


def test_silence_by_ticks_reads_no_other_services(spark):
    text = plan(silence.detect_silence(log_events(spark, SF), q.SILENCE_US, 50.0, check="tick"))
    assert "CartesianProduct" not in text
