"""Live runs: positions, numbers, late rows, the landed folders and JSON lines in order."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultline.plans.correlate import Settings, correlate
from faultline.sources.sinks import write_results
from faultline.streaming import landing
from faultline.streaming.landing import Landing, Manifest
from faultline.streaming.live import DAY_US, LiveTables, _numbered, _parts, process_batch
from tests.test_detectors_against_fold import SECOND, random_events
from tests.test_streaming import table

AT = 1_700_000_000 * SECOND
QUICK = Settings(window_ms=5000, baseline_us=60 * SECOND, silence=False)


def event(second, service, seq, err=True, trace=None):
    return {"t": AT + int(second * SECOND), "s": seq, "service": service, "err": err, "trace": trace}


def test_services_that_share_positions_keep_their_rows(spark, tmp_path):
    """Sources with numbers of their own: b and c erred at the same time under the same number."""
    rows = [event(0, "a", 0), event(1, "b", 0), event(1, "c", 0)]
    tables = LiveTables(str(tmp_path))
    process_batch(table(spark, rows[:1]), 0, tables, QUICK)
    process_batch(table(spark, rows[1:]), 1, tables, QUICK)
    process_batch(table(spark, [event(2, "d", 0), event(2, "a", 0)]), 2, tables, QUICK)
    columns = ["ts", "seq", "service", "signal_type", "cascade_from", "new_cascade"]
    got = spark.read.parquet(tables.results).select(*columns).collect()
    want = correlate(table(spark, [*rows, event(2, "d", 0), event(2, "a", 0)]), QUICK).select(*columns).collect()
    assert len(got) == 5 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_numbers_grow_for_ever_without_gaps(spark):
    rows = table(spark, [event(i % 7, "a", 0) for i in range(50)]).drop("seq").repartition(5)
    base = 65_536 * 10**9  # far above any number of batches that a run may have
    numbered, after = _numbered(rows, "seq", base)
    got = [r.seq for r in numbered.orderBy("ts", "seq").collect()]
    assert got == list(range(base, base + 50)) and after == base + 50
    empty, after = _numbered(rows.where("false"), "seq", 5)
    assert empty.count() == 0 and after == 5


def test_late_rows_are_counted_and_read_for_themselves(spark, tmp_path):
    """A row a month old, one a little late, and one in time, in one batch."""
    tables = LiveTables(str(tmp_path))
    month = 30 * 86_400
    old = [event(0, "a", 0), event(3, "x", 1, err=False)]
    now = [event(month + i, "ab"[i % 2], 10 + i, err=False) for i in range(100)]
    keep = {"retain_us": 40 * DAY_US}
    first = process_batch(table(spark, old), 0, tables, QUICK, **keep)
    second = process_batch(table(spark, now), 1, tables, QUICK, **keep)
    mixed = [event(2, "b", 2), event(month + 98, "b", 200), event(month + 99.2, "a", 201), event(month + 101, "c", 202)]
    third = process_batch(table(spark, mixed), 2, tables, QUICK, flush_ms=500, **keep)
    assert [(a.rows, a.late) for a in (first, second, third)] == [(2, 0), (100, 0), (4, 2)]
    ranges = [(a - AT, z - AT) for a, z, _ in third.reads]
    assert ranges == [((month + 98 - 120) * SECOND, (month + 101) * SECOND), ((2 - 120) * SECOND, 2 * SECOND)]
    rows = {r.seq: r for r in spark.read.parquet(tables.results).where("batch = 2").collect()}
    assert (rows[2].cascade_from, rows[2].new_cascade) == ("a", True)  # judged against what was landed a month before
    assert rows[202].cascade_from == "b" and len(rows) == 4
    again = process_batch(table(spark, mixed), 2, tables, QUICK, flush_ms=500, **keep)
    assert (again.rows, again.late) == (4, 2) and spark.read.parquet(tables.results).count() == 106


def test_parts_of_a_batch():
    assert _parts([7]) == [[7]]
    assert _parts([1, 2, 5, 6, 7]) == [[5, 6, 7], [1, 2]]
    assert _parts([1, 3]) == [[3], [1]]


def test_landed_folders_stay_few_and_lose_nothing(spark, tmp_path, monkeypatch):
    """Many batches, some late, some run twice or left half way: folders stay few, rows are there once, old slots go."""
    monkeypatch.setattr(landing, "FAN", 3)
    rng, width, kept = random.Random(1), 10 * SECOND, {}
    schema = "ts timestamp, seq bigint, batch int"
    most_files = 0
    for number in range(28):
        for attempt in range(2 if number % 5 == 2 else rng.choice([1, 1, 2])):
            land = Landing(spark, str(tmp_path), width)
            before = land.before(number)
            seconds = [number * 2, number * 2 + 1] + ([rng.randrange(max(1, number * 2))] if number % 4 == 3 else [])
            rows = [(AT + s * SECOND, number * 10 + i + 1000 * attempt) for i, s in enumerate(seconds)]
            own = land.land(spark.createDataFrame(rows, "t bigint, seq bigint").select(F.timestamp_micros("t").alias("ts"), "seq").coalesce(1), number)
            live, given_up = land.merge(before.folders + own, number, spark.createDataFrame([], schema).schema)
            live, old = land.retire(live, rows[1][0], 30 * SECOND)
            if attempt == 0 and number % 5 == 2:
                continue  # failed before it counted; what it wrote must not be seen
            land.commit(Manifest(number, width, high_us=rows[1][0], folders=live, dropped=given_up + old), before)
            kept[number] = rows
        state = land.before(number + 1)
        most_files = max(most_files, len(state.folders))
        got = sorted((r.t, r.seq) for r in land.rows(state.folders, spark.createDataFrame([], schema).schema).selectExpr("unix_micros(ts) AS t", "seq").collect())
        oldest = min((f.slot for f in state.folders))
        want = sorted(r for rows in kept.values() for r in rows if r[0] // width >= oldest)
        assert got == want
    assert most_files <= 5 * 2 * 3
    assert len([p for p in Path(tmp_path, "manifests").iterdir() if p.name.isdigit()]) <= 3
    named = {f.name for f in state.folders} | set(state.dropped)
    found = {str(p.relative_to(tmp_path)) for p in Path(tmp_path).glob("landed/*/slot=*") if any(p.glob("*.parquet"))}
    assert len(found - named) <= 3  # what a first try merged and the second didn't


def read_lines(path):
    out = []
    for part in sorted(Path(path).glob("part-*")):
        out += [json.loads(line) for line in part.read_text().splitlines()]
    return out


def test_written_results_are_in_order(spark, tmp_path):
    events = random_events(9, n=300, gap=SECOND)
    rng = random.Random(0)
    shuffled = rng.sample(events, len(events))
    df = table(spark, shuffled).withColumn("message", F.col("seq").cast("string")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_results(df, f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(tmp_path, "out").glob("part-*"))) > 1
    assert [int(r["message"]) for r in read_lines(tmp_path / "out")] == [e["s"] for e in sorted(events, key=lambda e: (e["t"], e["s"]))]


def test_json_of_a_live_run_is_written_once_a_batch_and_in_order(spark, tmp_path):
    tables = LiveTables(str(tmp_path))
    batches = [[event(3, "a", 1), event(1, "b", 0), event(4, "c", 2)], [event(6, "b", 4, err=False), event(5, "a", 3)]]
    for number in (0, 1, 1):
        process_batch(table(spark, batches[number]), number, tables, QUICK, json=True)
    lines = read_lines(f"{tables.json}/batch=0") + read_lines(f"{tables.json}/batch=1")
    assert [r["service"] for r in lines] == ["b", "a", "c", "a", "b"]
    assert [r.get("cascade_from") for r in lines] == [None, "b", "b", "b", None]


@pytest.mark.parametrize("inside", [True, False])
def test_scratch_deletes_what_was_written_inside(spark, inside):
    from faultline.session import checkpoint_root, materialize, scratch, side_by_side

    def tables():
        return set(Path(checkpoint_root(spark).removeprefix("file:")).glob("table-*"))

    before = tables()
    if inside:
        with scratch(spark):
            side_by_side(spark, lambda: materialize(spark.range(3)), lambda: materialize(spark.range(4)))
            assert len(tables() - before) == 2
        assert tables() == before
    else:
        assert materialize(spark.range(3)).count() == 3 and len(tables() - before) == 1
