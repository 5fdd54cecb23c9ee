"""Several configured sources in one call, and the next check of a look."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultline.operators import cascade, silence
from faultline.plans.correlate import Settings
from faultline.plans.run import run
from faultline.sources.configured import SourceSpec, read_sources
from tests.test_ordered_streams import traced_events
from tests.test_streaming import table


def write(path, *lines):
    path.write_text("".join(f"{x}\n" for x in lines))
    return str(path)


def specs(tmp_path):
    app = write(
        tmp_path / "app.log",
        '{"timestamp":"2024-05-01T10:00:00Z","level":"error","service":"cart","message":"no stock"}',
        "2024-05-01T10:00:02Z INFO idle",
        '{"timestamp":"2024-05-01T09:00:00Z","level":"info","service":"cart","message":"too early"}',
    )
    dd = write(
        tmp_path / "dd.json",
        '{"data":[{"attributes":{"timestamp":"2024-05-01T10:00:03Z","status":"error","message":"timeout","service":"mail"}},7]}',
        "",
        "<html>",
    )
    cw = write(tmp_path / "cw.json", json.dumps({"log_group": "/x/web", "timestamp": 1714557604000, "message": "ok", "logStreamName": "s"}))
    return [
        SourceSpec("app", app),
        SourceSpec("dd", dd, "datadog", offset_ms=-1500),
        SourceSpec("cw", cw, "cloudwatch", labels={"log_stream": "s"}),
        SourceSpec("other", cw, "cloudwatch", labels={"log_stream": "none"}),
        SourceSpec("gone", f"{tmp_path}/none.log"),
    ]


def test_sources_in_one_call(spark, tmp_path):
    since = "2024-05-01 09:30:00"
    got = read_sources(spark, specs(tmp_path), since=F.lit(since).cast("timestamp"), ingest_ts=F.lit("2024-05-01 10:00:09").cast("timestamp"))
    rows = got.orderBy("ts", "seq").selectExpr("date_format(ts, 'mm:ss.SSS') AS at", "source", "service", "severity", "message").collect()
    assert [tuple(r)[:4] for r in rows[:4]] == [
        ("00:00.000", "app", "cart", 5),
        ("00:01.500", "dd", "mail", 5),
        ("00:02.000", "app", None, 3),
        ("00:04.000", "cw", "web", 0),
    ]
    failed = {(r.source, r.severity, r.message) for r in rows[4:]}
    assert {(s, m) for s, _, m in failed if s == "dd"} == {("dd", "adapter error: 7"), ("dd", "adapter error: <html>")}
    assert [m.startswith("adapter error: ") for s, _, m in failed if s == "gone"] == [True] and len(rows) == 7
    with pytest.raises(ValueError):
        read_sources(spark, [SourceSpec("a", "x"), SourceSpec("a", "y")])


def test_run_writes_ordered_results_and_tells_how_it_went(spark, tmp_path):
    settings = Settings(window_ms=5000, silence=False)
    since = F.lit("2024-05-01 09:30:00").cast("timestamp")
    summary = run(spark, specs(tmp_path)[:3], f"{tmp_path}/out", settings, since=since)
    lines = [json.loads(x) for p in sorted(Path(tmp_path, "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(r.get("service"), r.get("cascade_from")) for r in lines[:2]] == [("cart", None), ("mail", "cart")]
    assert (summary.events, summary.signals, summary.sources) == (len(lines), sum(r["is_signal"] for r in lines), 3)
    assert summary.elapsed_ms > 0
    run(spark, specs(tmp_path)[:3], f"{tmp_path}/few", settings, since=since, services=["mail"], signals_only=True)
    few = [json.loads(x) for p in sorted(Path(tmp_path, "few").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(r["service"], r["cascade_from"]) for r in few] == [("mail", "cart")]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_next_check_is_the_first_at_or_after(spark, width):
    checks = [(t, s) for s, t in enumerate([-50, 3, 3, 4, 10, 11, 500, 501, 9000])]
    looks = [-60, -50, -49, 0, 3, 4, 5, 11, 12, 499, 502, 8999, 9000, 9001]
    got = silence.next_check(
        spark.createDataFrame([(x,) for x in looks * 2], "look_from bigint"), spark.createDataFrame(checks, "t bigint, s bigint"), width
    ).collect()
    want = {x: min(((t, s) for t, s in checks if t >= x), default=None) for x in looks}
    assert {r.look_from: (r.found["at"], r.found["s"]) for r in got} == {x: y for x, y in want.items() if y}
    assert len(got) == len(looks) - 1


def test_next_check_orders_only_slice_totals_in_one_task(spark):
    looks, checks = spark.range(10).select(F.col("id").alias("look_from")), spark.range(100).select(F.col("id").alias("t"), F.col("id").alias("s"))
    plan = silence.next_check(looks, checks, 5)._jdf.queryExecution().executedPlan().toString()
    for below in plan.split("SinglePartition")[1:]:
        assert "key=[_slice" in below[:300]


def test_origins_of_one_kind(spark):
    events = table(spark, traced_events(3))
    both = sorted(map(tuple, cascade.cascade_origins(events, 4000).collect()))
    parts = [sorted(map(tuple, cascade.cascade_origins(events, 4000, by=k).collect())) for k in ("trace", "overlap")]
    assert sorted(parts[0] + parts[1]) == both and all(parts)
    with pytest.raises(ValueError):
        cascade.cascade_origins(events, by="none")
