"""Small incidents with known outcomes."""

import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from faultline.operators import align, anomaly, cascade, report, silence
from faultline.operators.rates import half_window_rates
from faultline.plans.correlate import Settings, annotate, correlate, detect, signal_history

T0 = datetime(2024, 1, 15, 14, 22, tzinfo=timezone.utc)
MINUTE = 60_000_000


def events(spark, rows):
    """rows: (ms after T0, service, severity, trace)"""
    data = [
        (T0 + timedelta(milliseconds=ms), i, "app", service, severity, trace, f"m{i}", {})
        for i, (ms, service, severity, trace) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "ts timestamp, seq bigint, source string, service string, severity int, trace_id string, "
        "message string, fields map<string,string>",
    )


def origins(spark, rows, window_ms=500):
    df = cascade.detect_cascades(events(spark, rows), window_ms).orderBy("seq")
    return [(r.cascade_from, r.new_cascade) for r in df.collect()]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(0, "payment", 5, "abc"), (200, "order", 5, "abc")], [(None, False), ("payment", True)]),
        (
            [(0, "payment", 5, "x"), (100, "order", 5, "x"), (300, "notify", 6, "x")],
            [(None, False), ("payment", True), ("payment", True)],
        ),
        (
            [(0, "payment", 5, "x"), (100, "order", 5, "x"), (200, "order", 5, "x")],
            [(None, False), ("payment", True), ("payment", False)],
        ),
        ([(0, "payment", 5, "x"), (2000, "order", 5, "x")], [(None, False)] * 2),
        ([(0, "payment", 5, None), (200, "order", 5, "")], [(None, False), ("payment", True)]),
        ([(0, "payment", 5, None), (100, "payment", 5, None)], [(None, False)] * 2),
        # A quiet spell ends the burst, whatever the severity of the event that shows it.
        (
            [(0, "payment", 5, None), (1000, "payment", 3, None), (2000, "order", 5, None)],
            [(None, False)] * 3,
        ),
        # The window holds both its ends.
        ([(0, "payment", 5, None), (500, "order", 5, None)], [(None, False), ("payment", True)]),
        # The earliest service on a trace decides; there is no second choice.
        (
            [(0, "a", 5, "x"), (900, "b", 5, "x"), (1000, "c", 5, "x")],
            [(None, False)] * 3,
        ),
        # Events without a service take no part.
        ([(0, None, 5, None), (0, "", 5, None), (100, "order", 5, None)], [(None, False)] * 3),
    ],
)
def test_cascades(spark, rows, want):
    assert origins(spark, rows) == want


P, O, N = "payment", "order", "notify"
INCIDENT = [
    (1100, P, 3, "a"), (1200, O, 3, "a"), (2300, P, 2, None), (3000, P, 4, None),
    (3441, P, 5, None), (3512, P, 5, "a"), (3891, O, 5, "a"), (4102, O, 4, "a"),
    (4608, O, 5, "a"), (5112, O, 5, "a"), (5201, N, 5, None), (5310, N, 4, None),
]


@pytest.mark.parametrize(
    "window_ms,want,chains",
    [
        (5000, {7: (P, True), 9: (P, False), 10: (P, False), 11: (P, True)}, [[P, O], [P, N]]),
        (500, {7: (P, True), 11: (O, True)}, [[P, O], [P, O, N]]),
    ],
)
def test_incident(spark, window_ms, want, chains):
    ev = events(spark, INCIDENT)
    settings = Settings(window_ms=window_ms)
    found = detect(ev, settings)
    out = annotate(ev, found).orderBy("seq").collect()
    got = {i + 1: (r.cascade_from, r.new_cascade) for i, r in enumerate(out) if r.is_signal}
    assert got == want
    assert {r.signal_type for r in out} == {None, "cascade"}
    edges = report.cascade_edges(annotate(ev, found))
    told = report.cascade_chains(edges).orderBy("first_seq").collect()
    assert [r.chain for r in told] == chains
    summary = report.run_summary(annotate(ev, found), found.silence).first()
    assert (summary.signals, summary.noise) == (len(want), 12 - len(want))
    assert (summary.silence_signals, summary.sources) == (0, 1)
    kinds = signal_history(annotate(ev, found), found.silence).collect()
    assert len(kinds) == len(want)
    kept = align.services_filter(align.signal_only(annotate(ev, found)), [N]).collect()
    assert [r.service for r in kept] == [N]


def test_anomaly(spark):
    slow = [(i * 10_000, "api", 5, None) for i in range(6)]
    fast = [(150_000 + i * 1000, "api", 5, None) for i in range(80)]
    df = anomaly.detect_anomalies(events(spark, slow + fast), 5 * MINUTE, 10.0)
    flags = [r.is_anomaly for r in df.orderBy("seq").collect()]
    assert flags[-1] and not any(flags[:54])
    (last,) = anomaly.find_anomalies(events(spark, slow + fast), 5 * MINUTE, 10.0).where("s = 85").collect()
    assert (last.older, last.recent) == (6, 80)
    thin = anomaly.find_anomalies(events(spark, slow[:3]), 5 * MINUTE, 10.0)
    assert thin.count() == 0


def silent(spark, rows, **options):
    df = silence.detect_silence(events(spark, rows), 4 * MINUTE, 90.0, **options)
    return [(r.service, r.s, r.drop_pct) for r in df.orderBy("t").collect()]


def beat(service, n, step_s):
    return [(i * step_s * 1000, service, 3, None) for i in range(n)]


@pytest.mark.parametrize(
    "rows,want",
    [
        (beat("a", 20, 10) + [(120_000 + 80_000, "w", 3, None)], []),  # first span of the log
        (beat("a", 24, 5) + [(300_000, "w", 3, None)], [("a", 24)]),
        (beat("a", 48, 5) + [(300_000, "w", 3, None)], []),  # still active
        (beat("a", 24, 5) + [(300_000, "w", 3, None), (310_000, "w", 3, None)], [("a", 24)]),
        (beat("a", 3, 5) + [(300_000, "w", 3, None)], []),  # thin baseline
    ],
)
def test_silence(spark, rows, want):
    assert [(s, q) for s, q, _ in silent(spark, rows)] == want


def test_silence_of_one_of_two_services(spark):
    rows = sorted(beat("a", 24, 5) + beat("b", 62, 5), key=lambda r: r[0])
    got = silent(spark, rows)
    assert [s for s, _, _ in got] == ["a"]
    assert got[0][2] >= 90
    ticks = silent(spark, rows, check="tick", tick_us=1_000_000)
    assert [s for s, _, _ in ticks] == ["a"]


def test_silence_rides_on_the_event_that_shows_it(spark):
    rows = beat("a", 24, 5) + [(300_000, "w", 3, None)]
    settings = Settings(baseline_us=4 * MINUTE)
    out = correlate(events(spark, rows), settings).where("silence is not null").collect()
    assert [(r.service, r.is_signal, [s.service for s in r.silence]) for r in out] == [
        ("w", False, ["a"])
    ]


def test_priority_of_cascade_over_anomaly(spark):
    base = [(i * 10_000, "api", 5, None) for i in range(6)]
    rows = base + [(149_900, "db", 5, None)] + [(150_000 + i * 1000, "api", 5, None) for i in range(80)]
    out = correlate(events(spark, rows), Settings(silence=False)).orderBy("seq").collect()
    assert out[-1].signal_type == "cascade" and out[-1].cascade_from == "db"


def test_merge(spark):
    a = events(spark, [(0, "a", 3, None), (200, "a", 3, None), (400, "a", 3, None)])
    b = events(spark, [(100, "b", 3, None), (300, "b", 3, None), (500, "b", 3, None)])
    merged = align.union_sources(a, b.drop("message"))
    assert [r.service for r in align.time_ordered(merged).collect()] == list("ababab")
    placed = align.with_place(merged).orderBy("place").collect()
    assert [(r.place, r.service) for r in placed] == list(zip(range(1, 7), "ababab"))
    assert align.union_sources(a.limit(0), b.where("seq = 0")).count() == 1
    with pytest.raises(ValueError):
        align.union_sources()


def test_nothing_in_nothing_out(spark):
    none = events(spark, INCIDENT).where("seq < 0")
    assert correlate(none).count() == 0
    assert silence.detect_silence(none).count() == 0


def test_filters(spark):
    ev = events(spark, INCIDENT).withColumn("fields", F.create_map(F.lit("env"), F.lit("prod")))
    assert align.label_filter(ev, {"env": "prod"}).count() == 12
    assert align.label_filter(ev, {"env": "test"}).count() == 0
    assert align.label_filter(ev, expr="severity >= 5").count() == 6
    since, until = T0 + timedelta(milliseconds=3441), T0 + timedelta(milliseconds=3891)
    assert align.time_range(ev, since, until).count() == 3


def test_drift_warning_only_past_the_window(spark):
    rows = [(0, "payment", 5, None), (600, "order", 5, None), (650, "notify", 5, None)]
    got = cascade.drift_origins(events(spark, rows), 500, 200).collect()
    assert [(r.service, r.cascade_from) for r in got] == [("order", "payment")]


def test_sources_that_number_their_own_rows(spark):
    """Two sources use the same (ts, seq) for different services: no row is doubled, signals stay with their service."""
    a = events(spark, [(0, "payment", 5, None), (300, "cart", 3, None)])
    b = events(spark, [(0, "ledger", 3, None), (300, "order", 5, None)]).withColumn("source", F.lit("other"))
    out = cascade.detect_cascades(align.union_sources(a, b), 500)
    got = {r.service: (r.cascade_from, r.new_cascade) for r in out.collect()}
    assert out.count() == 4
    assert got == {"payment": (None, False), "cart": (None, False), "ledger": (None, False), "order": ("payment", True)}


def test_odd_spans_are_refused(spark):
    rows = spark.createDataFrame([("a", 0, 0)], "k string, t bigint, s bigint")
    with pytest.raises(ValueError, match="even"):
        half_window_rates(rows, 61)


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_suggested_offset_is_the_exact_median(spark, n):
    deltas = [3, 3, 900, -40, 7, 7, 7, 12][:n]
    rows = [(T0 + timedelta(milliseconds=5000 + d), "ref", f"t{i}") for i, d in enumerate(deltas)]
    rows += [(T0 + timedelta(milliseconds=5000), "late", f"t{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp, source string, trace_id string")
    (r,) = align.suggest_offsets(df, "ref").collect()
    assert (r.source, r.offset_ms, r.traces) == ("late", statistics.median(deltas), n)
