"""Random events with ties in time, rows without a service and mixed traces, against the fold."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import anomaly, cascade, silence
from tests import fold

SECOND = 1_000_000


def random_events(seed, n=700, services=5, gap=2 * SECOND, tie=0.1, hot=None):
    rng = random.Random(seed)
    t, out = 1_700_000_000 * SECOND, []
    for s in range(n):
        if rng.random() > tie:
            t += int(rng.expovariate(1 / gap)) + (rng.random() < 0.01) * 60 * SECOND
        service = rng.choice([f"s{i}" for i in range(services)] + [None])
        if hot and rng.random() < hot:
            service = "s0"
        out.append(
            {
                "t": t,
                "s": s,
                "service": service,
                "err": rng.random() < 0.4,
                "trace": rng.choice([None, None, f"t{rng.randrange(40)}"]),
            }
        )
    # Sequence numbers decide ties, so shuffle which rows get which and sort again.
    numbers = list(range(n))
    rng.shuffle(numbers)
    for e, s in zip(out, numbers):
        e["s"] = s
    return sorted(out, key=lambda e: (e["t"], e["s"]))


def frame(spark, events):
    rows = [
        (e["t"], e["s"], e["service"], 5 if e["err"] else 3, e["trace"], f"m{e['s']}")
        for e in events
    ]
    df = spark.createDataFrame(
        rows, "t bigint, seq bigint, service string, severity int, trace_id string, message string"
    )
    return df.repartition(4).withColumn("ts", F.timestamp_micros("t")).drop("t")


@pytest.mark.parametrize("seed,window_ms", [(1, 5000), (2, 2000), (3, 15000), (4, 0)])
def test_cascades(spark, seed, window_ms):
    events = random_events(seed, hot=0.4 if seed == 2 else None)
    got = {
        (r.t, r.seq): (r.cascade_from, r.new_cascade)
        for r in cascade.detect_cascades(frame(spark, events), window_ms)
        .where("cascade_from is not null")
        .withColumn("t", F.unix_micros("ts"))
        .collect()
    }
    want = fold.fold_cascades(events, window_ms * 1000)
    assert got == want
    assert window_ms == 0 or len(want) > 20


@pytest.mark.parametrize("seed,span,multiplier", [(5, 60, 1.2), (6, 120, 2.0), (7, 61, 1.0)])
def test_anomalies(spark, seed, span, multiplier):
    events = random_events(seed, hot=0.4)
    got = {
        (r.t, r.s)
        for r in anomaly.find_anomalies(frame(spark, events), span * SECOND, multiplier).collect()
    }
    want = fold.fold_anomalies(events, span * SECOND, multiplier)
    assert got == want
    assert want


@pytest.mark.parametrize("seed,span,threshold", [(8, 60, 50.0), (9, 120, 60.0), (10, 64, 90.0)])
def test_silence(spark, seed, span, threshold):
    events = random_events(seed, n=500, gap=SECOND)
    got = {
        (r.service, r.t, r.s): (r.older, r.recent)
        for r in silence.detect_silence(frame(spark, events), span * SECOND, threshold).collect()
    }
    want = fold.fold_silence(events, span * SECOND, threshold)
    assert got == want
    assert want


def test_silence_limits_to_the_microsecond(spark):
    """Whole-second events, so limits fall on events and on the edges of cells."""
    rng = random.Random(3)
    events, t = [], 1_700_000_000 * SECOND
    for s in range(400):
        t += rng.choice([0, 1, 1, 2, 3, 20 if s % 50 == 0 else 1]) * SECOND - rng.choice([0, 0, 1])
        events.append({"t": t, "s": s, "service": rng.choice("abc"), "err": False, "trace": None})
    events.sort(key=lambda e: (e["t"], e["s"]))
    got = {
        (r.service, r.t, r.s): (r.older, r.recent)
        for r in silence.detect_silence(frame(spark, events), 32 * SECOND, 60.0).collect()
    }
    assert got == fold.fold_silence(events, 32 * SECOND, 60.0)
    assert got
