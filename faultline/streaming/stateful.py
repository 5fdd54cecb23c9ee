"""Detectors with keyed state: anomalies, silence and traced cascades, as the stream goes by.

State holds the event times of one span, in cells, and nothing older: cells are deleted once no
later event can reach back to them. Cascades on a trace take two keyed stages, bursts by service and first
errors by trace. Cascades by overlap in time need the state of all services at once, which would
put the whole stream under one key; they run in `faultline.streaming.live` instead.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.operators import anomaly, silence
from faultline.operators.rates import half_of
from faultline.schema import is_error, present

# The processors run in Python workers, which need not have this package installed: they are sent
# by value and must not refer to other modules of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_CELLS = 32


class _SpanState:
    """Times of a key within the span, kept in a map of cells."""

    def __init__(self, handle: StatefulProcessorHandle, span: int):
        self.width = max(1, span // STATE_CELLS)
        self.span = span
        self.cells = handle.getMapState("cells", "cell bigint", "times array<bigint>")

    def last_use_ms(self, latest: int) -> int:
        """When the watermark is here, nothing can depend on the times of a key whose last event is `latest`."""
        return -(-(latest + 2 * self.span) // 1000)

    def clear(self) -> None:
        self.cells.clear()

    def load(self) -> np.ndarray:
        kept = [np.asarray(v[0], dtype=np.int64) for _, v in self.cells.iterator()]
        return np.sort(np.concatenate(kept)) if kept else np.empty(0, dtype=np.int64)

    def save(self, added: np.ndarray, latest: int) -> None:
        """Add times and drop the cells that lie wholly before the span of the latest event."""
        for cell in np.unique(added // self.width):
            inside = added[added // self.width == cell]
            old = self.cells.getValue((int(cell),))
            times = inside if old is None else np.r_[np.asarray(old[0], dtype=np.int64), inside]
            self.cells.updateValue((int(cell),), (times.tolist(),))
        oldest = (latest - 2 * self.span) // self.width
        for (cell,) in list(self.cells.keys()):
            if cell < oldest:
                self.cells.removeKey((cell,))


def _ordered(rows) -> pd.DataFrame:
    """The rows of a key in order; rows that hold lists of times (see HoldProcessor) are taken apart."""
    pdf = pd.concat(list(rows), ignore_index=True)
    if "times" in pdf.columns:
        t, s = (np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf[c]]) for c in ("times", "numbers"))
        pdf = pd.DataFrame({"t": t, "seq": s})
    return pdf.sort_values(["t", "seq"], ignore_index=True)


def _repeat(text: str, n: int) -> pd.Series:
    # As objects: other string types become chunked arrays, which the worker cannot pack.
    return pd.Series([text] * n, dtype=object)


class AnomalyProcessor(StatefulProcessor):
    def __init__(
        self, baseline_us: int, multiplier: float, min_span: int, min_base: int
    ):
        self.baseline_us, self.multiplier = baseline_us, multiplier
        self.min_span, self.min_base = min_span, min_base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = _SpanState(handle, self.baseline_us)

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows)
        t = pdf["t"].to_numpy(dtype=np.int64)
        kept = self.state.load()
        half, span = self.baseline_us // 2, self.baseline_us

        def up_to(x: np.ndarray, side: str) -> np.ndarray:
            return np.searchsorted(kept, x, side) + np.searchsorted(t, x, side)

        # Within the batch an event sees itself and those before it, also at the same time.
        seen = np.searchsorted(kept, t, "right") + np.arange(1, len(t) + 1)
        older = up_to(t - half, "left") - up_to(t - span, "right")
        recent = seen - up_to(t - half, "left")
        hit = (
            (older + recent >= self.min_span)
            & (older >= self.min_base)
            & (recent >= older * self.multiplier)
        )
        latest = int(max(t[-1], kept[-1])) if len(kept) else int(t[-1])
        self.state.save(t, latest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.state.last_use_ms(latest))
        out = pdf.loc[hit, ["t", "seq"]]
        yield pd.DataFrame(
            {
                "service": _repeat(key[0], int(hit.sum())),
                "t": out["t"].to_numpy(),
                "s": out["seq"].to_numpy(),
                "older": older[hit],
                "recent": recent[hit],
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield pd.DataFrame({c: _repeat("", 0) if c == "service" else np.empty(0, np.int64) for c in ("service", "t", "s", "older", "recent")})

    def close(self) -> None:
        pass


class SilenceProcessor(StatefulProcessor):
    def __init__(self, half_us: int, threshold_pct: float, active_from: int, min_base: int):
        self.half, self.threshold = half_us, threshold_pct
        self.active_from, self.min_base = active_from, min_base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = _SpanState(handle, 2 * self.half)
        self.told = handle.getValueState("told", "told boolean")

    def _quiet(self, times: np.ndarray, since: int, before: int | None):
        """First instant in [since, before) at which the drop holds: (at, older, recent)."""
        looks = times + self.half + 1
        looks = np.unique(np.r_[max(since, self.active_from), looks[looks > since]])
        looks = looks[looks >= self.active_from]
        if before is not None:
            looks = looks[looks < before]
        left = np.searchsorted(times, looks - 2 * self.half, "left")
        mid = np.searchsorted(times, looks - self.half, "left")
        older, recent = mid - left, len(times) - mid
        base = np.maximum(older, 1) / (self.half / 60e6)
        drop = (1 - (recent / (self.half / 60e6)) / base) * 100
        hit = np.flatnonzero((older >= self.min_base) & (drop >= self.threshold))
        if not len(hit):
            return None
        i = hit[0]
        return int(looks[i]), int(older[i]), int(recent[i]), float(drop[i])

    def _wait(self, times: np.ndarray, since: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.state.last_use_ms(int(times[-1])))
        ahead = self._quiet(times, since, None)
        if ahead is not None:
            # Timers are in milliseconds; the exact instant is worked out again when one fires.
            self.handle.registerTimer(-(-ahead[0] // 1000))

    def _frame(self, key, found) -> pd.DataFrame:
        columns = ("t", "older", "recent", "drop_pct")
        return pd.DataFrame(
            {
                "service": _repeat(key[0], len(found)),
                **{c: [f[i] for f in found] for i, c in enumerate(columns)},
            }
        )

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows)
        t = pdf["t"].to_numpy(dtype=np.int64)
        kept = self.state.load()
        times = np.sort(np.r_[kept, t])
        found = []
        # The gap before the first new event belongs to the state, unless it was told already.
        if len(kept) and not (self.told.exists() and self.told.get()[0]):
            quiet = self._quiet(kept, int(kept[-1]), int(t[0]))
            if quiet:
                found.append(quiet)
        # Inside a gap the recent count only falls; gaps it cannot fall far enough in are passed over.
        upto = np.searchsorted(kept, t[:-1], "right") + np.arange(1, len(t))
        low = np.searchsorted(times, t[:-1] - 2 * self.half, "left")
        least = np.maximum(upto - np.searchsorted(times, t[1:] - 1 - self.half, "left"), 0)
        most = upto - low - least
        drop = (1 - least / np.maximum(most, 1)) * 100
        possible = (most >= self.min_base) & (drop >= self.threshold - 1e-6)
        for i in np.flatnonzero(possible):
            quiet = self._quiet(times[low[i] : upto[i]], int(t[i]), int(t[i + 1]))
            if quiet:
                found.append(quiet)
        self.state.save(t, int(times[-1]))
        self.told.update((False,))
        self._wait(times, int(times[-1]))
        yield self._frame(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        times = self.state.load()
        found = []
        if len(times) and not (self.told.exists() and self.told.get()[0]):
            quiet = self._quiet(times, int(times[-1]), None)
            if quiet:
                found.append(quiet)
                self.told.update((True,))
        if not len(times) or expiredTimerInfo.getExpiryTimeInMs() >= self.state.last_use_ms(int(times[-1])):
            self.state.clear()
            self.told.clear()
        yield self._frame(key, found)

    def close(self) -> None:
        pass


class HoldProcessor(StatefulProcessor):
    """Key: service, slice of time. Events wait until the watermark passes them, then leave as one row of sorted lists.

    A service of any size is spread over as many keys as a batch has slices; the service's own key then gets two numbers an
    event, in a row for each slice.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t array<bigint>, s array<bigint>")

    def _wait(self, first: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-first // 1000) - 1)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        first = min([int(pdf["t"].min()), *(min(h[0]) for h in self.held.get())])
        self.held.appendValue((pdf["t"].tolist(), pdf["seq"].tolist()))
        self._wait(first)
        yield self._frame(key, [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.held.get())
        t, s = (np.concatenate([np.asarray(h[i], dtype=np.int64) for h in held]) for i in (0, 1))
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        n = int(np.searchsorted(t, upto, "right"))
        self.held.clear()
        if n < len(t):
            self.held.appendValue((t[n:].tolist(), s[n:].tolist()))
            self._wait(int(t[n]))
        yield self._frame(key, t[:n], s[:n])

    def _frame(self, key, t, s) -> pd.DataFrame:
        n = int(len(t) > 0)
        return pd.DataFrame(
            {
                "service": _repeat(key[0], n),
                "times": pd.Series([list(map(int, t))] * n, dtype=object),
                "numbers": pd.Series([list(map(int, s))] * n, dtype=object),
                "ts": pd.to_datetime(np.asarray(t, dtype=np.int64)[-1:], unit="us", utc=True),
            }
        )

    def close(self) -> None:
        pass


class OnsetProcessor(StatefulProcessor):
    """Key: service. Errors wait until the watermark passes them, then get the onset of their burst, in order."""

    def __init__(self, window_us: int):
        self.window = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t array<bigint>, s array<bigint>, trace array<string>")
        self.burst = handle.getValueState("burst", "last bigint, onset bigint")

    def _wait(self, first: int | None) -> None:
        """Wake up when the watermark reaches `first`; a timer fires once the watermark is greater than it."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000) - 1)
        elif self.burst.exists():  # no later error can belong to the burst when the window is over
            self.handle.registerTimer((self.burst.get()[0] + self.window) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues):
        pdf = _ordered(rows)
        due = [list(h[0]) for h in self.held.get()]
        self.held.appendValue((pdf["t"].tolist(), pdf["seq"].tolist(), pdf["trace"].tolist()))
        self._wait(min([int(pdf["t"].iloc[0]), *(min(t) for t in due if t)]))
        yield self._frame(key, [], [], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.held.get())
        if not held:
            if self.burst.exists() and self.burst.get()[0] + self.window < upto:
                self.burst.clear()
            yield self._frame(key, [], [], [], [])
            return
        t, s = (np.concatenate([np.asarray(h[i], dtype=np.int64) for h in held]) for i in (0, 1))
        trace = np.array([x for h in held for x in h[2]], dtype=object)
        order = np.lexsort((s, t))
        t, s, trace = t[order], s[order], trace[order]
        n = int(np.searchsorted(t, upto, "right"))
        self.held.clear()
        if n < len(t):
            self.held.appendValue((t[n:].tolist(), s[n:].tolist(), trace[n:].tolist()))
        free, onset = t[:n], np.empty(0, dtype=np.int64)
        if n:
            last, began = self.burst.get() if self.burst.exists() else (None, None)
            new = np.r_[last is None or free[0] - last > self.window, np.diff(free) > self.window]
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            onset = np.where(at < 0, 0 if began is None else began, free[at])
            self.burst.update((int(free[-1]), int(onset[-1])))
        self._wait(int(t[n]) if n < len(t) else None)
        traced = np.array([x is not None for x in trace[:n]], dtype=bool)
        yield self._frame(key, free[traced], s[:n][traced], onset[traced], trace[:n][traced].tolist())

    def _frame(self, key, t, s, onset, trace) -> pd.DataFrame:
        t = np.asarray(t, dtype=np.int64)
        return pd.DataFrame(
            {
                "service": _repeat(key[0], len(t)),
                "trace": pd.Series(trace, dtype=object),
                "t": t,
                "s": np.asarray(s, dtype=np.int64),
                "onset": np.asarray(onset, dtype=np.int64),
                "ts": pd.Series(pd.to_datetime(t, unit="us", utc=True)),
            }
        )

    def close(self) -> None:
        pass


class TraceProcessor(StatefulProcessor):
    """Key: trace. State: the first error of the two services that erred first; errors come in order from batch to batch."""

    def __init__(self, window_us: int, keep_us: int):
        self.window, self.keep = window_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "service string", "t bigint, s bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["t", "s"], ignore_index=True)
        heads = {k[0]: (int(v[0]), int(v[1])) for k, v in self.first.iterator()}
        if len(heads) < 2:
            for service, t, s in pdf.drop_duplicates("service")[["service", "t", "s"]].itertuples(index=False):
                if len(heads) < 2 and service not in heads:
                    heads[service] = (int(t), int(s))
                    self.first.updateValue((service,), heads[service])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(pdf["t"].iloc[-1]) + self.keep) // 1000 + 1)
        order = sorted(heads, key=heads.get)
        t, s, onset = (pdf[c].to_numpy(dtype=np.int64) for c in ("t", "s", "onset"))
        # A service's origin is the first of the two, or the second if it is the first itself.
        own = (pdf["service"] == order[0]).to_numpy()
        second = heads[order[1]] if len(order) > 1 else None
        head = [np.where(own, second[i] if second else 0, heads[order[0]][i]) for i in (0, 1)]
        hit = ~own if second is None else np.ones(len(t), dtype=bool)
        hit &= (head[0] < t) | ((head[0] == t) & (head[1] < s))
        hit &= (onset >= head[0]) & (onset - head[0] <= self.window)
        yield pd.DataFrame(
            {
                "service": pdf["service"][hit].astype(object),
                "t": t[hit],
                "s": s[hit],
                "cascade_from": pd.Series(np.where(own[hit], order[-1], order[0]), dtype=object).to_numpy(),
                "ts": pd.to_datetime(t[hit], unit="us", utc=True),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.first.clear()
        yield pd.DataFrame({"service": _repeat("", 0), "t": np.empty(0, np.int64), "s": np.empty(0, np.int64), "cascade_from": _repeat("", 0), "ts": pd.to_datetime([], utc=True)})

    def close(self) -> None:
        pass


class PairProcessor(StatefulProcessor):
    """Key: origin and service. The first error of the pair is new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["t", "s"], ignore_index=True)
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = not self.seen.exists()
        self.seen.update((True,))
        yield pd.DataFrame(
            {"service": _repeat(key[1], len(pdf)), "t": pdf["t"], "s": pdf["s"], "cascade_from": _repeat(key[0], len(pdf)), "new_cascade": new}
        )

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, seq: str, wanted: Column, spread_ms: int | None) -> DataFrame:
    """(service, ts, t, seq) of the wanted events; with `spread_ms`, in lists that waited by service and slice.

    The filter needs `ts` as a whole: else it would be applied before the watermark, which only wanted events would move then.
    """
    keyed = df.select(
        F.coalesce("service", F.lit("")).alias("service"),
        "ts",
        (F.unix_micros("ts") + F.when(wanted, F.lit(0))).alias("t"),
        F.col(seq).cast("bigint").alias("seq"),
    ).where(F.col("t").isNotNull())
    if spread_ms is None:
        return keyed
    width = spread_ms * 1000
    sliced = keyed.withColumn("slice", F.call_function("div", F.col("t") - F.pmod("t", F.lit(width)), F.lit(width)))
    return sliced.groupBy("service", "slice").transformWithStateInPandas(
        HoldProcessor(),
        "service string, times array<bigint>, numbers array<bigint>, ts timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="ts",
    )


def stream_anomalies(
    events: DataFrame,
    baseline_us: int = 300_000_000,
    multiplier: float = 10.0,
    seq: str = "seq",
    spread_ms: int | None = None,
) -> DataFrame:
    """Anomalous errors of a watermarked stream: service, t, s, older, recent.

    A service's state goes when the watermark is two spans past its last error. Errors are judged as they arrive. With
    `spread_ms` they wait, by service and slices of that length, until the watermark passes them: a service that has most of the
    errors is spread over tasks, and lateness within the watermark changes nothing.
    """
    return (
        _keyed(events, seq, is_error(), spread_ms)
        .groupBy("service")
        .transformWithStateInPandas(
            AnomalyProcessor(
                baseline_us, multiplier, anomaly.MIN_IN_SPAN, anomaly.MIN_IN_BASELINE
            ),
            "service string, t bigint, s bigint, older bigint, recent bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def stream_silence(
    events: DataFrame,
    baseline_us: int = 300_000_000,
    threshold_pct: float = 90.0,
    log_start_us: int = 0,
    seq: str = "seq",
    spread_ms: int | None = None,
) -> DataFrame:
    """Silence of a watermarked stream at the first instant the drop holds: service, t, older, ...

    An event-time timer per service stands in for the events of other services: a silence is told
    when the watermark passes it. Nothing is told in the first span after `log_start_us`. A service's state goes when the
    watermark is two spans past its last event. `spread_ms` as for `stream_anomalies`.
    """
    return (
        _keyed(events, seq, present("service").isNotNull(), spread_ms)
        .groupBy("service")
        .transformWithStateInPandas(
            SilenceProcessor(
                half_of(baseline_us),
                threshold_pct,
                log_start_us + baseline_us,
                silence.MIN_IN_BASELINE,
            ),
            "service string, t bigint, older bigint, recent bigint, drop_pct double",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def stream_cascades(
    events: DataFrame, window_ms: int = 5000, seq: str = "seq", keep_ms: int = 3_600_000
) -> DataFrame:
    """Cascades on traces of a watermarked stream: service, t, s, cascade_from, new_cascade.

    Errors wait by service until the watermark passes them, so lateness within it changes nothing, and get the onset
    of their burst; then they meet by trace, and pairs are told as new once. A burst is forgotten when its window is over, a trace
    `keep_ms` after its last error; an error that comes later on that trace begins it anew. Pairs stay.
    """
    # As in _keyed, the filter needs `ts` as a whole.
    wanted = F.when(is_error() & present("service").isNotNull(), F.lit(0))
    errors = events.select(
        "service",
        "ts",
        (F.unix_micros("ts") + wanted).alias("t"),
        F.col(seq).cast("bigint").alias("seq"),
        present("trace_id").alias("trace"),
    ).where(F.col("t").isNotNull())
    window = window_ms * 1000
    placed = errors.groupBy("service").transformWithStateInPandas(
        OnsetProcessor(window),
        "service string, trace string, t bigint, s bigint, onset bigint, ts timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="ts",
    )
    found = placed.groupBy("trace").transformWithStateInPandas(
        TraceProcessor(window, keep_ms * 1000),
        "service string, t bigint, s bigint, cascade_from string, ts timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="ts",
    )
    return found.groupBy("cascade_from", "service").transformWithStateInPandas(
        PairProcessor(),
        "service string, t bigint, s bigint, cascade_from string, new_cascade boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
