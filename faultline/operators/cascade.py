"""Cascades: errors of one service that follow another service's errors.

The detection is a fold over one ordered stream; here it is restated in four parallel parts.

1. Time cells of width W+1 µs. Two errors of a service in one cell are never more than W apart, so a
   burst is a run of whole cells and the row volume folds away before the first shuffle.
2. Bursts: cells of a service joined while the gap is at most W. A burst stays open to others until
   the service's first event of any severity later than its last error + W.
3. Traced errors look up the two services that erred first on the trace; untraced errors look up
   the spans of time in which another burst is their origin.
4. The origins found are a narrow table keyed by position; wide event rows join it once.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.schema import cell_of, is_error, micros, present
from faultline.session import materialize, side_by_side

# The search below runs in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells per group of the origin search; a group holds at most (this + 1) bursts per service.
CELLS_PER_GROUP = 64


def _narrow(events: DataFrame, seq: str) -> DataFrame:
    """The columns detection needs, for events that name a service."""
    return events.where(present("service").isNotNull()).select(
        "service",
        micros().alias("t"),
        F.col(seq).cast("bigint").alias("s"),
        is_error().alias("err"),
        present("trace_id").alias("trace_id"),
    )


def error_table(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Errors as a written narrow table (service, t, s, trace_id), for all detectors to share."""
    return materialize(
        events.where(is_error()).select(
            present("service").alias("service"),
            micros().alias("t"),
            F.col(seq).cast("bigint").alias("s"),
            present("trace_id").alias("trace_id"),
        )
    )


def error_cells(narrow: DataFrame, window_us: int) -> DataFrame:
    """One row per service and cell with errors: onset (µs) of the burst the cell belongs to.

    A service has at most one row per W+1 µs of log time, however many events it wrote. Only 64-bit
    values are aggregated, so the fold over all events is a hash aggregation.
    """
    t, err = F.col("t"), F.col("err")
    cells = (
        narrow.groupBy("service", cell_of(t, window_us + 1).alias("cell"))
        .agg(
            F.min("t").alias("first_any"),
            F.max("t").alias("last_any"),
            F.min(F.when(err, t)).alias("first_err"),
            F.max(F.when(err, t)).alias("last_err"),
            F.count_if(err).alias("errors"),
            F.count_if(err & F.col("trace_id").isNull()).alias("untraced"),
        )
    )
    order = Window.partitionBy("service").orderBy("cell")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (F.col("errors") > 0) & (
        F.col("prev_err").isNull() | (F.col("first_err") - F.col("prev_err") > F.lit(window_us))
    )
    return (
        cells.withColumns(
            {
                "prev_err": F.last("last_err", ignorenulls=True).over(before),
                "next_cell": F.lead("cell", 1).over(order),
                "next_first": F.lead("first_any", 1).over(order),
                "next_last": F.lead("last_any", 1).over(order),
                "then_cell": F.lead("cell", 2).over(order),
                "then_first": F.lead("first_any", 2).over(order),
            }
        )
        .withColumn("onset_here", F.when(starts, F.col("first_err")))
        .withColumn("onset", F.last("onset_here", ignorenulls=True).over(upto))
        .where(F.col("errors") > 0)
        .drop("onset_here", "prev_err", "first_any", "last_any")
    )


def error_bursts(events: DataFrame, window_ms: int = 5000, seq: str = "seq") -> DataFrame:
    """Error bursts per service: errors no more than the window apart.

    Columns: service, onset and last (struct t, s), errors, untraced, closed (struct t, s; NULL
    while open) — the event at which other services stop seeing the burst.
    """
    narrow = _narrow(events, seq)
    return _bursts(narrow, materialize(error_cells(narrow, window_ms * 1000)), window_ms * 1000)


def _bursts(narrow: DataFrame, cells: DataFrame, window_us: int) -> DataFrame:
    width = window_us + 1
    following = ("next_cell", "next_first", "next_last", "then_cell", "then_first")
    shuts = F.col("last") + width
    # The first event later than last + W is in the next cell, or opens a cell after it.
    inside = (F.col("next_cell") == F.col("end_cell") + 1) & (F.col("next_first") < F.col("shuts"))
    split = inside & (F.col("next_last") >= F.col("shuts"))
    bursts = materialize(
        cells.groupBy("service", "onset")
        .agg(
            F.max("last_err").alias("last"),
            F.sum("errors").alias("errors"),
            F.sum("untraced").alias("untraced"),
            F.max("cell").alias("end_cell"),
            *[F.max_by(c, "cell").alias(c) for c in following],
        )
        .withColumn("shuts", shuts)
        .select(
            "service",
            "onset",
            "last",
            "errors",
            "untraced",
            "end_cell",
            F.when(inside & ~split, F.col("then_cell")).otherwise(F.col("next_cell")).alias("cl_cell"),
            F.when(split, F.col("shuts"))
            .when(inside, F.col("then_first"))
            .otherwise(F.col("next_first"))
            .alias("cl_low"),
            F.when(split, F.col("next_last"))
            .when(inside, F.col("then_first"))
            .otherwise(F.col("next_first"))
            .alias("cl_high"),
        )
    )

    # The sequence numbers at the three times of a burst are read from the rows of their cells.
    def read(part: str, cell, low, high):
        return F.struct(
            F.lit(part).alias("part"), cell.alias("r_cell"), low.alias("low"), high.alias("high")
        )

    onset, last = F.col("onset"), F.col("last")
    reads = bursts.select(
        F.col("service").alias("r_service"),
        F.col("onset").alias("r_onset"),
        F.explode(
            F.array(
                read("onset", cell_of(onset, width), onset, onset),
                read("last", F.col("end_cell"), last, last),
                read("closed", F.col("cl_cell"), F.col("cl_low"), F.col("cl_high")),
            )
        ).alias("r"),
    ).select("r_service", "r_onset", "r.*").where(F.col("r_cell").isNotNull())
    here = F.struct("t", "s")
    found = (
        narrow.select("service", "t", "s", "err", cell_of(F.col("t"), width).alias("cell"))
        .join(
            reads,
            (F.col("service") == F.col("r_service"))
            & (F.col("cell") == F.col("r_cell"))
            & F.col("t").between(F.col("low"), F.col("high"))
            & (F.col("err") | (F.col("part") == "closed")),
        )
        .groupBy("r_service", "r_onset")
        .agg(
            F.min(F.when(F.col("part") == "onset", here)).alias("onset"),
            F.max(F.when(F.col("part") == "last", here)).alias("last"),
            F.min(F.when(F.col("part") == "closed", here)).alias("closed"),
        )
    )
    counts = bursts.select("service", F.col("onset").alias("on_t"), "errors", "untraced")
    return found.join(
        counts, (F.col("r_service") == F.col("service")) & (F.col("r_onset") == F.col("on_t"))
    ).select("service", "onset", "last", "errors", "untraced", "closed")


def _ranks(*pairs: tuple[pd.Series, pd.Series]) -> list[np.ndarray]:
    """Rank (t, s) positions of several equally long column pairs on one scale."""
    t = np.concatenate([p[0].to_numpy() for p in pairs])
    s = np.concatenate([p[1].to_numpy() for p in pairs])
    order = np.lexsort((s, t))
    rank = np.empty(len(t), dtype=np.int64)
    rank[order] = np.r_[0, ((np.diff(t[order]) != 0) | (np.diff(s[order]) != 0)).cumsum()]
    return np.split(rank, len(pairs))


def _next_longer(closes: np.ndarray) -> np.ndarray:
    """For each burst, in onset order, the next one that closes later."""
    nxt = np.full(len(closes), len(closes), dtype=np.int64)
    open_: list[int] = []
    for i, close in enumerate(closes):
        while open_ and closes[open_[-1]] < close:
            nxt[open_.pop()] = i
        open_.append(i)
    return nxt


def _candidate_search(window_us: int):
    """Per group of cells: for each asking burst, the other bursts that can be its origin.

    A burst that began later and closes no later than another candidate is never chosen, so only a
    staircase of candidates is kept, usually one; pairs are not enumerated.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["on_t", "on_s"], ignore_index=True)
        close, last = _ranks((pdf["cl_t"], pdf["cl_s"]), (pdf["la_t"], pdf["la_s"]))
        on_t = pdf["on_t"].to_numpy()
        low = np.searchsorted(on_t, on_t - window_us, "left")
        high = np.searchsorted(on_t, on_t, "right")
        longer = _next_longer(close)
        asking, origin = [], []
        for q in np.flatnonzero(pdf["asks"].to_numpy()):
            i, covered = low[q], -1
            while i < high[q] and covered <= last[q]:
                if i == q:
                    i += 1
                    continue
                if close[i] > covered:
                    asking.append(q)
                    origin.append(i)
                    covered = close[i]
                i = longer[i]
        of = pdf.iloc[asking].reset_index(drop=True)
        by = pdf.iloc[origin].reset_index(drop=True)
        return pd.DataFrame(
            {
                "service": of["service"],
                "on_t": of["on_t"],
                "origin": by["service"],
                "o_t": by["on_t"],
                "o_s": by["on_s"],
                "cl_t": by["cl_t"],
                "cl_s": by["cl_s"],
            }
        )

    return search


def burst_origins(bursts: DataFrame, window_ms: int = 5000) -> DataFrame:
    """For each burst, the bursts of other services that began up to the window before it.

    Columns: service, onset (µs), candidates (array of struct onset, origin, closed in onset order);
    only for bursts with untraced errors, as the others never ask. The
    origin of an error in the burst is the first candidate already begun and not yet closed.
    """
    window_us = window_ms * 1000
    never = F.lit(2**63 - 1)
    flat = bursts.select(
        "service",
        F.col("onset.t").alias("on_t"),
        F.col("onset.s").alias("on_s"),
        F.col("last.t").alias("la_t"),
        F.col("last.s").alias("la_s"),
        F.coalesce("closed.t", never).alias("cl_t"),
        F.coalesce("closed.s", never).alias("cl_s"),
        (F.col("untraced") > 0).alias("asks"),
        cell_of(F.col("onset.t"), window_us + 1).alias("cell"),
    ).withColumn("grp", cell_of(F.col("cell"), CELLS_PER_GROUP))
    # The last cell of a group is also read, without asking, by the group after it.
    edge = F.pmod("cell", F.lit(CELLS_PER_GROUP)) == CELLS_PER_GROUP - 1
    own = F.struct(F.col("grp"), F.col("asks"))
    after = F.struct((F.col("grp") + 1).alias("grp"), F.lit(False).alias("asks"))
    spread = flat.withColumn(
        "to", F.explode(F.when(edge, F.array(own, after)).otherwise(F.array(own)))
    ).select(
        "to.grp", "to.asks", "service", "on_t", "on_s", "la_t", "la_s", "cl_t", "cl_s"
    )
    found = spread.groupBy("grp").applyInPandas(
        _candidate_search(window_us),
        "service string, on_t bigint, origin string, "
        "o_t bigint, o_s bigint, cl_t bigint, cl_s bigint",
    )
    # A burst has at most one candidate per other service.
    candidate = F.struct(
        F.struct(F.col("o_t").alias("t"), F.col("o_s").alias("s")).alias("onset"),
        F.col("origin"),
        F.struct(F.col("cl_t").alias("t"), F.col("cl_s").alias("s")).alias("closed"),
    )
    return found.groupBy("service", F.col("on_t").alias("onset")).agg(
        F.sort_array(F.collect_list(candidate)).alias("candidates")
    )


def trace_first_error(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Position of the first error per trace and service."""
    return _trace_first(_narrow(events, seq).where("err"))



def _trace_first(errors: DataFrame) -> DataFrame:
    return (
        errors.where(F.col("trace_id").isNotNull())
        .groupBy("trace_id", "service")
        .agg(F.min(F.struct("t", "s")).alias("first_error"))
    )


def trace_heads(first_errors: DataFrame) -> DataFrame:
    """The two services that erred first on each trace that at least two services erred on."""
    order = Window.partitionBy("trace_id").orderBy("first_error")
    head = F.struct("first_error", "service")
    return (
        first_errors.withColumns(
            {"second": F.lead(head).over(order), "rank": F.row_number().over(order)}
        )
        .where((F.col("rank") == 1) & F.col("second").isNotNull())
        .select("trace_id", head.alias("first"), "second")
    )


def cascade_origins(
    events: DataFrame,
    window_ms: int = 5000,
    seq: str = "seq",
    errors: DataFrame | None = None,
    by: str = "both",
) -> DataFrame:
    """Errors that follow another service's errors: service, t, s, cascade_from, by_trace.

    A trace decides by itself: the earliest other service on it is taken before the window is
    tested, and an error with a trace never falls back to burst overlap. `errors` takes the
    `error_table` of the events if it is already at hand. With `by` as "trace" or "overlap" only these are found, and
    what the others need is not built.
    """
    if by not in ("both", "trace", "overlap"):
        raise ValueError("by must be 'both', 'trace' or 'overlap'")
    window_us = window_ms * 1000
    narrow = _narrow(events, seq)
    cells, errors = side_by_side(
        events.sparkSession,
        lambda: materialize(error_cells(narrow, window_us)),
        lambda: error_table(events, seq) if errors is None else errors,
    )
    errors = errors.where(F.col("service").isNotNull()).withColumn(
        "cell", cell_of(F.col("t"), window_us + 1)
    )
    here = F.struct("t", "s")

    heads = trace_heads(_trace_first(errors)).withColumnRenamed("trace_id", "h_trace")
    onsets = cells.select(
        F.col("service").alias("c_service"), F.col("cell").alias("c_cell"), "onset"
    )
    in_cell = (F.col("service") == F.col("c_service")) & (F.col("cell") == F.col("c_cell"))
    head = F.when(F.col("first.service") != F.col("service"), F.col("first")).otherwise(
        F.col("second")
    )
    traced = (
        errors.join(heads, F.col("trace_id") == F.col("h_trace"))
        .select("service", "t", "s", "cell", head.alias("head"))
        .where(F.col("head.first_error") < here)
        .join(onsets, in_cell)
        .where((F.col("onset") - F.col("head.first_error.t")).between(0, window_us))
        .select("service", "t", "s", F.col("head.service").alias("cascade_from"))
        .withColumn("by_trace", F.lit(True))
    )
    if by == "trace":
        return traced

    bursts = _bursts(narrow, cells, window_us)
    origins = burst_origins(bursts, window_ms)
    asked = cells.join(
        origins.select(
            F.col("service").alias("o_service"), F.col("onset").alias("o_onset"), "candidates"
        ),
        (F.col("service") == F.col("o_service")) & (F.col("onset") == F.col("o_onset")),
    )
    # Keep, per cell, the candidates some error of the cell can still choose.
    live = F.filter(
        "candidates",
        lambda c: (c["closed"]["t"] >= F.col("first_err")) & (c["onset"]["t"] <= F.col("last_err")),
    )
    by_cell = materialize(
        asked.select(
            F.col("service").alias("c_service"),
            F.col("cell").alias("c_cell"),
            live.alias("candidates"),
        ).where(F.size("candidates") > 0)
    )
    chosen = F.element_at(
        F.filter("candidates", lambda c: (c["onset"] < here) & (c["closed"] > here)), 1
    )
    untraced = (
        errors.where(F.col("trace_id").isNull())
        .join(by_cell, in_cell)
        .where(
            F.exists("candidates", lambda c: (c["onset"] < here) & (c["closed"] > here))
        )
        .select("service", "t", "s", chosen["origin"].alias("cascade_from"))
        .withColumn("by_trace", F.lit(False))
    )
    return untraced if by == "overlap" else traced.unionByName(untraced)


def first_edges(origins: DataFrame) -> DataFrame:
    """One row per (cascade_from, service): first position and number of errors."""
    return origins.groupBy("cascade_from", "service").agg(
        F.min(F.struct("t", "s")).alias("first"), F.count(F.lit(1)).alias("errors")
    )


def mark_new(origins: DataFrame) -> DataFrame:
    """Add new_cascade: true on the first error of each (cascade_from, service) pair."""
    edges = first_edges(origins).select(
        F.col("cascade_from").alias("e_from"), F.col("service").alias("e_service"), "first"
    )
    return origins.join(
        edges,
        (F.col("cascade_from") == F.col("e_from")) & (F.col("service") == F.col("e_service")),
    ).select(
        *origins.columns, (F.col("first") == F.struct("t", "s")).alias("new_cascade")
    )


def attach(events: DataFrame, found: DataFrame, seq: str = "seq") -> DataFrame:
    """Join columns found per error position to the events.

    A position is (service, ts, seq); sources that number their own rows may share (ts, seq) if their services differ.
    Events below ERROR cannot carry them and pass by without a shuffle.
    """
    extra = [c for c in found.columns if c not in ("service", "t", "s")]
    keyed = found.select(
        F.timestamp_micros("t").alias("f_ts"), F.col("s").alias("f_seq"), present("service").alias("f_service"), *extra
    )
    errors = events.where(is_error()).join(
        keyed,
        (F.col("ts") == F.col("f_ts"))
        & (F.col(seq).cast("bigint") == F.col("f_seq"))
        & present("service").eqNullSafe(F.col("f_service")),
        "left",
    )
    types = {f.name: f.dataType for f in found.schema}
    rest = events.where(~is_error() | F.col("severity").isNull()).withColumns(
        {c: F.lit(None).cast(types[c]) for c in extra}
    )
    return errors.select(*events.columns, *extra).unionByName(rest.select(*events.columns, *extra))


def detect_cascades(events: DataFrame, window_ms: int = 5000, seq: str = "seq") -> DataFrame:
    """The events with cascade_from (NULL where none) and new_cascade."""
    origins = materialize(cascade_origins(events, window_ms, seq))
    return attach(events, mark_new(origins).drop("by_trace"), seq).withColumn(
        "new_cascade", F.coalesce("new_cascade", F.lit(False))
    )


def drift_origins(
    events: DataFrame, window_ms: int, tolerance_ms: int, seq: str = "seq"
) -> DataFrame:
    """Errors whose origin is found only with the window widened by the tolerance.

    Columns as `cascade_origins`, plus drift_warning. Errors with an origin inside the plain window
    keep that one and are not repeated here.
    """
    key = ["service", "t", "s"]
    errors = error_table(events, seq)
    inside, wide = side_by_side(
        events.sparkSession,
        lambda: materialize(cascade_origins(events, window_ms, seq, errors).select(*key)),
        lambda: cascade_origins(events, window_ms + tolerance_ms, seq, errors),
    )
    return (
        wide.join(inside, key, "left_anti")
        .withColumn(
            "drift_warning",
            F.lit(f"origin up to {tolerance_ms} ms outside the {window_ms} ms window"),
        )
    )
