"""Silence: a service writes far less in the recent half of the span than in the older half.

Counts are checked at every event of any service ("events") or on a fixed time grid ("tick"). A
service is reported once per gap between two of its events. Each event e changes the counts of its
service three times: when it arrives, when it leaves the recent half and when it leaves the span.
Per time cell those changes are summed first; the sums bound what the counts can be inside a cell,
and only cells in which the drop can reach the threshold are swept row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.rates import cell_width
from faultline.operators.scan import Run, running
from faultline.schema import cell_of, micros, present
from faultline.session import materialize

# Fixed value: events needed in the older half before a drop is judged.
MIN_IN_BASELINE = 5

# Order at one instant: counts expire, then events arrive, then a tick looks.
_EXPIRY, _ARRIVAL, _TICK = 0, 1, 2


def _drop_pct(recent: Column, older: Column, half_minutes: float) -> Column:
    older = F.greatest(older, F.lit(1))
    base, now = older / F.lit(half_minutes), recent / F.lit(half_minutes)
    return (F.lit(1) - now / base) * F.lit(100)


def _changes(e: Column, half: int) -> Column:
    """The three changes of one event at `e`: (at, kind, recent, older, arrived)."""

    def change(at: Column, kind: int, recent: int, older: int) -> Column:
        return F.struct(
            at.alias("at"),
            F.lit(kind).alias("kind"),
            F.lit(recent).cast("bigint").alias("recent"),
            F.lit(older).cast("bigint").alias("older"),
            F.lit(int(kind == _ARRIVAL)).cast("bigint").alias("arrived"),
        )

    return F.array(
        change(e, _ARRIVAL, 1, 0),
        change(e + half + 1, _EXPIRY, -1, 1),
        change(e + 2 * half + 1, _EXPIRY, 0, -1),
    )


def _cell_states(named: DataFrame, half: int, width: int) -> DataFrame:
    """Per service and cell with changes: the counts before it and where the next changes are.

    Only 64-bit values are aggregated, so the fold over all events is a hash aggregation.
    """
    # Events on the last tick of a cell expire one cell later than the others of the cell.
    folded = named.groupBy(
        "service",
        cell_of(F.col("t"), width).alias("e_cell"),
        (F.pmod("t", F.lit(width)) == width - 1).alias("on_edge"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))
    changes = folded.select("service", "n", F.explode(_changes(F.col("first"), half)).alias("c"))
    n = F.col("n")
    per_cell = changes.groupBy("service", cell_of(F.col("c.at"), width).alias("cell")).agg(
        F.sum(n * F.col("c.recent")).alias("d_recent"),
        F.sum(n * F.col("c.older")).alias("d_older"),
        F.sum(n * F.col("c.arrived")).alias("d_gap"),
        F.coalesce(F.sum(F.when(F.col("c.recent") < 0, n)), F.lit(0)).alias("aging"),
        F.min("c.at").alias("first_at"),
    )
    order = Window.partitionBy("service").orderBy("cell")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column: str) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    return per_cell.select(
        "service",
        "cell",
        "aging",
        so_far("d_recent").alias("recent0"),
        so_far("d_older").alias("older0"),
        so_far("d_gap").alias("gap0"),
        F.lead("cell").over(order).alias("next_cell"),
        F.lead("first_at").over(order).alias("next_at"),
    )


def _quiet_stretches(
    named: DataFrame,
    half: int,
    width: int,
    threshold_pct: float,
    active_from: int,
    end: int,
) -> DataFrame:
    """Stretches between two changes in which the drop holds, as far as `active_from` to `end` goes.

    Columns: service, older, recent, gap (number of the service's events so far), from and until
    (position structs at, kind, s; until NULL at the end of the log).
    """
    half_minutes = half / 60e6
    states = _cell_states(named, half, width)
    most_older = F.col("older0") + F.col("aging")
    least_recent = F.greatest(F.col("recent0") - F.col("aging"), F.lit(0))
    possible = materialize(
        states.where(
            (F.col("cell") <= end // width)
            & (F.col("next_at").isNull() | (F.col("next_at") >= active_from))
            & (most_older >= MIN_IN_BASELINE)
            & (_drop_pct(least_recent, most_older, half_minutes) >= threshold_pct)
        )
    )
    # Rows are read from the possible cells, and at the first instant of the cell after each.
    after = possible.where(F.col("next_cell").isNotNull()).select(
        "service", F.col("next_cell").alias("cell"), F.col("next_at").alias("only_at")
    )
    wanted = (
        possible.select("service", "cell", F.lit(None).cast("bigint").alias("only_at"))
        .unionByName(after)
        .select(F.col("service").alias("w_service"), F.col("cell").alias("w_cell"), "only_at")
    )
    changes = materialize(
        named.select("service", "t", "s", F.explode(_changes(F.col("t"), half)).alias("c"))
        .select("service", "s", "c.*")
        .withColumn("cell", cell_of(F.col("at"), width))
        .join(
            wanted,
            (F.col("service") == F.col("w_service"))
            & (F.col("cell") == F.col("w_cell"))
            & (F.col("only_at").isNull() | (F.col("at") == F.col("only_at"))),
        )
        .drop("w_service", "w_cell")
    )
    position = F.struct("at", "kind", "s")
    openings = (
        changes.where(F.col("only_at").isNotNull())
        .groupBy(F.col("service").alias("n_service"), F.col("cell").alias("n_cell"))
        .agg(F.min(position).alias("next_change"))
    )
    swept = running(
        changes.where(F.col("only_at").isNull()).drop("only_at"),
        ["service", "cell"],
        ["at", "kind", "s"],
        {
            "d_recent": Run("sum", "recent"),
            "d_older": Run("sum", "older"),
            "d_gap": Run("sum", "arrived"),
            "following": Run("next", position),
        },
    )
    states = possible.select(
        F.col("service").alias("c_service"),
        F.col("cell").alias("c_cell"),
        "recent0",
        "older0",
        "gap0",
        "next_cell",
    )
    in_cell = (F.col("service") == F.col("c_service")) & (F.col("cell") == F.col("c_cell"))
    into = (F.col("service") == F.col("n_service")) & (F.col("next_cell") == F.col("n_cell"))
    return (
        swept.join(states, in_cell)
        .select(
            "service",
            (F.col("older0") + F.col("d_older")).alias("older"),
            (F.col("recent0") + F.col("d_recent")).alias("recent"),
            (F.col("gap0") + F.col("d_gap")).alias("gap"),
            position.alias("from"),
            "following",
            "next_cell",
        )
        .where(
            (F.col("older") >= MIN_IN_BASELINE)
            & (_drop_pct(F.col("recent"), F.col("older"), half_minutes) >= threshold_pct)
        )
        .join(openings, into, "left")
        .select(
            "service",
            "older",
            "recent",
            "gap",
            "from",
            F.coalesce("following", "next_change").alias("until"),
        )
    )


def next_check(asked: DataFrame, checks: DataFrame, width: int) -> DataFrame:
    """(look_from, found): the first check at or after each distinct `look_from`, in µs.

    `checks` has t and s; `found` is struct (at, kind, s). A forward as-of join in two sweeps, each in slices that carry the
    first check of the slices after them: one over time cells of `width`, of which there is one row for each with a check or a
    look, and one over the checks that can be found at all, those of the asked cells and the first of the next cell that has any.
    """
    points = asked.select("look_from").distinct()
    placed = checks.select("t", "s", cell_of(F.col("t"), width).alias("cell"))
    asks = points.select(cell_of(F.col("look_from"), width).alias("cell")).distinct()
    # A cell that asks stands between its own checks and those of later cells, which it looks for.
    cells = (
        placed.groupBy("cell").agg(F.min("t").alias("first")).select((F.col("cell") * 2).alias("pos"), "first")
    ).unionByName(asks.select((F.col("cell") * 2 + 1).alias("pos"), F.lit(None).cast("bigint").alias("first")))
    swept_cells = running(cells, [], ["pos"], {"later": Run("min", "first")}, descending=True)
    nearest = swept_cells.where(F.col("pos") % 2 != 0).select(
        cell_of(F.col("pos"), 2).alias("cell"), "later"
    )
    wanted = materialize(
        nearest.select("cell", F.lit(None).cast("bigint").alias("only_t"))
        .unionByName(
            nearest.where(F.col("later").isNotNull()).select(
                cell_of(F.col("later"), width).alias("cell"), F.col("later").alias("only_t")
            )
        )
        .groupBy(F.col("cell").alias("w_cell"))
        .agg(F.min("only_t").alias("only_t"), F.bool_or(F.col("only_t").isNull()).alias("whole"))
    )
    near = placed.join(
        wanted,
        (F.col("cell") == F.col("w_cell")) & (F.col("whole") | (F.col("t") == F.col("only_t"))),
    )
    marks = near.select(
        F.col("t").alias("at"), F.lit(_ARRIVAL).alias("kind"), "s"
    ).unionByName(
        points.select(
            F.col("look_from").alias("at"),
            F.lit(_EXPIRY).alias("kind"),
            F.lit(0).cast("bigint").alias("s"),
        )
    )
    check_at = F.when(F.col("kind") == _ARRIVAL, F.struct("at", "kind", "s"))
    swept = running(
        marks, [], ["at", "kind", "s"], {"found": Run("min", check_at)}, descending=True
    )
    return swept.where((F.col("kind") == _EXPIRY) & F.col("found").isNotNull()).select(
        F.col("at").alias("look_from"), "found"
    )


def detect_silence(
    events: DataFrame,
    baseline_us: int = 300_000_000,
    threshold_pct: float = 90.0,
    check: str = "events",
    tick_us: int = 1_000_000,
    seq: str = "seq",
    log_start_us: int | None = None,
) -> DataFrame:
    """One row per service and gap in which it went silent.

    Columns: service, t, s (where it was noticed; s is NULL for a tick), older, recent, drop_pct,
    baseline_rate, current_rate (events per minute). Nothing is reported in the first span of the
    log, counted from `log_start_us` or else the first event. `check="tick"` needs no other service's events and is the cheaper choice for long logs.
    """
    if check not in ("events", "tick"):
        raise ValueError("check must be 'events' or 'tick'")
    per_half, width = cell_width(baseline_us)
    half = per_half * width
    all_rows = events.select(
        present("service").alias("service"), micros().alias("t"), F.col(seq).cast("bigint").alias("s")
    )
    named = all_rows.where(F.col("service").isNotNull())
    start, end = all_rows.agg(F.min("t"), F.max("t")).first()
    if start is None:
        start = end = 0
    active_from = (start if log_start_us is None else log_start_us) + baseline_us

    stretches = (
        _quiet_stretches(named, half, width, threshold_pct, active_from, end)
        .withColumn("look_from", F.greatest("from.at", F.lit(active_from)))
        .where(F.col("until").isNull() | (F.col("until.at") >= F.col("look_from")))
        .where(F.col("look_from") <= end)
    )
    if check == "tick":
        up = F.pmod(-F.col("look_from"), F.lit(tick_us))
        seen = stretches.withColumn(
            "found",
            F.struct(
                (F.col("look_from") + up).alias("at"),
                F.lit(_TICK).alias("kind"),
                F.lit(None).cast("bigint").alias("s"),
            ),
        ).where(F.col("found.at") <= end)
    else:
        stretches = materialize(stretches)
        at_once = (F.col("from.kind") == _ARRIVAL) & (F.col("from.at") >= active_from)
        later = stretches.where(~at_once)
        found = next_check(later, all_rows.select("t", "s"), width)
        seen = stretches.where(at_once).withColumn("found", F.col("from")).unionByName(
            later.join(found, "look_from").select(*stretches.columns, "found")
        )
    seen = seen.where(F.col("until").isNull() | (F.col("found") < F.col("until")))
    half_minutes = F.lit(half / 60e6)
    return (
        seen.groupBy("service", "gap")
        .agg(F.min(F.struct("found", "older", "recent")).alias("x"))
        .select(
            "service",
            F.col("x.found.at").alias("t"),
            F.col("x.found.s").alias("s"),
            F.col("x.older").alias("older"),
            F.col("x.recent").alias("recent"),
            _drop_pct(F.col("x.recent"), F.col("x.older"), half / 60e6).alias("drop_pct"),
            (F.col("x.older") / half_minutes).alias("baseline_rate"),
            (F.col("x.recent") / half_minutes).alias("current_rate"),
        )
    )
