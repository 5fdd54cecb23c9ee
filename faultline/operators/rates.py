"""Trailing counts: how many events of the same key lie in the span before each event.

The span B splits into an older half [t-B, t-B/2) and a recent half [t-B/2, t]. Counts come from
fixed time cells (32 per span) that fold away before any shuffle, plus exact ranks inside the three
cells an event's limits fall into. A detector that can rule cells out by their counts alone passes
the cells that are left, and only rows of those are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.scan import Run, running
from faultline.schema import cell_of

CELLS_PER_HALF = 16

# Order of marks at one instant: a strict limit, then the events, then an inclusive limit.
_BEFORE, _EVENT, _AFTER = 0, 1, 2


def half_of(span_us: int) -> int:
    """Half a span, which must be a whole number of microseconds: both halves are counted in whole cells."""
    if span_us < 2 or span_us % 2:
        raise ValueError("the span must be an even number of microseconds, 2 at least")
    return span_us // 2


def cell_width(span_us: int) -> tuple[int, int]:
    """(cells per half, cell width), the half being a whole number of cells."""
    half = half_of(span_us)
    for per_half in range(min(CELLS_PER_HALF, half), 0, -1):
        if half % per_half == 0:
            return per_half, half // per_half
    raise AssertionError("unreachable: 1 divides every half")


def count_cells(rows: DataFrame, width: int) -> DataFrame:
    """Rows per key `k` and cell: at most one row per key and cell of log time."""
    return rows.groupBy("k", cell_of(F.col("t"), width).alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )


def cell_sums(cells: DataFrame, per_half: int) -> DataFrame:
    """Add, per cell c, the counts of the cells between and at the limits of its events.

    recent_full and older_full count cells wholly inside the halves for every event of c;
    at_half and at_span count the two cells the limits fall into.
    """
    order = Window.partitionBy("k").orderBy("cell")

    def between(first: int, last: int) -> Column:
        if first > last:
            return F.lit(0).cast("bigint")
        return F.coalesce(F.sum("n").over(order.rangeBetween(first, last)), F.lit(0))

    return cells.withColumns(
        {
            "recent_full": between(-per_half + 1, -1),
            "at_half": between(-per_half, -per_half),
            "older_full": between(-2 * per_half + 1, -per_half - 1),
            "at_span": between(-2 * per_half, -2 * per_half),
        }
    )


def trailing_counts(
    rows: DataFrame,
    sums: DataFrame,
    span_us: int,
    inclusive_span: bool,
    some_cells: bool = False,
) -> DataFrame:
    """Exact (k, t, s, older, recent) for the rows in the cells of `sums`.

    `rows` has k, t, s with (t, s) unique within k. An event exactly a span old counts only if
    `inclusive_span`. Among rows of one instant, those at or before the row's place in s count.
    With `some_cells`, rows of cells that no result needs are left out before the shuffle.
    """
    per_half, width = cell_width(span_us)
    half = per_half * width
    placed = rows.withColumn("cell", cell_of(F.col("t"), width))
    if some_cells:
        used = sums.select(
            "k",
            F.explode(
                F.array(
                    F.struct(F.col("cell").alias("u_cell"), F.lit(True).alias("asks")),
                    F.struct((F.col("cell") - per_half).alias("u_cell"), F.lit(False).alias("asks")),
                    F.struct(
                        (F.col("cell") - 2 * per_half).alias("u_cell"), F.lit(False).alias("asks")
                    ),
                )
            ).alias("u"),
        )
        used = used.groupBy(F.col("k").alias("u_k"), "u.u_cell").agg(F.max("u.asks").alias("asks"))
        placed = placed.join(
            used, F.col("k").eqNullSafe(F.col("u_k")) & (F.col("cell") == F.col("u_cell"))
        )
    else:
        placed = placed.withColumn("asks", F.lit(True))

    t, s = F.col("t"), F.col("s")

    def mark(at: Column, kind: int, one: int, shift: int) -> Column:
        return F.struct(
            (F.col("cell") - shift).alias("in_cell"),
            at.alias("at"),
            F.lit(kind).alias("kind"),
            F.lit(one).cast("bigint").alias("one"),
        )

    own = mark(t, _EVENT, 1, 0)
    at_half = mark(t - half, _BEFORE, 0, per_half)
    at_span = mark(t - 2 * half, _BEFORE if inclusive_span else _AFTER, 0, 2 * per_half)
    marks = placed.select(
        "k",
        "t",
        "s",
        "cell",
        F.explode(F.when(F.col("asks"), F.array(own, at_half, at_span)).otherwise(F.array(own))).alias(
            "m"
        ),
    ).select("k", "t", "s", "cell", "m.*")
    ranked = running(
        marks, ["k", "in_cell"], ["at", "kind", "t", "s"], {"rank": Run("sum", "one")}
    )
    # The three marks of a row meet again; (t, s) spreads evenly, whatever the key holds.
    is_own = F.col("in_cell") == F.col("cell")
    is_half = F.col("in_cell") == F.col("cell") - per_half
    is_span = F.col("in_cell") == F.col("cell") - 2 * per_half
    ranks = ranked.groupBy("k", "t", "s", "cell").agg(
        F.max(F.when(is_own, F.col("rank"))).alias("own_rank"),
        F.max(F.when(is_half, F.col("rank"))).alias("half_rank"),
        F.max(F.when(is_span, F.col("rank"))).alias("span_rank"),
    ).where(F.col("half_rank").isNotNull())
    sums = sums.select(
        F.col("k").alias("s_k"),
        F.col("cell").alias("s_cell"),
        "recent_full",
        "at_half",
        "older_full",
        "at_span",
    )
    return ranks.join(
        sums, F.col("k").eqNullSafe(F.col("s_k")) & (F.col("cell") == F.col("s_cell"))
    ).select(
        "k",
        "t",
        "s",
        (
            F.col("half_rank") + F.col("older_full") + F.col("at_span") - F.col("span_rank")
        ).alias("older"),
        (
            F.col("own_rank") + F.col("recent_full") + F.col("at_half") - F.col("half_rank")
        ).alias("recent"),
    )


def half_window_rates(
    rows: DataFrame, span_us: int, inclusive_span: bool = False
) -> DataFrame:
    """(k, t, s, older, recent) for every row of `rows` (k, t, s)."""
    per_half, width = cell_width(span_us)
    sums = cell_sums(count_cells(rows, width), per_half)
    return trailing_counts(rows, sums, span_us, inclusive_span)


def trailing_count(rows: DataFrame, span_us: int, inclusive_span: bool = False) -> DataFrame:
    """(k, t, s, n): rows of the key in the span up to and with each row."""
    return half_window_rates(rows, span_us, inclusive_span).select(
        "k", "t", "s", (F.col("older") + F.col("recent")).alias("n")
    )
