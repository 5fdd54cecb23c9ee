"""Error-rate anomalies: a service errs far more in the recent half of the span than before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.cascade import attach, error_table
from faultline.operators.rates import cell_sums, cell_width, count_cells, trailing_counts
from faultline.session import materialize

# Errors needed in the span, and in its older half, before a rate is compared.
MIN_IN_SPAN = 10
MIN_IN_BASELINE = 5


def error_rows(errors: DataFrame) -> DataFrame:
    """The error table as (k, t, s). Errors without a service form one group of their own."""
    return errors.select(F.coalesce("service", F.lit("")).alias("k"), "t", "s")


def find_anomalies(
    events: DataFrame,
    baseline_us: int,
    multiplier: float = 10.0,
    seq: str = "seq",
    errors: DataFrame | None = None,
) -> DataFrame:
    """Positions of anomalous errors: service, t, s, older, recent.

    The cell counts give limits for every error in a cell; cells in which no error can reach the
    multiple are dropped, so in a healthy log almost no row is ranked exactly. `errors` takes the
    `error_table` of the events if it is already at hand.
    """
    rows = error_rows(error_table(events, seq) if errors is None else errors)
    per_half, width = cell_width(baseline_us)
    sums = cell_sums(count_cells(rows, width), per_half)
    most_recent = F.col("n") + F.col("recent_full") + F.col("at_half")
    most_older = F.col("at_half") + F.col("older_full") + F.col("at_span")
    least_older = F.greatest(F.col("older_full"), F.lit(MIN_IN_BASELINE))
    possible = materialize(
        sums.where(
            (most_older >= MIN_IN_BASELINE)
            & (most_older + most_recent >= MIN_IN_SPAN)
            & (most_recent >= least_older * F.lit(float(multiplier)))
        )
    )
    counts = trailing_counts(rows, possible, baseline_us, inclusive_span=False, some_cells=True)
    half_minutes = baseline_us / 60e6 / 2
    base, now = F.col("older") / F.lit(half_minutes), F.col("recent") / F.lit(half_minutes)
    return counts.where(
        (F.col("older") + F.col("recent") >= MIN_IN_SPAN)
        & (F.col("older") >= MIN_IN_BASELINE)
        & (now >= base * F.lit(float(multiplier)))
    ).select(F.col("k").alias("service"), "t", "s", "older", "recent")


def detect_anomalies(
    events: DataFrame,
    baseline_us: int = 300_000_000,
    multiplier: float = 10.0,
    seq: str = "seq",
) -> DataFrame:
    """The events with is_anomaly."""
    found = find_anomalies(events, baseline_us, multiplier, seq).select(
        "service", "t", "s", F.lit(True).alias("is_anomaly")
    )
    return attach(events, found, seq).withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(False))
    )
