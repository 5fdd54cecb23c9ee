"""Running values along an order, without putting a whole key in one task.

A window over `partitionBy(service)` sends every row of a service to one task, so a service with a
third of the rows stops the job. `running` cuts the order into slices of equal row count instead,
works out each slice on its own, and adds what the earlier slices of the same key carry in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize

SLICE = "_slice"


@dataclass(frozen=True)
class Run:
    """One running value: op is sum, max, min (all up to and with the row), prev or next."""

    op: str
    value: str | Column

    def column(self) -> Column:
        return F.col(self.value) if isinstance(self.value, str) else self.value


_COMBINE = {
    "sum": lambda local, carry: F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)),
    "max": lambda local, carry: F.greatest(local, carry),
    "min": lambda local, carry: F.least(local, carry),
    "prev": lambda local, carry: F.coalesce(local, carry),
    "next": lambda local, carry: F.coalesce(local, carry),
}
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    runs: dict[str, Run],
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add the `runs` of `df` along `order` within `keys`.

    `order` must be a total order within a key. The rows are range-partitioned by key and order, so
    equal-sized slices come out whatever the key holds; the slice number is written with the rows,
    which keeps it fixed when a task is retried. The carry table has at most
    slices + distinct keys rows.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inputs = {f"_in_{name}": run.column() for name, run in runs.items()}
    staged = materialize(
        df.withColumns(inputs)
        .repartitionByRange(n, *[F.col(k).asc() for k in keys], *along)
        .withColumn(SLICE, F.spark_partition_id())
    )

    inside = Window.partitionBy(SLICE, *keys).orderBy(*along)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {}
    for name, run in runs.items():
        source = F.col(f"_in_{name}")
        if run.op == "prev":
            local[f"_run_{name}"] = F.lag(source).over(inside)
        elif run.op == "next":
            local[f"_run_{name}"] = F.lead(source).over(inside)
        else:
            local[f"_run_{name}"] = _FOLD[run.op](source).over(upto)
    rows = staged.withColumns(local)

    position = F.struct(*order)
    first_at, last_at = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)
    folds = []
    for name, run in runs.items():
        source = F.col(f"_in_{name}")
        if run.op == "prev":
            folds.append(last_at(source, position).alias(f"_all_{name}"))
        elif run.op == "next":
            folds.append(first_at(source, position).alias(f"_all_{name}"))
        else:
            folds.append(_FOLD[run.op](source).alias(f"_all_{name}"))
    totals = staged.groupBy(SLICE, *keys).agg(*folds)

    across = Window.partitionBy(*keys).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for name, run in runs.items():
        whole = F.col(f"_all_{name}")
        if run.op == "prev":
            carry = F.lag(whole).over(across)
        elif run.op == "next":
            carry = F.lead(whole).over(across)
        else:
            carry = _FOLD[run.op](whole).over(before)
        carries.append(carry.alias(f"_carry_{name}"))
    carried = totals.select(
        F.col(SLICE).alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys], *carries
    )

    match = F.col(SLICE) == F.col("_s")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = rows.join(carried, match, "left")
    return joined.select(
        *df.columns,
        *[
            _COMBINE[run.op](F.col(f"_run_{name}"), F.col(f"_carry_{name}")).alias(name)
            for name, run in runs.items()
        ],
    )
