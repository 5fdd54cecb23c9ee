"""Events of a stream in order: held until nothing earlier can come, then let go by time slice.

The buffer is keyed by source and slice of time, so neither a source nor the stream has to fit one task, and the state of a
slice is written once for each batch that has rows of it, not once a row. A slice is let go as a whole when the watermark has passed
its end. Slices lie on one grid for all sources, so whatever a batch lets go comes before what any later batch does.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from faultline.schema import cell_of

# As in `stateful`: workers get the processor by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class ReorderProcessor(StatefulProcessor):
    """Key: source, slice. State: the rows of the slice, a list entry for each batch that brought some."""

    def __init__(self, slice_us: int):
        self.slice_us = slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t array<bigint>, s array<bigint>, row array<string>")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        if not self.held.exists():
            # A timer fires once the watermark is greater; the last instant of the slice must be past.
            self.handle.registerTimer(-(-((int(key[1]) + 1) * self.slice_us - 1) // 1000) - 1)
        self.held.appendValue((pdf["t"].tolist(), pdf["s"].tolist(), pdf["row"].tolist()))
        yield self._frame([], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = list(self.held.get())
        t, s = (np.concatenate([np.asarray(h[i], dtype=np.int64) for h in held]) for i in (0, 1))
        row = [r for h in held for r in h[2]]
        order = np.lexsort((s, t))
        self.held.clear()
        yield self._frame(t[order], s[order], [row[i] for i in order])

    def _frame(self, t, s, row) -> pd.DataFrame:
        return pd.DataFrame(
            {"t": np.asarray(t, dtype=np.int64), "s": np.asarray(s, dtype=np.int64), "row": pd.Series(row, dtype=object)}
        )

    def close(self) -> None:
        pass


def reorder(events: DataFrame, slice_ms: int = 1000, seq: str = "seq") -> DataFrame:
    """The rows of a watermarked stream, let go in (ts, seq) order across batches.

    Rows come out once the watermark has passed their slice of time. Of two rows in different batches the earlier one is in the
    earlier batch; rows of one batch are sorted by its sink (`in_order`). Rows behind the watermark are dropped, and counted by
    the query's progress (`numRowsDroppedByWatermark`). A null source is a source of its own. The state of a slice ends with its release.
    """
    schema: StructType = events.schema
    width = slice_ms * 1000
    keyed = events.select(
        F.coalesce("source", F.lit("")).alias("source"),
        cell_of(F.unix_micros("ts"), width).alias("slice"),
        "ts",
        F.unix_micros("ts").alias("t"),
        F.col(seq).cast("bigint").alias("s"),
        F.to_json(F.struct(*events.columns), _OPTIONS).alias("row"),
    )
    free = keyed.groupBy("source", "slice").transformWithStateInPandas(
        ReorderProcessor(width), "t bigint, s bigint, row string", outputMode="Append", timeMode="EventTime"
    )
    return free.select(F.from_json("row", schema, _OPTIONS).alias("r")).select("r.*")


def in_order(batch: DataFrame, seq: str = "seq") -> DataFrame:
    """A micro-batch sorted over all its partitions, so partition numbers and rows in them follow (ts, seq)."""
    return batch.orderBy("ts", seq)


def write_ordered(
    events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, slice_ms: int = 1000, seq: str = "seq", **trigger
) -> StreamingQuery:
    """Hand the reordered stream to `write`, one sorted micro-batch after another."""
    return (
        reorder(events, slice_ms, seq)
        .writeStream.foreachBatch(lambda batch, number: write(in_order(batch, seq), number))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
