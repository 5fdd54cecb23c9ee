"""Helpers of the subpackage: tables, folds, Arrow batches, written tables, components."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.session import materialize  # noqa: F401  (operators import it from here)

#: Bytes of text that one numpy step works on; a longer text makes a step of its own.
STEP_BYTES = 2 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package where it isn't installed; on a cluster use --py-files."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets its own number.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let rows go to Python workers in batches of BATCH_BYTES.

    Spark's own limits are 64 MB and 10,000 rows. An executor's JVM keeps much of the memory that large batches took, beside its
    heap, and a worker holds two batches at a time. Plans take the number when they run, so it stays set in the session.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """Fold of a row: crc32 of the key as text, modulo `n`; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def release() -> None:
    """Give memory that a task has freed back to the system: a worker is kept, and an executor's workers share its memory."""
    words.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of `text`, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        at, ends = 0, np.cumsum(sizes)
        while at < len(sizes):
            done = ends[at - 1] if at else 0
            end = max(int(np.searchsorted(ends, done + most, "right")), at + 1)
            yield batch.slice(at, end - at)
            at = end
    batch = column = None
    release()


def stars(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components as a written table (u, v): v is the smallest node that u reaches; smallest nodes have no row.

    Large-star and small-star rounds over the edge table, until every node but the smallest has one edge, to a node that
    has none to a smaller one. Every round is two groupings by node with partial aggregation; their results are written to
    the shared folder, so joins with them can split a node of many edges. A node's edges are never gathered. The first
    grouping tells whether the rounds are over, and then is the result. Nodes may be of any type with an order, edges may
    repeat.
    """
    now = materialize(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v"))
    while True:
        ends = now.select("u", "v", F.lit(False).alias("above")).unionAll(now.select("v", F.lit(None), F.lit(True)))
        node = ends.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("above").alias("above"))
        node = materialize(node)
        if node.where("low <> high OR (above AND low IS NOT NULL)").isEmpty():
            return node.where("low IS NOT NULL").select("u", F.col("low").alias("v"))
        least = node.select(F.col("u").alias("v"), F.coalesce("low", "u").alias("m"))
        large = materialize(now.join(least, "v").select("u", F.col("m").alias("v")).distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components: (node, component), component = the smallest node reachable; smallest nodes included."""
    found = stars(edges.select(left, right).where(F.col(left) != F.col(right)).distinct(), left, right)
    roots = found.select(F.col("v").alias("node")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )


def fresh(name: str, taken: list[str]) -> str:
    """A column name that the table doesn't have."""
    while name in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups from rows sorted by their first `keys` columns, with the groups' offsets, end included."""
    held: list[pa.RecordBatch] = []  # the last group so far

    def key(b: pa.RecordBatch, i: int) -> list:
        return [c[i].as_py() for c in b.columns[:keys]]

    def bounds(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in b.columns[:keys]:
            c = pc.fill_null(c, "\x00") if pa.types.is_string(c.type) else pc.fill_null(c, -1)
            new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        if held and key(held[0], 0) == key(b, 0) == key(b, b.num_rows - 1):
            held.append(b)  # a group of many batches is put together once
            continue
        if held:
            b = pa.concat_batches([*held, b])
        at = bounds(b)
        held = [b.slice(int(at[-1]))]
        if at[-1]:
            yield b.slice(0, int(at[-1])), at
    if held:
        b = pa.concat_batches(held)
        held = []
        yield b, np.array([0, b.num_rows])
    b = None
    release()
