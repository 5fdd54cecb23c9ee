"""Near-duplicate vectors: random hyperplanes in several tables, exact cosines in buckets, connected components.

Equal vectors of a label become one class first. Each class goes to one bucket of every table, named by the signs of BITS
projections. A task compares the classes of a bucket by a matrix product; larger buckets are dealt to several tasks
as pairs of blocks. Two classes that meet in several tables are counted in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import components, groups, materialize

#: At a cosine of 0.98, bits agree with probability 0.936; two vectors share no bucket with probability 6e-6.
TABLES, BITS = 24, 14
LEAST_COSINE = 0.98
#: Classes of one bucket that are compared at once.
BLOCK = 2048
SEED = 7


def planes(width: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, TABLES * BITS))


def codes(x: np.ndarray) -> np.ndarray:
    """Bucket numbers (rows, TABLES)."""
    signs = (x @ planes(x.shape[1]) > 0).reshape(len(x), TABLES, BITS)
    return signs @ (1 << np.arange(BITS))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class with its bucket in every table; a batch may hold vectors of several widths."""
    for b in batches:
        width = np.diff(np.asarray(b.column(3).offsets))
        for w in np.unique(width):
            some = b.filter(pa.array(width == w))
            rows = np.repeat(np.arange(some.num_rows), TABLES)
            yield pa.record_batch(
                [
                    some.column(0).take(pa.array(rows)),
                    pa.array(np.full(len(rows), w, np.int32)),
                    pa.array(np.tile(np.arange(TABLES, dtype=np.int32), some.num_rows)),
                    pa.array(codes(_matrix(some.column(3))).ravel().astype(np.int64)),
                    *(c.take(pa.array(rows)) for c in some.columns[1:]),
                ],
                ["label", "width", "tab", "code", "rep", "copies", "vec"],
            )


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, links, root): other vectors linked in this bucket first, and the smallest class reached in it."""
    for b, at in groups(batches, 6):
        reps, copies, block = (np.asarray(b.column(i)) for i in (6, 7, 8))
        tab, p = np.asarray(b.column(2)), np.asarray(b.column(4))
        for a, z in zip(at, at[1:]):
            if z - a < 2:
                continue
            x = _matrix(b.column(9).slice(int(a), int(z - a)))
            norm = np.sqrt((x * x).sum(axis=1))
            near = (x @ x.T) / np.outer(norm, norm) >= LEAST_COSINE
            np.fill_diagonal(near, False)
            if b.column(5)[int(a)].as_py() != p[a]:  # two blocks: pairs within one are another task's
                near &= block[a:z, None] != block[None, a:z]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            own = codes(x)
            first = (own[i] == own[j]).argmax(axis=1) == tab[a]
            links = np.bincount(i[first], weights=copies[a:z][j[first]], minlength=z - a).astype(np.int64)
            root = reps[a:z].copy()
            while True:
                new = root.copy()
                np.minimum.at(new, i, root[j])
                if (new == root).all():
                    break
                root = new
            some = (links > 0) | (root != reps[a:z])
            yield pa.record_batch([pa.array(reps[a:z][some]), pa.array(links[some]), pa.array(root[some])], ["rep", "links", "root"])


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row: key, n_links, component_id, kept.

    Rows whose key, label or vector is null, or whose vector is empty, zero or holds null or non-finite numbers, link with
    nothing; their component is their key and they are kept (a null key has neither). Vectors of different widths don't
    link. Repeated rows are vectors of their own with the same id. Other columns are left out.
    """
    x = rows.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec")
    )
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.forall("vec", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), F.lit(False))
        & F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False))
    )
    x = x.withColumn("sound", sound & ~F.exists("vec", F.isnan))
    good = x.where("sound")
    classes = materialize(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    placed = classes.select("label", "rep", "copies", "vec").mapInArrow(
        place, "label string, width int, tab int, code long, rep long, copies long, vec array<double>"
    )
    bucket = ["label", "width", "tab", "code"]
    large = materialize(placed.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    dealt = (
        placed.join(large, bucket, "left")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*bucket, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "rep", "copies", "block", "vec")
    )
    task = [*bucket, "p", "q"]
    found = materialize(
        dealt.repartition(*task).sortWithinPartitions(*task, "rep").mapInArrow(compare, "rep long, links long, root long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = materialize(
        classes.join(links, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            "label", "vec",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = good.join(per_class, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = x.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).select(
        F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
