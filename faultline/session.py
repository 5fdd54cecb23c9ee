"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "faultline", master: str | None = None, partitions: int | None = None):
    """A UTC session with adaptive execution; on a cluster the submit settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-"))
    return spark.sparkContext.getCheckpointDir()


#: Tables written since the innermost `scratch` began; None outside.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `materialize` writes inside, at the end; for work that repeats for ever."""
    token = _written.set([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _written.get():
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        _written.reset(token)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Cuts the lineage so a lost executor re-reads files instead of replaying the plan, runs the plan
    once however often the result is used, and gives the optimizer the true size: a join with the
    result is broadcast only if its files are below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, *builds: Callable[[], DataFrame]) -> list[DataFrame]:
    """Build independent tables at the same time, so their jobs can share the cluster."""
    with ThreadPoolExecutor(len(builds)) as pool:
        runs = [pool.submit(copy_context().run, inheritable_thread_target(spark)(b)) for b in builds]
        return [r.result() for r in runs]
