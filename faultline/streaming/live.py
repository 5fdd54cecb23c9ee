"""Live detection: each micro-batch is landed, then the batch detectors run over a short lookback.

The detectors are the batch ones, so a hot service or trace is split as it is there; no state is
held in a task. What is kept between batches are tables: landed events (see `landing`), annotated results, silence,
known cascade pairs. A batch that is run again replaces its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from faultline.operators.align import with_seq
from faultline.plans.correlate import Detected, Settings, annotate, detect
from faultline.schema import cell_of, present
from faultline.session import materialize, scratch
from faultline.sources.sinks import write_results
from faultline.streaming.landing import Landing, Manifest

DAY_US = 86_400_000_000


def with_lateness(df: DataFrame, flush_ms: int = 500) -> DataFrame:
    """Let events be late by `flush_ms`; stateful operators then see time pass that much later."""
    return df.withWatermark("ts", f"{flush_ms} milliseconds")


@dataclass(frozen=True)
class LiveTables:
    """Folders of one live run, in shared storage."""

    root: str

    @property
    def results(self) -> str:
        return f"{self.root}/results"

    @property
    def json(self) -> str:
        return f"{self.root}/json"

    @property
    def silence(self) -> str:
        return f"{self.root}/silence"

    @property
    def pairs(self) -> str:
        return f"{self.root}/pairs"


@dataclass(frozen=True)
class Arrivals:
    """What came with a batch: rows, rows behind the newest event before it by more than the flush time, and what was read for each
    part that was judged: (first, last) time in microseconds and number of files."""

    batch: int
    rows: int
    late: int
    reads: tuple[tuple[int, int, int], ...] = ()


def _put(df: DataFrame, path: str, batch: int) -> None:
    """Write the rows of a batch; the same batch written again takes the place of the first try, also if it has no rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def lookback_us(settings: Settings) -> int:
    """How far before a batch its detection reads: twice the longest span in use."""
    return 2 * max(
        settings.window_ms * 1000, settings.baseline_us, settings.silence_us or settings.baseline_us
    )


def _numbered(batch: DataFrame, seq: str, base: int) -> tuple[DataFrame, int]:
    """Rows numbered from `base` on without gaps, in the order of with_seq; and the number after the last."""
    placed = with_seq(batch)
    part = F.shiftright("seq", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(base)
        base += sizes.get(p, 0)
    if not starts:
        return placed.withColumn(seq, F.col("seq")), base
    ahead = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), (part + 1).cast("int"))
    return placed.withColumn(seq, ahead + F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))), base


def _parts(slots: list[int]) -> list[list[int]]:
    """The slots a batch has rows of: those up to the newest without a gap, and all older ones by themselves."""
    cut = len(slots) - 1
    while cut > 0 and slots[cut] - slots[cut - 1] <= 1:
        cut -= 1
    return [part for part in (slots[cut:], slots[:cut]) if part]


def _judge(
    recent: DataFrame, mine: DataFrame, settings: Settings, seq: str, low: int, high: int
) -> tuple[DataFrame, DataFrame | None]:
    """Signals (service, t, s, ...) of the rows `mine` among `recent`, and their silence."""
    found = detect(recent, settings, seq)
    # A position is (service, ts, seq): sources that number their own rows may share (ts, seq).
    places = mine.select(
        present("service").alias("m_service"), F.unix_micros("ts").alias("m_t"), F.col(seq).cast("bigint").alias("m_s")
    ).distinct()
    here = (F.col("t") == F.col("m_t")) & (F.col("s") == F.col("m_s"))
    signals = found.signals.join(places, here & F.col("service").eqNullSafe(F.col("m_service")), "left_semi")
    silence = found.silence
    if silence is not None:
        told_at = places.select("m_t", "m_s")
        by_event = settings.silence_check == "events"
        silence = silence.join(told_at, here, "left_semi") if by_event else silence.where(F.col("t").between(low, high))
    return signals, silence


def process_batch(
    batch: DataFrame,
    number: int,
    tables: LiveTables,
    settings: Settings,
    seq: str = "seq",
    flush_ms: int = 500,
    retain_us: int = 30 * DAY_US,
    json: bool = False,
) -> Arrivals:
    """Land one micro-batch and write its annotated rows and silence signals; with `json` also as sorted JSON lines.

    Late events are not dropped: they are counted, and judged when they come, against everything landed so far. Those
    more than a lookback behind the others are judged on their own short ranges, so that they don't widen the read of the rest.
    Rows already written are not revised. A burst that began before the lookback, or a trace whose
    first error is older, is seen as starting at its first event inside the lookback. Landed events are kept for `retain_us`.
    """
    spark = batch.sparkSession
    lookback = lookback_us(settings)
    landing = Landing(spark, tables.root, lookback)
    with scratch(spark):
        before = landing.before(number)
        next_seq = before.next_seq
        if seq not in batch.columns:  # numbers of later batches are larger
            batch, next_seq = _numbered(batch, seq, next_seq)
        t = F.unix_micros("ts")
        behind = F.lit(False) if before.high_us is None else t < before.high_us - flush_ms * 1000
        seen = Observation(f"arrivals-{number}")
        watched = batch.observe(seen, F.count("*").alias("rows"), F.count_if(behind).alias("late"))
        own = landing.land(watched, number)
        arrived = seen.get
        schema = StructType([*batch.schema.fields, StructField("batch", IntegerType())])
        now = replace(before, batch=number, next_seq=next_seq, rows=arrived["rows"], late=arrived["late"], dropped=[])
        reads = []
        if own:
            reads = _detect_batch(landing, before, now, own, schema, tables, settings, seq, json)
            live, given_up = landing.merge(before.folders + own, number, schema)
            live, old = landing.retire(live, now.high_us, retain_us)
            now.folders, now.dropped = live, now.dropped + given_up + old
        landing.commit(now, before)
    return Arrivals(number, now.rows, now.late, tuple(reads))


def _detect_batch(
    landing: Landing,
    before: Manifest,
    now: Manifest,
    own: list,
    schema: StructType,
    tables: LiveTables,
    settings: Settings,
    seq: str,
    json: bool,
) -> list[tuple[int, int, int]]:
    """Detect over the rows just landed; sets the new high mark, log start and known pairs of the manifest `now`."""
    spark, number, width = landing.spark, now.batch, landing.slot_us
    mine = landing.rows(own, schema)
    t = F.unix_micros("ts")
    spans = {
        r["slot"]: (r["low"], r["high"])
        for r in mine.groupBy(cell_of(t, width).alias("slot")).agg(F.min(t).alias("low"), F.max(t).alias("high")).collect()
    }
    now.high_us = max([h for _, h in spans.values()] + ([] if before.high_us is None else [before.high_us]))
    if now.start_us is None:
        now.start_us = min(low for low, _ in spans.values())
    timed = replace(settings, log_start_us=now.start_us)
    lookback = lookback_us(settings)

    signals, silences, reads = None, [], []
    for slots in _parts(sorted(spans)):
        # The newest part is one range; each slot of the older part has its own.
        ranges = [(spans[slots[0]][0] - lookback, spans[slots[-1]][1])] if max(slots) == max(spans) else [
            (spans[x][0] - lookback, spans[x][1]) for x in slots
        ]
        wanted = [f for f in before.folders + own if any(a // width <= f.slot <= z // width for a, z in ranges)]
        inside = F.lit(False)
        for a, z in ranges:
            inside = inside | t.between(a, z)
        recent = landing.rows(wanted, schema).where(inside)
        part = landing.rows([f for f in own if f.slot in slots], schema)
        found, quiet = _judge(recent, part, timed, seq, spans[slots[0]][0], spans[slots[-1]][1])
        signals = found if signals is None else signals.unionByName(found)
        if quiet is not None:
            silences.append(quiet)
        reads.append((ranges[0][0], ranges[-1][1], len(recent.inputFiles())))

    # A pair is new at its first error in this batch, unless an earlier batch had the pair.
    pairs = signals.where(F.col("cascade_from").isNotNull()).groupBy("cascade_from", "service").agg(
        F.min(F.struct("t", "s")).alias("first")
    )
    known = spark.read.schema("cascade_from string, service string").parquet(f"{landing.root}/{before.known}") if before.known else None
    if known is not None:
        pairs = pairs.join(known, ["cascade_from", "service"], "left_anti")
    pairs = materialize(pairs.select("cascade_from", "service", "first.t", "first.s"))
    _put(pairs, tables.pairs, number)
    if not pairs.isEmpty():
        now.known = f"known/{number}"
        fresh = pairs.select("cascade_from", "service")
        (fresh if known is None else fresh.unionByName(known)).coalesce(1).write.mode("overwrite").parquet(f"{landing.root}/{now.known}")
        if before.known:
            now.dropped.append(before.known)
    new = pairs.select(
        F.col("service").alias("p_service"), F.col("t").alias("p_t"), F.col("s").alias("p_s"), F.lit(True).alias("is_new")
    )
    at_pair = (F.col("t") == F.col("p_t")) & (F.col("s") == F.col("p_s")) & (F.col("service") == F.col("p_service"))
    signals = signals.drop("new_cascade").join(new, at_pair, "left").select(
        "service", "t", "s", "signal_type", "cascade_from", F.coalesce("is_new", F.lit(False)).alias("new_cascade")
    )
    silence = None
    if silences:
        silence = silences[0]
        for more in silences[1:]:
            silence = silence.unionByName(more)
        _put(silence, tables.silence, number)
    annotated = annotate(mine.drop("batch"), Detected(signals, silence), seq)
    _put(annotated, tables.results, number)
    if json:
        write_results(spark.read.schema(annotated.schema).parquet(f"{tables.results}/batch={number}"), f"{tables.json}/batch={number}", "overwrite", seq)
    return reads


def write_stream(
    events: DataFrame,
    root: str,
    checkpoint: str,
    settings: Settings = Settings(),
    seq: str = "seq",
    flush_ms: int = 500,
    retain_us: int = 30 * DAY_US,
    json: bool = False,
    on_batch: Callable[[Arrivals], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Run live detection over a stream of events; results land under `root` (see LiveTables).

    `on_batch` is told what came with each batch. Give it the stream of `reorder.reorder` to have late events wait for in place of
    being judged when they come.
    """
    tables = LiveTables(root)

    def run(df: DataFrame, number: int) -> None:
        arrived = process_batch(df, number, tables, settings, seq, flush_ms, retain_us, json)
        if on_batch is not None:
            on_batch(arrived)

    return (
        events.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
