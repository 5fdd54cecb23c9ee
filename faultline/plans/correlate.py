"""The whole run: all three detectors over one event table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.anomaly import find_anomalies
from faultline.operators.cascade import attach, cascade_origins, error_table, mark_new
from faultline.operators.silence import detect_silence
from faultline.schema import SILENCE_TYPE
from faultline.session import materialize, side_by_side


@dataclass(frozen=True)
class Settings:
    """Detector settings. The defaults."""

    window_ms: int = 5000
    anomaly_multiplier: float = 10.0
    baseline_us: int = 300_000_000
    silence_us: int | None = None  # the baseline span, unless set
    silence_threshold_pct: float = 90.0
    cascades: bool = True
    silence: bool = True
    silence_check: str = "events"
    tick_us: int = 1_000_000
    log_start_us: int | None = None  # first event of the log, if it is not in the table


def _as_signals(found: DataFrame, rank: int, *, cascade: bool) -> DataFrame:
    none = F.lit(None).cast("string")
    return found.select(
        "service",
        "t",
        "s",
        F.lit(rank).alias("rank"),
        (F.col("cascade_from") if cascade else none).alias("cascade_from"),
        (F.col("new_cascade") if cascade else F.lit(False)).alias("new_cascade"),
    )


def _merge_signals(anomalies: DataFrame, cascades: DataFrame | None) -> DataFrame:
    """One signal per error; an error that is both an anomaly and a cascade counts as a cascade."""
    found = _as_signals(anomalies, 0, cascade=False)
    if cascades is not None:
        found = found.unionByName(_as_signals(cascades, 1, cascade=True))
    return (
        found.groupBy("service", "t", "s")
        .agg(F.max(F.struct("rank", "cascade_from", "new_cascade")).alias("b"))
        .select(
            "service",
            "t",
            "s",
            F.when(F.col("b.rank") == 1, "cascade").otherwise("anomaly").alias("signal_type"),
            F.col("b.cascade_from").alias("cascade_from"),
            F.col("b.new_cascade").alias("new_cascade"),
        )
    )


@dataclass(frozen=True)
class Detected:
    """Signals by position (service, t, s, signal_type, cascade_from, new_cascade), and silence."""

    signals: DataFrame
    silence: DataFrame | None


def detect(events: DataFrame, settings: Settings = Settings(), seq: str = "seq") -> Detected:
    """Run the detectors that are on, side by side, and keep what they find as written tables."""

    def anomalies() -> DataFrame:
        return find_anomalies(
            events, settings.baseline_us, settings.anomaly_multiplier, seq, errors
        )

    def cascades() -> DataFrame:
        return mark_new(materialize(cascade_origins(events, settings.window_ms, seq, errors)))

    def silences() -> DataFrame:
        return materialize(
            detect_silence(
                events,
                settings.silence_us or settings.baseline_us,
                settings.silence_threshold_pct,
                check=settings.silence_check,
                tick_us=settings.tick_us,
                log_start_us=settings.log_start_us,
                seq=seq,
            )
        )

    errors = error_table(events, seq)
    builds = {"anomaly": anomalies}
    if settings.cascades:
        builds["cascade"] = cascades
    if settings.silence:
        builds["silence"] = silences
    built = dict(zip(builds, side_by_side(events.sparkSession, *builds.values())))
    signals = materialize(_merge_signals(built["anomaly"], built.get("cascade")))
    return Detected(signals, built.get("silence"))


def annotate(events: DataFrame, detected: Detected, seq: str = "seq") -> DataFrame:
    """The events with is_signal, signal_type, cascade_from, new_cascade and silence.

    Silence found by ticks belongs to no event; then the column is NULL and the table is the result.
    """
    out = attach(events, detected.signals, seq).withColumns(
        {
            "is_signal": F.col("signal_type").isNotNull(),
            "new_cascade": F.coalesce("new_cascade", F.lit(False)),
        }
    )
    if detected.silence is None:
        return out.withColumn("silence", F.lit(None).cast(SILENCE_TYPE))
    # At most one entry per service at one event.
    told = (
        detected.silence.where(F.col("s").isNotNull())
        .groupBy(F.timestamp_micros("t").alias("q_ts"), F.col("s").alias("q_s"))
        .agg(
            F.sort_array(
                F.collect_list(F.struct("service", "drop_pct", "baseline_rate", "current_rate"))
            ).alias("silence")
        )
    )
    return out.join(
        told, (F.col("ts") == F.col("q_ts")) & (F.col(seq).cast("bigint") == F.col("q_s")), "left"
    ).drop("q_ts", "q_s")


def correlate(events: DataFrame, settings: Settings = Settings(), seq: str = "seq") -> DataFrame:
    """Detect and annotate in one go."""
    return annotate(events, detect(events, settings, seq), seq)


def signal_history(annotated: DataFrame, silence: DataFrame | None = None) -> DataFrame:
    """Signals as a table to append to: ts, signal_type, service, cascade_from, detail."""
    rows = annotated.where("is_signal").select(
        "ts", "signal_type", "service", "cascade_from", F.col("message").alias("detail")
    )
    if silence is None:
        return rows
    return rows.unionByName(
        silence.select(
            F.timestamp_micros("t").alias("ts"),
            F.lit("silence").alias("signal_type"),
            "service",
            F.lit(None).cast("string").alias("cascade_from"),
            F.concat(F.round("drop_pct", 1).cast("string"), F.lit("%")).alias("detail"),
        )
    )
