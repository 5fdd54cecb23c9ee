"""What is told about the annotated stream: edges, chains, summary, source health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.scan import Run, running


def cascade_edges(annotated: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (cascade_from, service): first_ts, first_seq and the number of errors."""
    return (
        annotated.where(F.col("cascade_from").isNotNull())
        .groupBy("cascade_from", "service")
        .agg(F.min(F.struct("ts", F.col(seq).alias("seq"))).alias("f"), F.count("*").alias("errors"))
        .select(
            "cascade_from",
            "service",
            F.col("f.ts").alias("first_ts"),
            F.col("f.seq").alias("first_seq"),
            "errors",
        )
    )


def chain_steps(edges: DataFrame) -> DataFrame:
    """Edges in order of discovery, grouped to chains: chain_id, hop, cascade_from, service, first_ts.

    An edge extends the chain if it starts where the edge before it ended; else a new chain starts.
    """
    order = ["first_ts", "first_seq"]
    linked = running(edges, [], order, {"before": Run("prev", "service")})
    starts = F.when(F.col("before") == F.col("cascade_from"), F.lit(0)).otherwise(F.lit(1))
    numbered = running(
        linked.withColumn("starts", starts),
        [],
        order,
        {"chain_id": Run("sum", "starts"), "place": Run("sum", F.lit(1))},
    )
    opened = numbered.where("starts = 1").select(
        F.col("chain_id").alias("c_id"), F.col("place").alias("c_place")
    )
    return numbered.join(opened, F.col("chain_id") == F.col("c_id")).select(
        "chain_id",
        (F.col("place") - F.col("c_place") + 1).alias("hop"),
        "cascade_from",
        "service",
        "first_ts",
        "first_seq",
    )


def cascade_chains(edges: DataFrame) -> DataFrame:
    """The chain as it stands at each new edge: chain_id, hop, first_ts, first_seq, chain.

    A chain has at most one element per distinct edge, whatever the number of events.
    """
    steps = chain_steps(edges)
    whole = steps.groupBy(F.col("chain_id").alias("w_id")).agg(
        F.sort_array(F.collect_list(F.struct("hop", "service"))).alias("links"),
        F.min_by("cascade_from", "hop").alias("root"),
    )
    return steps.join(whole, F.col("chain_id") == F.col("w_id")).select(
        "chain_id",
        "hop",
        "first_ts",
        "first_seq",
        F.concat(
            F.array("root"), F.slice("links.service", F.lit(1), F.col("hop").cast("int"))
        ).alias("chain"),
    )


def run_summary(annotated: DataFrame, silence: DataFrame | None = None) -> DataFrame:
    """One row: signals, noise, silence_signals, sources, events."""
    base = annotated.agg(
        F.count_if("is_signal").alias("signals"),
        F.count_if(~F.col("is_signal")).alias("noise"),
        F.count_distinct("source").alias("sources"),
        F.count("*").alias("events"),
    )
    if silence is None:
        return base.withColumn("silence_signals", F.lit(0).cast("bigint"))
    # Both sides are single aggregate rows, put side by side by a constant key.
    quiet = silence.agg(F.count("*").alias("silence_signals")).withColumn("one", F.lit(1))
    return base.withColumn("one", F.lit(1)).join(quiet, "one").drop("one")


def source_health(events: DataFrame, now_us: int, quiet_after_us: int, bad_share: float) -> DataFrame:
    """Per source: events, errors, last seen, events per minute and a state.

    `silent` if nothing came for `quiet_after_us`, `degraded` from `bad_share` errors on, else
    `connected`.
    """
    t = F.unix_micros("ts")
    spans = F.greatest((F.col("last_us") - F.col("first_us")) / 60e6, F.lit(1.0))
    return (
        events.groupBy("source")
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("severity") >= 5).alias("errors"),
            F.min(t).alias("first_us"),
            F.max(t).alias("last_us"),
        )
        .withColumn("per_minute", F.col("events") / spans)
        .withColumn(
            "state",
            F.when(F.lit(now_us) - F.col("last_us") > quiet_after_us, "silent")
            .when(F.col("errors") >= F.col("events") * bad_share, "degraded")
            .otherwise("connected"),
        )
        .drop("first_us")
    )


def suppress(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals that no rule hides. A rule has service, from_ts and to_ts (NULL = no limit)."""
    hit = (
        (F.col("service") == F.col("r_service"))
        & (F.col("ts") >= F.coalesce("r_from", "ts"))
        & (F.col("ts") <= F.coalesce("r_to", "ts"))
    )
    named = rules.select(
        F.col("service").alias("r_service"),
        F.col("from_ts").alias("r_from"),
        F.col("to_ts").alias("r_to"),
    )
    return signals.join(named, hit, "left_anti")
