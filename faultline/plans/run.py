"""A whole run in one call: configured sources in, results and a summary out."""

from __future__ import annotations

import time

from pyspark.sql import Row, SparkSession

from faultline.operators.align import services_filter, signal_only
from faultline.operators.report import run_summary
from faultline.plans.correlate import Settings, annotate, detect
from faultline.session import materialize, scratch
from faultline.sources.configured import SourceSpec, read_sources
from faultline.sources.sinks import write_results


def run(
    spark: SparkSession,
    specs: list[SourceSpec],
    out: str,
    settings: Settings = Settings(),
    since=None,
    until=None,
    services: list[str] | None = None,
    signals_only: bool = False,
) -> Row:
    """Read the sources, detect, write the results as JSON lines in order, and tell how it went.

    `services` and `signals_only` cut down what is written, after detection, so the others still count as origins. The summary is of all
    events: signals, noise, silence_signals, sources, events, and elapsed_ms of the whole run. Tables on the way are deleted.
    """
    began = time.monotonic()
    with scratch(spark):
        events = read_sources(spark, specs, since, until)
        found = detect(events, settings)
        annotated = materialize(annotate(events, found))
        shown = annotated if services is None else services_filter(annotated, services)
        write_results(signal_only(shown) if signals_only else shown, out)
        summary = run_summary(annotated, found.silence).first().asDict()
    return Row(**summary, elapsed_ms=int((time.monotonic() - began) * 1000))
