"""Source types by name. A normaliser is any function from landed rows to event rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from faultline.sources import lines, payloads

Normaliser = Callable[..., DataFrame]

# Source type names.
_NORMALISERS: dict[str, Normaliser] = {
    "file": lines.normalize_lines,
    "loki": payloads.normalize_loki,
    "elasticsearch": payloads.normalize_es,
    "cloudwatch": payloads.normalize_cloudwatch,
    "datadog": payloads.normalize_datadog,
    "googlecloud": payloads.normalize_gcl,
    "gcp": payloads.normalize_gcl,
}


def register(kind: str, normaliser: Normaliser) -> None:
    """Add a source type; it must return the event schema."""
    _NORMALISERS[kind] = normaliser


def normaliser_for(kind: str) -> Normaliser:
    """The normaliser of a source type; an unknown type reads as line logs."""
    return _NORMALISERS.get(kind, lines.normalize_lines)


def normalize(df: DataFrame, kind: str, source: str, **options) -> DataFrame:
    return normaliser_for(kind)(df, source, **options)
