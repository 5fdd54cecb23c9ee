"""Text forms of event parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schema import present


def display_name(show_service: bool = True) -> Column:
    """The service, or the source where there is none or services are not shown."""
    return F.coalesce(present("service"), F.col("source")) if show_service else F.col("source")


def render_time(ts: Column | str = "ts", mode: str = "relative") -> Column:
    """`absolute`, `unix` (milliseconds) or the clock time for any other mode."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if mode == "absolute":
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    if mode == "unix":
        return F.unix_millis(ts).cast("string")
    return F.date_format(ts, "HH:mm:ss.SSS")


def render_rfc3339(ts: Column | str = "ts") -> Column:
    """UTC with the fraction cut after its last non-zero digit."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.rtrim(F.date_format(utc, ".SSSSSS"), F.lit("0"))
    return F.concat(whole, F.when(fraction == ".", F.lit("")).otherwise(fraction), F.lit("Z"))


def quoted(text: Column) -> Column:
    """The text in double quotes with backslash, quote and control characters escaped."""
    # Escapes inside a quoted text.
    for raw, escaped in (
        ("\\", "\\\\"),
        ('"', '\\"'),
        ("\n", "\\n"),
        ("\r", "\\r"),
        ("\t", "\\t"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def render_fields(fields: Column | str = "fields") -> Column:
    """`key="value"` pairs joined by a space, by key."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    pairs = F.transform(
        F.array_sort(F.map_entries(fields)),
        lambda e: F.concat(e["key"], F.lit("="), quoted(F.coalesce(e["value"], F.lit("")))),
    )
    return F.array_join(pairs, " ")
