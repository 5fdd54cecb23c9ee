"""Timestamps out of log text, and time arguments."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number can be large only with ten digits or an exponent.
_LONG_NUMBER = r"^\s*[+-]?(?:[\d.]{10}|[\d.]+[eE])"
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"
_LOCAL = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})((?:[.,]\d+)?)$"
_SLASHED = r"^(\d{4})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2})((?:[.,]\d+)?)$"
_ACCESS_LOG = r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"

# A leading number above the first is epoch seconds, above the second milliseconds.
EPOCH_SECONDS_ABOVE = 1e9
EPOCH_MILLIS_ABOVE = 1e12


def parse_iso(text: Column | str) -> Column:
    """RFC3339 with any fraction; a zone is required."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(
        F.regexp_like(text, F.lit(_ZONED)),
        F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"),
    )


def _as_utc(text: Column, pattern: str, iso: str) -> Column:
    """Rewrite a matching zoneless text to ISO in UTC and cast it."""
    rewritten = F.replace(F.regexp_replace(text, pattern, iso), F.lit(","), F.lit("."))
    return F.when(F.regexp_like(text, F.lit(pattern)), rewritten.try_cast("timestamp"))


def _epoch(text: Column) -> Column:
    """Time of a text that starts with a large number."""
    number = F.regexp_extract(text, _NUMBER, 1).try_cast("double")
    whole = number.try_cast("bigint")
    return F.when(number > EPOCH_MILLIS_ABOVE, F.timestamp_millis(whole)).when(
        number > EPOCH_SECONDS_ABOVE, F.timestamp_seconds(whole)
    )


def parse_timestamp(text: Column | str) -> Column:
    """Timestamp of a log's time text, NULL if none of the known forms fits.

    A number at the start counts as epoch seconds or milliseconds if it is large enough. Without a
    zone the time is UTC, whatever the session zone is. Words are told apart by their first
    character, so text without a time costs next to nothing.
    """
    text = F.col(text) if isinstance(text, str) else text
    other = F.coalesce(
        _as_utc(text, _LOCAL, "$1T$2$3Z"),
        _as_utc(text, _SLASHED, "$1-$2-$3T$4$5Z"),
        F.when(
            F.regexp_like(text, F.lit(_ACCESS_LOG)),
            F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        ),
    )
    # Every form starts with a digit, or for numbers with white space, a sign or a point.
    return F.when(
        F.ascii(text) <= ord("9"),
        F.when(F.regexp_like(text, F.lit(_ZONED)), parse_iso(text)).otherwise(
            F.when(
                F.regexp_like(text, F.lit(_LONG_NUMBER)), F.coalesce(_epoch(text), other)
            ).otherwise(other)
        ),
    )


_DURATION_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")
_UNIT_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(text: str) -> timedelta:
    """`1h30m`, `500ms`, `-2s`; the whole text must be number-unit pairs."""
    sign = -1 if text.startswith("-") else 1
    body = text.lstrip("+-") if text[:1] in "+-" else text
    parts = _DURATION_PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=sign * sum(float(n) * _UNIT_SECONDS[u] for n, u in parts))


def resolve_time(argument: str | None, now: datetime) -> datetime | None:
    """`15m`, `1h`, `30s` before `now`, or an RFC3339 time; None when nothing is given."""
    if not argument:
        return None
    if argument[-1] in "mhs":
        try:
            return now - parse_duration(argument)
        except ValueError:
            pass
    match = re.fullmatch(
        r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:\d{2})", argument
    )
    if match:
        base, fraction, zone = match.groups()
        when = datetime.fromisoformat(base + ("+00:00" if zone == "Z" else zone))
        return when.astimezone(timezone.utc) + timedelta(
            microseconds=int(((fraction or "") + "000000")[:6])
        )
    raise ValueError(f"not a time: {argument!r} (use 15m, 1h or 2024-01-01T00:00:00Z)")
