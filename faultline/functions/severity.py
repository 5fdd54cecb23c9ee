"""Severity text to level and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import schema as sv

# Spellings of each level. Only all-upper and all-lower forms are known.
_SPELLINGS = {
    sv.TRACE: ("trace",),
    sv.DEBUG: ("debug",),
    sv.INFO: ("info", "information"),
    sv.WARN: ("warn", "warning"),
    sv.ERROR: ("error", "err"),
    sv.FATAL: ("fatal", "critical"),
}
_DATADOG = {
    sv.ERROR: ("emergency", "alert", "critical", "error"),
    sv.WARN: ("warning", "warn"),
    sv.INFO: ("notice", "info"),
    sv.DEBUG: ("debug",),
}
_GOOGLE = {
    sv.ERROR: ("EMERGENCY", "ALERT", "CRITICAL", "ERROR"),
    sv.WARN: ("WARNING",),
    sv.INFO: ("NOTICE", "INFO", "DEFAULT"),
    sv.DEBUG: ("DEBUG",),
}


def _level(text: Column, spellings: dict[int, tuple[str, ...]], otherwise: int) -> Column:
    # A lookup in a constant map: the text is worked out once, and the code stays small.
    pairs = [F.lit(x) for level, words in spellings.items() for w in words for x in (w, level)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), F.lit(otherwise)).cast("int")


def parse_severity(text: Column | str) -> Column:
    """Level of a log's own severity word; mixed case such as `Error` is UNKNOWN."""
    text = F.col(text) if isinstance(text, str) else text
    both = {level: words + tuple(w.upper() for w in words) for level, words in _SPELLINGS.items()}
    return _level(text, both, sv.UNKNOWN)


def parse_severity_datadog(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return _level(text, _DATADOG, sv.INFO)


def parse_severity_google(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return _level(F.upper(text), _GOOGLE, sv.INFO)


def severity_text(level: Column | str = "severity") -> Column:
    level = F.col(level) if isinstance(level, str) else level
    label = F.lit(sv.SEVERITY_LABELS[sv.UNKNOWN])
    for value, name in sv.SEVERITY_LABELS.items():
        if value != sv.UNKNOWN:
            label = F.when(level == value, F.lit(name)).otherwise(label)
    return label
