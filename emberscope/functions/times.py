"""Timestamps: parsing of the text forms found in snapshots, differences, clock text."""

from __future__ import annotations

# The accepted text forms.  Anything else is NULL.
_DATE = r"\d{4}-\d{2}-\d{2}"
_TIME = r"\d{2}:\d{2}:\d{2}(\.\d+)?"
WITH_OFFSET = rf"^{_DATE}T{_TIME}(Z|[+-]\d{{2}}:\d{{2}})$"
SPACED_WITH_OFFSET = rf"^{_DATE} {_TIME}[+-]\d{{2}}:?\d{{2}}$"
NAIVE_UTC = rf"^{_DATE}T{_TIME}(GMT)?$"


def parse_time(text: str) -> str:
    """Text to timestamp.  Naive and ``GMT`` forms are UTC whatever the session zone."""
    return (
        f"CASE WHEN {text} RLIKE r'{WITH_OFFSET}' OR {text} RLIKE r'{SPACED_WITH_OFFSET}'"
        f" THEN try_to_timestamp({text})"
        f" WHEN {text} RLIKE r'{NAIVE_UTC}'"
        f" THEN try_to_timestamp(concat(regexp_replace({text}, 'GMT$', ''), 'Z')) END"
    )


def elapsed_ms(start: str, end: str) -> str:
    """Milliseconds from start to end, NULL if either is missing."""
    return f"(unix_millis({end}) - unix_millis({start}))"


def clock_text(ts: str) -> str:
    """UTC ``HH:mm:ss`` or ``-``, independent of the session time zone."""
    second = f"pmod(unix_seconds({ts}), 86400)"
    parts = (f"{second} div 3600", f"{second} % 3600 div 60", f"{second} % 60")
    two_digits = ", ':', ".join(f"lpad({part}, 2, '0')" for part in parts)
    return f"coalesce(concat({two_digits}), '-')"
