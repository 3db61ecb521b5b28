"""Number and name texts."""

from __future__ import annotations

# The size and count suffixes and the prefix put before stage names
# by remote sessions.
BYTE_UNITS = ((1024, "KB"), (1024**2, "MB"), (1024**3, "GB"), (1024**4, "TB"))
COUNT_UNITS = ((10**3, "K"), (10**6, "M"), (10**9, "B"))
NOT_AVAILABLE = "N/A"
REMOTE_STAGE_PREFIX = "Spark Connect - session_id: "
REMOTE_STAGE_SEPARATOR = '" - '


def lit(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fill(template: str, *values: str) -> str:
    """Put expressions into the ``{}`` places of a text."""
    parts: list[str] = []
    for i, piece in enumerate(template.split("{}")):
        if piece:
            parts.append(lit(piece))
        if i < len(values):
            parts.append(values[i])
    return f"concat({', '.join(parts)})"


def fixed(value: str, digits: int) -> str:
    """Decimal text with ``digits`` places, exact ties to even, no grouping."""
    return f"format_number({value}, '{'0.' + '0' * digits if digits else '0'}')"


def whole(value: str) -> str:
    return fixed(f"cast({value} as double)", 0)


def percent(ratio: str) -> str:
    return f"concat({fixed(f'({ratio}) * 100D', 0)}, '%')"


def duration_text(ms: str) -> str:
    """``450ms``, ``1.5s``, ``1m 30s``, ``1h 1m``; negative gives N/A."""
    ms = f"({ms})"
    return (
        f"CASE WHEN {ms} < 0 THEN '{NOT_AVAILABLE}'"
        f" WHEN {ms} < 1000 THEN concat({ms}, 'ms')"
        f" WHEN {ms} < 60000 THEN concat({ms} div 1000,"
        f" if({ms} % 1000 > 0, concat('.', {ms} % 1000 div 100), ''), 's')"
        f" WHEN {ms} < 3600000 THEN concat({ms} div 60000, 'm ', {ms} div 1000 % 60, 's')"
        f" WHEN {ms} IS NOT NULL THEN concat({ms} div 3600000, 'h ', {ms} div 60000 % 60, 'm') END"
    )


def _scaled(value: str, plain: str, units: tuple[tuple[int, str], ...], gap: str) -> str:
    value = f"({value})"
    branches = [
        f"WHEN {value} < 0 THEN '{NOT_AVAILABLE}'",
        f"WHEN {value} < {units[0][0]} THEN concat({value}, '{plain}')",
    ]
    for (scale, unit), (limit, _) in zip(units, [*units[1:], (None, "")]):
        when = f"{value} < {limit}" if limit else f"{value} IS NOT NULL"
        branches.append(f"WHEN {when} THEN concat({fixed(f'{value} / {scale}D', 1)}, '{gap}{unit}')")
    return f"CASE {' '.join(branches)} END"


def bytes_text(size: str) -> str:
    """``512 B``, ``1.5 KB`` up to TB; negative gives N/A."""
    return _scaled(size, " B", BYTE_UNITS, " ")


def bytes_or_dash(size: str) -> str:
    return f"if({size} > 0, {bytes_text(size)}, '-')"


def count_text(records: str) -> str:
    """``999``, ``1.5K``, ``1.5M``, ``2.5B``; negative gives N/A."""
    return _scaled(records, "", COUNT_UNITS, "")


def shorten(text: str, limit: int) -> str:
    """Cut to ``limit``: the limit is tested in bytes, the cut is made in characters."""
    cut = f"left({text}, {limit})" if limit <= 3 else f"concat(left({text}, {limit - 3}), '...')"
    return f"if(octet_length({text}) <= {limit}, {text}, {cut})"


def strip(text: str) -> str:
    """Trim all white space, not only blanks."""
    return f"regexp_replace({text}, r'(?U)^\\s+|\\s+$', '')"


def one_line(text: str) -> str:
    """Line breaks and tabs become one space each."""
    return f"translate({text}, '\\n\\r\\t', '   ')"


def printable(text: str) -> str:
    """Tabs become four spaces, other control characters vanish."""
    return f"regexp_replace(replace({text}, '\\t', '    '), r'\\p{{Cc}}', '')"


def stage_label(name: str) -> str:
    """The code location behind a remote session prefix, else the name itself."""
    rest = f"substr({name}, {len(REMOTE_STAGE_PREFIX) + 1})"
    found = f"instr({rest}, {lit(REMOTE_STAGE_SEPARATOR)})"
    tail = f"substr({rest}, {found} + {len(REMOTE_STAGE_SEPARATOR)})"
    return (
        f"if(startswith({name}, {lit(REMOTE_STAGE_PREFIX)}) AND {found} > 0 AND length({tail}) > 0,"
        f" {strip(tail)}, {name})"
    )


def cpu_millis(cpu_ns: str) -> str:
    return f"({cpu_ns} div 1000000)"


def cpu_ratio(cpu_ns: str, run_ms: str) -> str:
    """Share of the run time spent on CPU: whole milliseconds over run time, NULL at 0."""
    return f"({cpu_millis(cpu_ns)} / nullif({run_ms}, 0))"


def whole_div(value: str, divisor: str) -> str:
    """Integer division; NULL when the divisor is 0."""
    return f"({value} div nullif({divisor}, 0))"


def ratio(value: str, divisor: str) -> str:
    """Division in doubles; NULL when the divisor is 0."""
    return f"(cast({value} as double) / nullif({divisor}, 0))"
