"""Health bands: which measures look fine, which need attention."""

from __future__ import annotations

from emberscope.model import GB, MB

# Ascending lower bounds with the band that starts there.
IO_BANDS = ((1, "muted"), (100 * MB, "ok"), (GB, "warning"), (10 * GB, "critical"))
SHUFFLE_BANDS = ((100 * MB, "warning"), (500 * MB, "critical"))
SPILL_BANDS = ((1, "warning"), (GB, "critical"))
CPU_BANDS = (("0.3D", "warning"), ("0.5D", "ok"), ("0.95D", "critical"))
MEMORY_SHARE_BANDS = (("0.1D", "ok"), ("0.5D", "warning"), ("0.8D", "critical"))
MEMORY_BYTES_BANDS = ((100 * MB, "ok"), (GB, "warning"), (10 * GB, "critical"))


def _band(value: str, steps, below: str) -> str:
    branches = " ".join(f"WHEN {value} >= {bound} THEN '{name}'" for bound, name in reversed(steps))
    return f"CASE {branches} ELSE '{below}' END"


def io_band(size: str) -> str:
    return _band(size, IO_BANDS, "default")


def shuffle_band(size: str) -> str:
    return _band(size, SHUFFLE_BANDS, "default")


def spill_band(size: str) -> str:
    return _band(size, SPILL_BANDS, "default")


def cpu_band(share: str) -> str:
    """Saturated and starved are both critical."""
    return _band(share, CPU_BANDS, "critical")


def memory_band(peak: str, cluster_memory: str) -> str:
    """Share of the cluster memory; absolute sizes where that is unknown."""
    share = f"(cast({peak} as double) / nullif({cluster_memory}, 0))"
    return (
        f"if({cluster_memory} > 0, {_band(share, MEMORY_SHARE_BANDS, 'default')},"
        f" {_band(peak, MEMORY_BYTES_BANDS, 'default')})"
    )
