"""All findings and reports over one telemetry bundle, lazily."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame

from emberscope.model import Telemetry
from emberscope.operators import linking, reports, stage_rules, task_rules
from emberscope.sources import store


@dataclass(frozen=True)
class Inputs:
    """What a detector may read: the telemetry, the wide stage rows, links, names, spreads and totals.

    The wide rows, the names, the spreads of tasks per stage and the totals per stage and executor
    are each computed when a detector first asks for them, once, and written to the shared folder.
    """

    telemetry: Telemetry
    by: tuple[str, ...]
    strict: bool = True

    @cached_property
    def context(self) -> DataFrame:
        t = self.telemetry
        rows = linking.stage_context(t.stages, t.job_stages, t.sql_jobs, t.sql_executions, self.by, self.strict)
        return store.written(stage_rules.with_run_statistics(rows, t.stages, self.by), "stage-context")

    @cached_property
    def names(self) -> DataFrame:
        t = self.telemetry
        links = linking.stage_links(t.job_stages, t.sql_jobs, t.sql_executions, self.by, self.strict)
        return store.written(task_rules.stage_names(t.stages, links, self.by), "stage-names")

    @cached_property
    def spreads(self) -> DataFrame:
        return store.written(task_rules.stage_spreads(self.telemetry.tasks, self.by), "stage-spreads")

    @cached_property
    def totals(self) -> DataFrame:
        return store.written(task_rules.executor_totals(self.telemetry.tasks, self.by), "executor-totals")


Detector = Callable[[Inputs], DataFrame]


def row_findings(inputs: Inputs) -> DataFrame:
    """All rules over single stage rows, in one pass."""
    return stage_rules.stage_findings(inputs.context, list(stage_rules.ROW_RULES.values()), inputs.by)


def repeated_stages(inputs: Inputs) -> DataFrame:
    return stage_rules.cache_opportunities(inputs.context, inputs.by)


def skew_findings(inputs: Inputs) -> DataFrame:
    dists = task_rules.distributions(None, inputs.by, spreads=inputs.spreads)
    return task_rules.skew_findings(dists, inputs.names, inputs.by)


def hotspot_findings(inputs: Inputs) -> DataFrame:
    return task_rules.hotspot_findings(None, inputs.names, inputs.by, spreads=inputs.spreads)


# The registry.  Add a function from Inputs to a table with the suspect columns.
DETECTORS: dict[str, Detector] = {
    "stage_rows": row_findings,
    "repeated_stages": repeated_stages,
    "task_skew": skew_findings,
    "executor_hotspots": hotspot_findings,
}


def inputs_of(t: Telemetry, by: Sequence[str] = (), strict: bool = True) -> Inputs:
    return Inputs(t, tuple(by), strict)


def find_suspects(
    t: Telemetry,
    by: Sequence[str] = (),
    strict: bool = True,
    detectors: dict[str, Detector] | None = None,
) -> DataFrame:
    """Findings of all detectors, unsorted."""
    inputs = inputs_of(t, by, strict)
    found = [detect(inputs) for detect in (DETECTORS if detectors is None else detectors).values()]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


@dataclass(frozen=True)
class Report:
    """Everything one refresh shows; each table is made when it is first asked for.

    The findings are needed by several tables, and sorting reads its input twice; they are
    therefore computed once and written to the shared folder unless ``store_findings`` is off.
    """

    telemetry: Telemetry
    by: tuple[str, ...] = ()
    strict: bool = True
    store_findings: bool = True

    NAMES: ClassVar[tuple[str, ...]] = ("suspects", "jobs", "critical_stages", "stage_hints", "health", "cluster")

    @cached_property
    def found(self) -> DataFrame:
        rows = find_suspects(self.telemetry, self.by, self.strict)
        return store.written(rows, "findings") if self.store_findings else rows

    @cached_property
    def suspects(self) -> DataFrame:
        return reports.sort_suspects(self.found, self.by)

    @cached_property
    def jobs(self) -> DataFrame:
        t = self.telemetry
        return reports.job_rows(t.jobs, t.sql_jobs, t.sql_executions, self.by).orderBy(*self.by, *reports.job_order())

    @cached_property
    def critical_stages(self) -> DataFrame:
        return reports.critical_stages(self.telemetry.stages, self.telemetry.job_stages, self.by)

    @cached_property
    def stage_hints(self) -> DataFrame:
        t = self.telemetry
        return linking.plan_hints(t.stages, t.job_stages, t.sql_jobs, t.sql_executions, self.by, self.strict)

    @cached_property
    def health(self) -> DataFrame:
        return reports.health_summary(self.telemetry.jobs, self.telemetry.stages, self.found, self.by)

    @cached_property
    def cluster(self) -> DataFrame:
        return reports.cluster_resources(self.telemetry.executors, self.by, self.telemetry.jobs if self.by else None)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.NAMES}


def analyze(
    t: Telemetry, by: Sequence[str] = (), strict: bool = True, store_findings: bool = True
) -> Report:
    """Sorted findings, ranked jobs, critical stages, hints, health and resources; runs nothing."""
    return Report(t, tuple(by), strict, store_findings)
