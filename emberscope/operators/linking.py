"""Links between stages, jobs and SQL executions, and the wide stage row.

Every link is a left equi-join on a bridge table.  Where the order of a list would decide,
the rule is stated: the smallest job id owns a stage, the largest SQL id owns a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.functions.plan_text import plan_hint, plan_operators
from emberscope.operators.stage_rules import bottleneck, io_summary


def job_to_sql(sql_jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``job_id, sql_id``: the SQL execution of each linked job."""
    return sql_jobs.groupBy(*by, "job_id").agg(F.max("sql_id").alias("sql_id"))


def stage_to_job(job_stages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``stage_id, job_id``: the first job that lists each stage."""
    return job_stages.groupBy(*by, "stage_id").agg(F.min("job_id").alias("job_id"))


def sql_hints(sql_executions: DataFrame, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Description, top-3 plan hint and searchable operator text of each SQL execution.

    With ``strict`` the searchable text is the hint; otherwise it holds every operator of
    the plan with tree markers taken off.
    """
    hint = plan_hint("plan_description", 3, strict)
    search = "sql_plan_hint" if strict else f"array_join({plan_operators('plan_description', False)}, ' ')"
    return sql_executions.selectExpr(
        *by,
        "id AS sql_id",
        "description AS sql_description",
        f"{hint} AS sql_plan_hint",
        f"{search} AS plan_search",
    )


def job_sql(
    jobs: DataFrame, sql_jobs: DataFrame, sql_executions: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Jobs with the id, description and plan of their SQL execution (NULL if none)."""
    sqls = sql_executions.select(
        *by,
        F.col("id").alias("sql_id"),
        F.col("description").alias("sql_description"),
        F.col("plan_description").alias("sql_plan"),
    )
    return jobs.join(job_to_sql(sql_jobs, by), [*by, "job_id"], "left").join(
        sqls, [*by, "sql_id"], "left"
    )


def stage_links(
    job_stages: DataFrame,
    sql_jobs: DataFrame,
    sql_executions: DataFrame,
    by: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """``stage_id`` to job, SQL execution, description and plan hint."""
    per_job = job_to_sql(sql_jobs, by).join(
        sql_hints(sql_executions, by, strict), [*by, "sql_id"], "left"
    )
    return stage_to_job(job_stages, by).join(per_job, [*by, "job_id"], "left")


def plan_hints(
    stages: DataFrame,
    job_stages: DataFrame,
    sql_jobs: DataFrame,
    sql_executions: DataFrame,
    by: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Plan hint of each stage that has one."""
    links = stage_links(job_stages, sql_jobs, sql_executions, by, strict)
    return (
        stages.select(*by, "stage_id")
        .distinct()
        .join(links, [*by, "stage_id"])
        .where("sql_plan_hint is not null")
        .select(*by, "stage_id", "sql_plan_hint")
    )


def stage_context(
    stages: DataFrame,
    job_stages: DataFrame,
    sql_jobs: DataFrame,
    sql_executions: DataFrame,
    by: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """The wide stage row all stage rules read: metrics, links, I/O text, bottleneck."""
    links = stage_links(job_stages, sql_jobs, sql_executions, by, strict)
    return (
        stages.join(links, [*by, "stage_id"], "left")
        .withColumns({"io_summary": F.expr(io_summary()), "bottleneck": F.expr(bottleneck())})
    )
