"""Small hand-made tables."""

from emberscope import model as M
from emberscope.operators import linking, stage_rules

MB = M.MB


def stage(stage_id=0, **over):
    row = {
        "stage_id": stage_id, "attempt_id": 0, "status": "COMPLETE", "num_tasks": 10, "num_active_tasks": 0,
        "num_complete_tasks": 10, "num_failed_tasks": 0, "num_killed_tasks": 0, "name": f"stage {stage_id}",
        **{m: 0 for m in M.TASK_METRICS},
        "executor_run_time": 1000, "executor_cpu_time": 1000, "input_bytes": 1000, "input_records": 10,
        "output_bytes": 1000, "output_records": 10,
    }
    row.update(over)
    return row


def task(task_id=0, **over):
    row = {
        "task_id": task_id, "task_index": task_id, "attempt": 0, "stage_id": 0, "stage_attempt_id": 0,
        "executor_id": "0", "host": "h", "status": "SUCCESS", "duration": 1000, **{m: 0 for m in M.TASK_METRICS},
        "executor_run_time": 1000, "executor_cpu_time": 1000, "input_bytes": 1000, "input_records": 10,
        "output_bytes": 1000, "output_records": 10,
    }
    row.update(over)
    return row


def frame(spark, table, rows, app=None):
    schema = M.TABLE_SCHEMAS[table]
    if app is None:
        schema = type(schema)([f for f in schema.fields if f.name != "app_id"])
    return spark.createDataFrame([tuple(r.get(n) for n in schema.fieldNames()) for r in rows], schema)


def context(spark, rows, plan=None):
    """Wide rows of stages that all belong to job 0, with an optional SQL plan."""
    stages = frame(spark, "stages", rows)
    links = frame(spark, "job_stages", [{"job_id": 0, "stage_id": r["stage_id"]} for r in rows])
    sqls = [] if plan is None else [{"id": 5, "status": "COMPLETED", "description": "q", "plan_description": plan}]
    sql_jobs = [] if plan is None else [{"sql_id": 5, "job_id": 0, "state": "success"}]
    wide = linking.stage_context(
        stages, links, frame(spark, "sql_jobs", sql_jobs), frame(spark, "sql_executions", sqls)
    )
    return stage_rules.with_run_statistics(wide, stages)


def findings(spark, rows, plan=None, rules=None):
    picked = [stage_rules.ROW_RULES[r] for r in (rules or stage_rules.ROW_RULES)]
    return stage_rules.stage_findings(context(spark, rows, plan), picked).collect()
