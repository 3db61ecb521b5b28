from emberscope.operators import linking, reports
from emberscope.plans import analysis
from emberscope import model as M
from tests.rows import frame, stage


def sql_rows(spark, *pairs):
    return frame(spark, "sql_jobs", [{"sql_id": s, "job_id": j, "state": "success"} for s, j in pairs])


def test_job_to_sql(spark):
    got = {r.job_id: r.sql_id for r in linking.job_to_sql(sql_rows(spark, (1, 10), (1, 11), (2, 12), (3, 12))).collect()}
    assert got == {10: 1, 11: 1, 12: 3}


def test_first_job_owns_a_stage(spark):
    links = frame(spark, "job_stages", [{"job_id": 2, "stage_id": 7}, {"job_id": 1, "stage_id": 7}])
    assert linking.stage_to_job(links).first().job_id == 1


def bundle(spark, app=None):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    with_app = lambda rows: [dict(r, app_id=a) for r in rows for a in (app or [None])]
    stages = [
        stage(1, submission_time=at(0), completion_time=at(5), disk_bytes_spilled=2 * M.GB),
        stage(2, submission_time=at(0), completion_time=at(9)),
        stage(3, submission_time=at(0), completion_time=None, status="ACTIVE"),
    ]
    jobs = [
        {"job_id": 1, "name": "a", "status": "SUCCEEDED", "submission_time": at(0), "completion_time": at(9), "num_tasks": 2, "num_failed_tasks": 0},
        {"job_id": 2, "name": "b", "status": "RUNNING", "submission_time": at(0), "num_tasks": 1, "num_failed_tasks": 0},
        {"job_id": 3, "name": "c", "status": "FAILED", "submission_time": at(0), "completion_time": at(60), "num_tasks": 1, "num_failed_tasks": 1},
    ]
    links = [{"job_id": 1, "stage_id": 1}, {"job_id": 1, "stage_id": 2}, {"job_id": 2, "stage_id": 3}]
    executors = [
        {"id": "driver", "total_cores": 1, "max_memory": 5, "is_active": True},
        {"id": "1", "total_cores": 4, "max_memory": 7, "is_active": True},
        {"id": "2", "total_cores": 4, "max_memory": 7, "is_active": False},
    ]
    make = lambda table, rows: frame(spark, table, with_app(rows), app)
    return M.Telemetry(
        tasks=make("tasks", []), stages=make("stages", stages), jobs=make("jobs", jobs),
        job_stages=make("job_stages", links), sql_executions=make("sql_executions", []),
        sql_jobs=make("sql_jobs", []), executors=make("executors", executors),
    )


def test_report(spark):
    report = analysis.analyze(bundle(spark))
    assert [j.job_id for j in report.jobs.collect()] == [3, 1, 2]  # unfinished last
    assert [r.stage_id for r in report.critical_stages.collect()] == [2]
    health = report.health.first()
    assert (health.total_jobs, health.running_jobs, health.failed_jobs, health.critical_count) == (3, 1, 1, 1)
    assert (health.top_issue_1, health.top_issue_2) == ("Disk Spill in stage 1", None)
    assert tuple(report.cluster.first()) == (7, 4, 1)
    line = reports.health_lines(report.health).first()
    assert line.summary.startswith("Jobs: 3 (1 running, 1 failed) | I/O: in 2.9 KB") and line.state == "critical"
    assert line.issues == "Top: Disk Spill in stage 1"


def test_report_per_application(spark):
    report = analysis.analyze(bundle(spark, ["x", "y"]), ["app_id"])
    assert {(r.app_id, r.total_jobs, r.top_issue_1) for r in report.health.collect()} == {
        ("x", 3, "Disk Spill in stage 1"), ("y", 3, "Disk Spill in stage 1")
    }
    assert {(r.app_id, r.num_executors) for r in report.cluster.collect()} == {("x", 1), ("y", 1)}
    assert report.suspects.count() == 2


def test_empty_application_has_zero_rows(spark):
    empty = {name: frame(spark, name, []) for name in M.TABLE_SCHEMAS}
    report = analysis.analyze(M.Telemetry(**empty))
    assert report.health.first().total_jobs == 0 and report.cluster.first().num_executors == 0
    assert reports.health_lines(report.health).first().summary == "Jobs: 0 | I/O: in 0 B out 0 B shuffle 0 B | Health: OK"
    lone = frame(spark, "jobs", [{"app_id": "z", "job_id": 1}], app=True)
    none = frame(spark, "executors", [], app=True)
    assert tuple(reports.cluster_resources(none, ["app_id"], lone).first()) == ("z", 0, 0, 0)


def test_own_detector(spark):
    own = {"none": lambda i: i.context.where("false").selectExpr(
        "'WARN' AS severity", "'x' AS category", "stage_id", "job_id", "'' AS title", "'' AS detail",
        "name AS stage_name", "sql_id", "sql_description", "io_summary", "'' AS recommendation", "bottleneck",
        "sql_plan_hint", "0L AS estimated_savings_ms")}
    assert analysis.find_suspects(bundle(spark), detectors=own).isEmpty()
