import gzip
import json

import pytest

from emberscope.operators import reports
from emberscope.plans import analysis
from emberscope.sources import event_log as log
from emberscope.sources import rest_snapshot, store
from emberscope import model as M

SQL = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"
T0 = 1704067200000


def info(stage, attempt=0, name="count at a.py:1", tasks=2, **times):
    return {"Stage ID": stage, "Stage Attempt ID": attempt, "Stage Name": name, "Number of Tasks": tasks, **times}


def task_end(task, launch, finish, reason="Success", stage=0, **more):
    out = {
        "Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": 0,
        "Task Info": {"Task ID": task, "Index": task, "Attempt": 0, "Executor ID": "1", "Host": "h1",
                      "Launch Time": launch, "Finish Time": finish, "Failed": reason != "Success"},
        **more,
    }
    if reason:
        out["Task End Reason"] = {"Reason": reason}
    return out


METRICS = {
    "Executor Run Time": 450, "Executor CPU Time": 300000000, "Peak Execution Memory": 1024,
    "Input Metrics": {"Bytes Read": 100, "Records Read": 10},
    "Shuffle Read Metrics": {"Remote Bytes Read": 5, "Local Bytes Read": 6, "Total Records Read": 2},
    "Shuffle Write Metrics": {"Shuffle Bytes Written": 50, "Shuffle Records Written": 4},
}

LOG = [
    {"Event": "SparkListenerApplicationStart", "App ID": "app-1", "App Name": "demo", "Timestamp": T0},
    {"Event": "SparkListenerExecutorAdded", "Executor ID": "1", "Executor Info": {"Host": "h1", "Total Cores": 4}},
    {"Event": "SparkListenerExecutorAdded", "Executor ID": "2", "Executor Info": {"Host": "h2", "Total Cores": 8}},
    {"Event": SQL + "Start", "executionId": 7, "description": "q",
     "physicalPlanDescription": "== Physical Plan ==\nSort (1)", "time": T0 + 100},
    {"Event": "SparkListenerJobStart", "Job ID": 0, "Submission Time": T0 + 200, "Stage IDs": [0, 5],
     "Stage Infos": [info(0), info(5, tasks=3)],
     "Properties": {"spark.sql.execution.id": "7", "callSite.short": "count at a.py:1"}},
    {"Event": "SparkListenerStageSubmitted", "Stage Info": info(0, name="other", **{"Submission Time": T0 + 300})},
    task_end(0, T0 + 300, T0 + 800, **{"Task Metrics": METRICS}),
    task_end(1, T0 + 300, T0 + 1300, "ExceptionFailure"),
    {"Event": "SparkListenerStageCompleted", "Stage Info": info(0, **{"Completion Time": T0 + 1400})},
    {"Event": "SparkListenerJobEnd", "Job ID": 0, "Completion Time": T0 + 1500, "Job Result": {"Result": "JobSucceeded"}},
    {"Event": SQL + "End", "executionId": 7, "time": T0 + 1600},
    {"Event": "SparkListenerJobStart", "Job ID": 1, "Stage IDs": [], "Properties": {"spark.sql.execution.id": "x"}},
    {"Event": "SparkListenerJobStart", "Job ID": 2, "Stage IDs": [], "Properties": {"spark.job.description": "d", "spark.sql.execution.id": "9"}},
    {"Event": "SparkListenerJobEnd", "Job ID": 2, "Job Result": {"Result": "JobFailed"}},
    {"Event": "SparkListenerJobEnd", "Job ID": 77, "Job Result": {"Result": "JobFailed"}},
    {"Event": SQL + "Start", "executionId": 9, "time": T0},
    {"Event": "SparkListenerExecutorRemoved", "Executor ID": "1"},
    {"Event": "SparkListenerApplicationEnd", "Timestamp": T0 + 1700},
    {"Event": "SomethingElse", "Stage ID": "not a number"},
    {"Event": "SparkListenerTaskEnd", "Stage ID": 0},
    {"Event": "SparkListenerJobEnd", "Job ID": "zero"},
]


def text(events=LOG, junk=True):
    lines = [json.dumps(e) for e in events]
    return "\n".join(lines + (["", "   ", "{not json", '["list"]'] if junk else [])) + "\n"


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "app-1-log"
    path.write_text(text())
    return log.read_event_log(spark, str(path))


def test_counts(spark, tmp_path):
    (tmp_path / "one").write_text(text())
    events = log.parse_lines(log.read_lines(spark, str(tmp_path)))
    got = {r.kind: r.n for r in log.event_counts(events).collect()}
    assert got["malformed"] == 4 and got["other"] == 1 and got["task_end"] == 2 and got["job_start"] == 3


def test_jobs(parsed):
    jobs = {j.job_id: j for j in parsed.jobs.collect()}
    assert set(jobs) == {0, 1, 2}
    first = jobs[0]
    assert (first.app_id, first.name, first.status, first.num_tasks) == ("app-1", "count at a.py:1", "SUCCEEDED", 5)
    assert (first.num_completed_tasks, first.num_failed_tasks) == (5, 0)
    assert (jobs[1].name, jobs[1].status, jobs[1].submission_time) == ("Job 1", "RUNNING", None)
    assert (jobs[2].name, jobs[2].status, jobs[2].num_failed_tasks) == ("d", "FAILED", 1)


def test_stages(parsed):
    stages = {s.stage_id: s for s in parsed.stages.collect()}
    done = stages[0]
    assert (done.status, done.num_complete_tasks, done.num_failed_tasks, done.shuffle_read_bytes) == ("FAILED", 1, 1, 11)
    assert (done.name, done.peak_execution_memory, done.executor_run_time) == ("count at a.py:1", 1024, 450)
    assert (done.submission_time.microsecond, done.completion_time.microsecond) == (300_000, 400_000)
    assert (stages[5].status, stages[5].num_tasks, stages[5].submission_time) == ("PENDING", 3, None)
    assert {(r.job_id, r.stage_id) for r in parsed.job_stages.collect()} == {(0, 0), (0, 5)}


def test_tasks_executors_sql(parsed):
    assert {t.task_id: (t.duration, t.status, t.input_bytes) for t in parsed.tasks.collect()} == {
        0: (500, "SUCCESS", 100), 1: (1000, "FAILED", 0)
    }
    assert {(e.id, e.total_cores, e.is_active) for e in parsed.executors.collect()} == {("1", 4, False), ("2", 8, True)}
    assert tuple(reports.cluster_resources(parsed.executors).first()) == (0, 8, 1)
    sqls = {s.id: s for s in parsed.sql_executions.collect()}
    assert (sqls[7].status, sqls[7].duration, sqls[7].description) == ("COMPLETED", 1500, "q")
    assert (sqls[9].status, sqls[9].duration, sqls[9].plan_description) == ("RUNNING", 0, "")
    # SQL 9 starts only after the job that names it
    assert [(r.sql_id, r.job_id, r.state) for r in parsed.sql_jobs.collect()] == [(7, 0, "success")]


def test_order_of_lines_decides(spark, tmp_path):
    start = lambda name: {"Event": "SparkListenerJobStart", "Job ID": 0, "Stage IDs": [0], "Properties": {"callSite.short": name}}
    end = {"Event": "SparkListenerJobEnd", "Job ID": 0}
    submit = {"Event": "SparkListenerStageSubmitted", "Stage Info": info(0, **{"Submission Time": T0})}
    done = {"Event": "SparkListenerStageCompleted", "Stage Info": info(0, **{"Completion Time": T0 + 9})}
    events = [
        {"Event": "SparkListenerExecutorRemoved", "Executor ID": "1"},
        {"Event": "SparkListenerExecutorAdded", "Executor ID": "1"},
        done, start("a"), end, start("b"), submit, done, task_end(0, T0, T0 + 5, "TaskKilled"), submit,
    ]
    (tmp_path / "x").write_text(text(events, False))
    t = log.read_event_log(spark, str(tmp_path), staging=False)
    job = t.jobs.first()
    assert job.app_id.endswith(f"{tmp_path}/x") and (job.name, job.status) == ("b", "RUNNING")
    assert t.executors.first().is_active
    stage = t.stages.first()
    assert (stage.status, stage.num_failed_tasks, stage.completion_time is not None) == ("ACTIVE", 1, True)
    (tmp_path / "x").write_text(text(events[:-1], False))
    late = log.read_event_log(spark, str(tmp_path)).stages.first()
    assert (late.status, late.num_failed_tasks) == ("COMPLETE", 1)  # it failed after completion
    (tmp_path / "x").write_text(text([start("a"), end], False))
    assert log.read_event_log(spark, str(tmp_path)).jobs.first().status == "UNKNOWN"


def test_spread_keeps_the_order_of_lines(spark, tmp_path):
    (tmp_path / "app.gz").write_bytes(gzip.compress(text().encode()))
    spread = log.read_event_log(spark, str(tmp_path), spread=3)
    whole = log.read_event_log(spark, str(tmp_path))
    for name in ("stages", "jobs", "sql_jobs", "executors"):
        assert sorted(map(str, getattr(spread, name).collect())) == sorted(map(str, getattr(whole, name).collect()))


def test_rolling_and_many_applications(spark, tmp_path):
    for app in ("a", "b"):
        folder = tmp_path / f"eventlog_v2_{app}"
        folder.mkdir()
        mine = [dict(LOG[0], **{"App ID": app}), *LOG[1:]]
        (folder / f"events_2_{app}").write_text(text(mine[:5], False))  # lines 0-4 come first by number
        (folder / f"events_10_{app}.gz").write_bytes(gzip.compress(text(mine[5:], False).encode()))
        (folder / f"appstatus_{app}").write_text("")
    t = log.read_event_log(spark, str(tmp_path))
    assert {(s.app_id, s.stage_id, s.status) for s in t.stages.collect()} == {
        ("a", 0, "FAILED"), ("a", 5, "PENDING"), ("b", 0, "FAILED"), ("b", 5, "PENDING")
    }
    assert t.tasks.groupBy("app_id").count().count() == 2
    assert analysis.analyze(t, ["app_id"]).health.count() == 2


def test_gzip_by_content(spark, tmp_path):
    body = text().encode()
    (tmp_path / "plain").write_bytes(body)
    (tmp_path / "packed.gzip").write_bytes(gzip.compress(body[:1000]) + gzip.compress(body[1000:]))
    (tmp_path / "hidden").write_bytes(gzip.compress(body))
    (tmp_path / "known.gz").write_bytes(gzip.compress(body))
    events = log.parse_lines(log.read_lines(spark, str(tmp_path), gzip_by_content=True))
    got = {r.kind: r.n for r in log.event_counts(events).collect()}
    assert got["malformed"] == 16 and got["task_end"] == 8
    order = events.where("pos.file like '%hidden' and kind = 'task_end'").orderBy("pos").select("task_id").collect()
    assert [r.task_id for r in order] == [0, 1]


def test_choice_of_logs(spark, tmp_path):
    nested = tmp_path / "nested"
    for folder, sizes in (("b", [5, 9]), ("a", [3, 4])):
        (nested / folder).mkdir(parents=True)
        for n in sizes:
            (nested / folder / f"f{n}").write_text("x" * n)
    assert log.discover_event_log(spark, str(nested)).endswith("/a/f4")
    (nested / "top").write_text("x")
    assert log.discover_event_log(spark, str(nested)).endswith("/nested/top")
    assert log.discover_event_log(spark, str(tmp_path / "missing")) is None
    assert {r.path.split("/")[-1] for r in log.largest_per_folder(spark, str(nested)).collect()} == {"f4", "f9", "top"}
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "small").write_text(text(LOG[:3], False))
    (logs / "large").write_text(text())
    assert log.read_event_log(spark, str(logs), pick="largest").jobs.count() == 3
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "no_jobs").write_text(text(LOG[:3], False))
    found = log.load_first(spark, [str(tmp_path / "missing"), str(empty), str(logs)])
    assert found.jobs.select("job_id").distinct().count() == 3
    assert log.load_first(spark, [str(empty)]) is None


def test_rest_snapshot(spark, tmp_path):
    app = tmp_path / "app-9"
    tasks = app / "stages" / "4" / "1"
    tasks.mkdir(parents=True)
    (app / "jobs.json").write_text(json.dumps([
        {"jobId": 1, "name": "n", "status": "SUCCEEDED", "stageIds": [4], "numTasks": 2, "extra": 1,
         "submissionTime": "2024-01-15T10:30:00.000GMT", "completionTime": "2024-01-15T10:30:05.500GMT"}]))
    (app / "stages.json").write_text(json.dumps([{"stageId": 4, "attemptId": 1, "status": "COMPLETE", "name": "s", "executorRunTime": 7}]))
    (tasks / "taskList.json").write_text(json.dumps([
        {"taskId": 1, "duration": 5, "taskMetrics": {"shuffleReadMetrics": {"remoteBytesRead": 2, "localBytesRead": 3}}},
        {"taskId": 2, "status": "RUNNING"}]))
    (tmp_path / "applications.json").write_text(json.dumps([{"id": "app-9", "name": "x"}, {"id": "app-8", "name": "y"}]))
    t = rest_snapshot.read_snapshot(spark, str(tmp_path))
    assert rest_snapshot.first_application(spark, str(tmp_path)).first().id == "app-9"
    got = {r.task_id: r for r in t.tasks.collect()}
    assert (got[1].app_id, got[1].stage_id, got[1].stage_attempt_id, got[1].shuffle_read_bytes) == ("app-9", 4, 1, 5)
    assert (got[2].duration, got[2].input_bytes, got[2].executor_id) == (None, 0, "")
    assert t.sql_executions.isEmpty() and t.executors.isEmpty() and t.sql_jobs.isEmpty()
    job = reports.job_rows(t.jobs, t.sql_jobs, t.sql_executions, ["app_id"]).first()
    assert (job.duration_ms, job.sql_id) == (5500, None)
    assert t.stages.first().executor_run_time == 7


def test_store(spark, parsed, tmp_path):
    path = str(tmp_path / "store")
    store.write_telemetry(parsed, path)
    back = store.read_telemetry(spark, path)
    for name, df in back.tables().items():
        assert df.schema.fieldNames() and df.count() == getattr(parsed, name).count(), name
    plan = back.tasks.where("app_id = 'app-1' and stage_id = 0").select("duration")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(app_id" in plan and "EqualTo(stage_id,0)" in plan
    report = analysis.analyze(back, ["app_id"]).tables()
    store.write_report(report, str(tmp_path / "report"), "HISTORICAL")
    saved = spark.read.json(str(tmp_path / "report" / "suspects_json"))
    assert saved.count() == report["suspects"].count() > 0
    assert {r.data_source for r in saved.select("data_source").collect()} == {"HISTORICAL"}
    assert M.Telemetry(**back.tables()).restrict(back.jobs.where("false"), ["app_id"]).tasks.isEmpty()
