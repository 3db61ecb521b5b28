"""Work that is done once, and spread over tasks."""

import gzip
import json
import random

import numpy as np
from pyspark.sql import functions as F

from checks import queries
from emberscope import fixtures
from emberscope.sources import event_log as log
from emberscope.sources import json_arrays, rest_snapshot
from emberscope.streaming import live
from emberscope.workspace import new_folder
from tests.test_event_log import LOG, T0, task_end, text


SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "app").write_text(text(LOG, False) + "\nnull\n[]\n7\nnone SparkListenerTaskEnd\n")
    lines = spark.read.text(str(tmp_path)).select(F.lit("file:///x/app").alias("file"), F.lit(0).alias("block"), "value")
    assert plan_of(live.stream_tasks(lines)).count("from_json(") == 1
    parsed = log.parse_lines(lines.select("value"))
    assert plan_of(parsed.where("kind = 'task_end'").select("task_id")).count("from_json(") == 1
    kinds = {r.kind: r.n for r in log.event_counts(parsed).collect()}
    assert kinds[log.MALFORMED] >= 4 and parsed.count() == len(LOG) + 4


def test_tasks_share_a_packed_file(spark, tmp_path):
    """Each line arrives as often as it is there, though several tasks unpack its file."""
    lines = [task_end(i, T0, T0 + i) for i in range(40)] + [task_end(7, T0, T0 + 7)] * 3
    for name in ("one.gz", "two.gz"):
        (tmp_path / name).write_bytes(gzip.compress(text(lines, False).encode()))
    out = new_folder(spark, "shares")
    query = (
        live.stream_tasks(live.stream_lines(spark, str(tmp_path), 1)).withColumn("part", F.spark_partition_id()).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", new_folder(spark, "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2  # one file a trigger
    rows = spark.read.parquet(out)
    for app in ("one", "two"):
        got = rows.where(F.col("app_id") == app)
        assert sorted(r.task_id for r in got.collect()) == sorted([*range(40), 7, 7, 7])
        assert got.select("part").distinct().count() > 1


def test_sums_beyond_bigint_do_not_fail(spark):
    most = 2**63 - 1
    rows = [("fits", most), ("fits", -most), ("fits", 5), ("over", most), ("over", most), ("none", None)]
    df = spark.createDataFrame(rows, "app_id string, task_id long")
    sums = df.groupBy("app_id").agg(queries._total("task_id").alias("total"))
    assert sums.schema["total"].dataType.simpleString() == "bigint"
    assert {r.app_id: r.total for r in sums.collect()} == {"fits": 5, "over": None, "none": None}


def test_answers_are_parsed_once(spark, tmp_path):
    (tmp_path / "app-1").mkdir()
    (tmp_path / "app-1" / "jobs.json").write_text('[{"jobId": 1, "status": "SUCCEEDED", "stageIds": [1, 2]}, {"jobId": "x"}]')
    (tmp_path / "app-1" / "stages.json").write_text('[{"stageId": 1}]')
    (tmp_path / "app-1" / "sql.json").write_text('[{"id": 4, "runningJobIds": [1], "successJobIds": [2, 3]}, {"id": 5, "failedJobIds": []}]')
    found = rest_snapshot.read_snapshot(spark, str(tmp_path))
    for df in found.tables().values():
        assert plan_of(df).count("from_json(") <= 1 and plan_of(df).count("MapInArrow") <= 2
    assert sorted((r.sql_id, r.job_id, r.state) for r in found.sql_jobs.collect()) == [(4, 1, "running"), (4, 2, "success"), (4, 3, "success")]
    assert [r.job_id for r in found.jobs.collect()] == [1]


def test_each_stretch_is_a_task_of_its_own(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.json.gz").write_bytes(gzip.compress(f"[{i}, {i}]".encode()))
    (tmp_path / "plain.json").write_text(str(list(range(100, 200))))
    rows = json_arrays.array_elements(spark, f"{tmp_path}/*", 100).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(int(r.value) for r in rows) == sorted([*range(12), *range(12), *range(100, 200)])
    packed = {r.part for r in rows if int(r.value) < 100}
    assert len(packed) == 12 and not packed & {r.part for r in rows if int(r.value) >= 100}


def test_marks_need_not_be_in_one_block():
    """Blocks cut anywhere, also between a backslash and what it escapes, give the marks of the whole."""
    rng = random.Random(3)
    for _ in range(300):
        data = "".join(rng.choice('\\\\"[]{},a') for _ in range(rng.randrange(40))).encode()
        start = (rng.random() < 0.5, rng.randrange(3), rng.random() < 0.5)
        whole, parts = json_arrays._Scan(*start), json_arrays._Scan(*start)
        want, got, at = whole.marks(np.frombuffer(data, np.uint8)).tolist(), [], 0
        while at < len(data):
            step = rng.randrange(1, 6)
            got += [at + m for m in parts.marks(np.frombuffer(data[at : at + step], np.uint8)).tolist()]
            at += step
        assert got == want and vars(whole) == vars(parts)


def test_one_application_is_several_tasks_work_when_merged(spark):
    path, joined = new_folder(spark, "state"), "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.range(4000).selectExpr("'a' AS app_key", "1 AS bucket", "id % 100 AS stage_id", "'size' AS measure", "id AS value", "1L AS times")
    state = live.FindingState(spark, path)
    for number in range(2):
        state.add("counts", rows, number)
    before = spark.conf.get(joined)
    spark.conf.set(joined, "false")
    try:
        state.compact()
    finally:
        spark.conf.set(joined, before)
    base = spark.read.parquet(f"{path}/counts/bases/upto=1")
    assert len(base.inputFiles()) > 1 and base.count() == 4000
    assert state.rows("counts").agg(F.sum("times")).first()[0] == 8000


def test_a_first_batch_is_not_merged(spark):
    path = new_folder(spark, "state")
    state, rows = live.FindingState(spark, path), spark.createDataFrame([("a", 0, 1, "size", 5, 2)], "app_key string, bucket int, stage_id long, measure string, value long, times long")
    touched = rows.select("app_key", "stage_id")
    read = lambda: state.raw("counts", [0], touched, ["app_key", "stage_id"])
    state.add("counts", rows, 3)
    assert "Aggregate" not in plan_of(read()) and [r.times for r in read().collect()] == [2]
    state.add("counts", rows, 4)
    assert "Aggregate" in plan_of(read()) and [r.times for r in read().collect()] == [4]
    state.compact()
    assert [r.times for r in state.raw("counts", [0], touched, ["app_key", "stage_id"], stored=True).collect()] == [4]
    assert "Aggregate" in plan_of(read())  # a base may hold rows that no batch touched now
    assert state.raw("counts", [0], touched.where("stage_id = 2"), ["app_key", "stage_id"]).isEmpty()


def test_lines_of_a_growing_log_are_made_once(spark, tmp_path, monkeypatch):
    made, lines = [], fixtures.event_lines
    monkeypatch.setattr(fixtures, "event_lines", lambda t: (made.append(1), lines(t))[1])
    fixtures.grown_log(spark, SF_DIR, str(tmp_path), False)
    first = {p.name: p.read_bytes() for p in tmp_path.rglob("events_*")}
    fixtures.grown_log(spark, SF_DIR, str(tmp_path), True)
    then = {p.name: p.read_bytes() for p in tmp_path.rglob("events_*")}
    assert len(made) == 1 and len(first) > 9 and first.keys() <= then.keys()
    assert all(then[n] == b if n.endswith(".gz") else then[n].startswith(b) for n, b in first.items())
    text_of = [x for n, b in then.items() for x in (gzip.decompress(b) if n.endswith(".gz") else b).decode().splitlines()]
    assert sorted(text_of) == sorted(r.value for r in lines(fixtures.telemetry(spark, SF_DIR)).select("value").collect())


def test_arrays_are_written_without_python(spark, tmp_path):
    lines = spark.range(0, 100, 1, 3).select(F.format_string('{"id": %d, "t": ","}', "id").alias("value"))
    made = fixtures._as_arrays(lines)
    assert "MapInArrow" not in plan_of(made)
    made.write.text(str(tmp_path / "a"))
    files = [json.loads(p.read_text()) for p in (tmp_path / "a").glob("part-*")]
    assert len(files) == 3 and all(f[-1] is None for f in files)
    assert sorted(x["id"] for f in files for x in f[:-1]) == list(range(100))
