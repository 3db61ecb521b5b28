import re

from pyspark.sql import functions as F

from emberscope.operators import reports
from emberscope.sources import store
from emberscope.workspace import expire_folders, new_folder
from tests.rows import frame, task


def tasks_of(spark, stages=40, each=25):
    rows = [task(s * 100 + i, stage_id=s, stage_attempt_id=i % 2, duration=i) for s in range(stages) for i in range(each)]
    return frame(spark, "tasks", rows).withColumn("app_id", F.when(F.col("stage_id") % 2 == 0, "a").otherwise("b"))


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_folders_of_chosen_stages_are_read(spark):
    path = new_folder(spark, "by-stage")
    tasks = tasks_of(spark)
    store.write_tasks_by_stage(tasks, path, ["app_id"], buckets=32)
    stages = spark.createDataFrame([(s, "a" if s % 2 == 0 else "b", s * 10) for s in range(40)], "stage_id long, app_id string, run long")
    chosen = stages.where("run >= 380")
    found = store.read_tasks_of(spark, path, chosen, ["app_id"], buckets=32)
    assert {(r.app_id, r.stage_id, r.n) for r in found.groupBy("app_id", "stage_id").agg(F.count("*").alias("n")).collect()} == {("a", 38, 25), ("b", 39, 25)}
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", plan_of(found))
    assert len({f.split("/")[-2] for f in spark.read.parquet(path).inputFiles()}) > 10


def test_chosen_attempts(spark):
    path = new_folder(spark, "by-stage")
    store.write_tasks_by_stage(tasks_of(spark), path)
    chosen = spark.createDataFrame([(3, 1), (4, 0)], "stage_id long, attempt_id long")
    found = store.read_tasks_of(spark, path, chosen)
    assert {(r.stage_id, r.stage_attempt_id, r["count"]) for r in found.groupBy("stage_id", "stage_attempt_id").count().collect()} == {(3, 1, 12), (4, 0, 13)}
    assert store.read_tasks_of(spark, path, chosen.limit(0)).count() == 0


def test_bucketed_merge_does_not_shuffle_the_old_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        old = tasks_of(spark)
        store.write_task_table(old, "old_tasks", new_folder(spark, "task-table"), ["app_id"], buckets=8)
        new = old.where("stage_id < 5 and task_id % 2 = 0").withColumn("duration", F.col("duration") + 1000)
        merged = store.merged_task_table(spark, "old_tasks", new, ["app_id"])
        want = reports.merge_task_snapshots(old, new, ["app_id"])
        columns = ["app_id", "stage_id", "task_id", "duration"]
        assert sorted(map(tuple, merged.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
        plan = plan_of(merged.select(columns))
        final = plan.split("Initial Plan")[0]
        scan = next(i for i, line in enumerate(final.splitlines()) if re.search(r"FileScan parquet .*old_tasks", line))
        join = max(i for i, line in enumerate(final.splitlines()[:scan]) if "LeftAnti" in line)
        between = final.splitlines()[join + 1 : scan]
        assert between and not any("Exchange" in line for line in between)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS old_tasks")


def test_only_old_folders_expire(spark):
    import os
    import time

    old, young = new_folder(spark, "old"), new_folder(spark, "young")
    for path in (old, young):
        spark.range(3).write.parquet(path)
    place = old.removeprefix("file:")
    os.utime(place, (time.time() - 10_000_000, time.time() - 10_000_000))
    removed = expire_folders(spark, 5_000_000)
    assert [p.split("/")[-1] for p in removed] == [old.split("/")[-1]]
    assert not os.path.exists(place) and spark.read.parquet(young).count() == 3
