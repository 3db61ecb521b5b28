import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscope import model as M
from emberscope.operators import linking, quantiles, ranking, reports, task_rules
from tests.rows import frame, stage, task


def skews(spark, rows, **options):
    dists = task_rules.distributions(frame(spark, "tasks", rows), **options)
    return {(r.category, r.severity) for r in task_rules.skewed(dists).collect()}


def with_last(n, usual, last):
    return [task(i, **usual) for i in range(n)] + [task(n, **last)]


def test_skews(spark):
    assert skews(spark, [task(i) for i in range(100)]) == set()
    assert (M.DATA_SKEW, M.CRIT) in skews(spark, with_last(99, {"duration": 1000}, {"duration": 100_000}))
    assert (M.DATA_SKEW, M.CRIT) in skews(spark, with_last(99, {"duration": 100}, {"duration": 500_000}))
    assert (M.SIZE_SKEW, M.CRIT) in skews(spark, with_last(99, {"input_bytes": 100}, {"input_bytes": 100_000}))
    records = skews(spark, with_last(99, {"input_records": 100}, {"input_records": 100_000}))
    assert (M.RECORD_SKEW, M.CRIT) in records
    few = skews(spark, with_last(99, {"input_records": 1}, {"input_records": 1000}))
    assert not any(category == M.RECORD_SKEW for category, _ in few)


def test_distribution_values(spark):
    rows = with_last(99, {"duration": 100}, {"duration": 10_000})
    (d,) = task_rules.distributions(frame(spark, "tasks", rows), (), ["duration"]).collect()
    assert d.cv > 1 and d.max_median_ratio == 100 and d.median == 100 and d.task_id == 99
    (flat,) = task_rules.distributions(frame(spark, "tasks", [task(i) for i in range(100)]), (), ["duration"]).collect()
    assert flat.cv < 0.01 and flat.max_median_ratio == 1
    idle = frame(spark, "tasks", [task(i, duration=0) for i in range(3)])
    assert task_rules.distributions(idle, (), ["duration"]).isEmpty()
    assert reports.skew_metrics(idle).first().cv == 0
    alone = frame(spark, "tasks", [task(0), task(1, duration=None)])
    assert task_rules.distributions(alone, (), ["duration"]).isEmpty()


def test_ties_go_to_the_larger_task(spark):
    rows = [task(i, duration=d, executor_id=f"e{i}") for i, d in enumerate([5, 9, 9, 1])]
    tasks = frame(spark, "tasks", rows)
    assert task_rules.distributions(tasks, (), ["duration"]).first().task_id == 2
    slowest = task_rules.slowest_tasks(tasks).first()
    assert (slowest.task_id, slowest.executor_id) == (2, "e2")


def test_hotspot(spark):
    rows = [task(i, input_bytes=100, executor_id="exec-0") for i in range(10)]
    rows += [task(i + 10, input_bytes=10_000, executor_id="exec-1") for i in range(10)]
    (hot,) = task_rules.hotspots(frame(spark, "tasks", rows)).collect()
    assert hot.executor_id == "exec-1" and hot.tasks == 10
    assert task_rules.hotspots(frame(spark, "tasks", [task(0)])).isEmpty()


def test_findings_keep_stages_without_links(spark):
    tasks = frame(spark, "tasks", with_last(99, {"duration": 100}, {"duration": 10_000}))
    stages = frame(spark, "stages", [stage(0, name="a"), stage(0, attempt_id=1, name="b")])
    links = linking.stage_links(
        frame(spark, "job_stages", []), frame(spark, "sql_jobs", []), frame(spark, "sql_executions", [])
    )
    found = task_rules.task_findings(tasks, task_rules.stage_names(stages, links)).collect()
    assert {f.category for f in found} == {M.DATA_SKEW, M.EXEC_HOTSPOT}
    assert {(f.stage_name, f.job_id, f.estimated_savings_ms) for f in found} == {("b", None, 0)}


def test_stage_choice(spark):
    rows = [stage(i, executor_run_time=i) for i in range(20)]
    rows += [stage(30, num_tasks=101, executor_run_time=0), stage(31, shuffle_write_bytes=7, executor_run_time=0)]
    rows += [stage(32, status="ACTIVE", executor_run_time=99)]
    stages = frame(spark, "stages", rows)
    picked = {r.stage_id for r in task_rules.stages_worth_task_analysis(stages).collect()}
    assert picked == {15, 16, 17, 18, 19, 30, 31}
    many = frame(spark, "stages", [stage(i, num_tasks=200) for i in range(40)])
    assert task_rules.stages_worth_task_analysis(many).count() == 15
    assert task_rules.stages_worth_task_analysis(many, cap=None).count() == 40


PROBS = {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q99": 0.99, "q100": 1.0}


@pytest.mark.parametrize("large", [0, 700, quantiles.LARGE_GROUP])
def test_quantiles_against_brute_force(spark, large):
    rng = random.Random(7)
    scales = [1, 5, 4096, 10**6, 2**30, 2**40, 2**61, -(10**6), -(2**50)]
    values = {k: [int(rng.choice(scales) * rng.random()) for _ in range(n)] for k, n in enumerate([1, 2, 3, 500, 5000])}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k int, v bigint")
    got = {r.k: r for r in quantiles.exact_quantiles(rows, ["k"], "v", PROBS, large).collect()}
    for k, vs in values.items():
        assert got[k].n == len(vs)
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(np.array(vs, float), p), rel=1e-12)


def test_value_bucket_keeps_order(spark):
    edges = sorted({s * (2**b + d) for b in range(62) for d in (-1, 0, 1) for s in (1, -1)} | {2**63 - 1})
    rows = spark.createDataFrame([(e,) for e in edges], "v bigint")
    buckets = [r.b for r in rows.select("v", quantiles.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert buckets == sorted(buckets) and max(buckets) < 60_000


def test_close_values_share_no_window(spark):
    """Values inside one bucket are told apart by its parts; NULL keys are a group."""
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 1, NULL) AS k", "1000000000000 + id * 7 AS v")
    got = {r.k: r for r in quantiles.exact_quantiles(rows, ["k"], "v", PROBS, 0).collect()}
    for k, first in ((1, 0), (None, 1)):
        values = 10**12 + 7 * np.arange(first, 40_000, 2)
        assert got[k].n == 20_000 and all(got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-15) for name, p in PROBS.items())
    cells = quantiles._with_cells(rows.select(F.col("v").alias("value"))).groupBy("cell_0", "cell_1").count()
    assert cells.agg(F.max("count")).first()[0] <= 2**12


def test_rank_over_many_partitions(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS g", "(id * 7919) % 1000 AS v")
    got = ranking.with_rank(rows, [F.col("v").desc()]).collect()
    assert sorted((r["rank"], r.v) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    for g in range(3):
        mine = sorted((r["rank"], r.v) for r in ranking.with_rank(rows, [F.col("v")], ["g"]).collect() if r.g == g)
        assert [rank for rank, _ in mine] == list(range(1, len(mine) + 1))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


def test_histogram(spark):
    rows = [task(i, duration=d) for i, d in enumerate([0, 10, 20, 95, 100, 100, None])]
    rows += [task(i + 10, stage_id=1, duration=5) for i in range(3)]
    bars = reports.duration_histogram(frame(spark, "tasks", rows)).orderBy("bucket").collect()
    assert [b.n for b in bars] == [1, 1, 1, 0, 0, 0, 0, 0, 0, 3] and {b.stage_id for b in bars} == {0}
    tasks = frame(spark, "tasks", rows)
    assert reports.duration_histogram(tasks, totals=task_rules.executor_totals(tasks)).orderBy("bucket").collect() == bars
    assert [b.bar for b in bars][0] == 13 and bars[9].bar == 40 and (bars[2].lo, bars[2].hi) == (20.0, 30.0)


def test_breakdown_and_memory(spark):
    rows = [task(0, duration=5, peak_execution_memory=3), task(1, duration=None, executor_id="long-executor-name"), task(2, duration=4)]
    tasks = frame(spark, "tasks", rows)
    got = {r.executor_id: r for r in reports.executor_breakdown(tasks).collect()}
    assert got["0"].avg_duration == 4 and got["0"].pct == pytest.approx(200 / 3)
    assert {r.executor for r in reports.breakdown_texts(reports.executor_breakdown(tasks)).collect()} == {"0", "long-exec..."}
    assert tuple(reports.peak_memory(tasks).first()) == (0, 3, 1, 3)
    assert reports.peak_memory(frame(spark, "tasks", [task(0)])).isEmpty()
    profile = reports.profile_texts(reports.duration_profile(tasks)).first()
    assert (profile["min"], profile["max"]) == ("4ms", "5ms")


def test_merge_keeps_only_missing_stages(spark):
    old = frame(spark, "tasks", [task(0, stage_id=1), task(1, stage_id=2)])
    new = frame(spark, "tasks", [task(9, stage_id=2)])
    assert {(r.stage_id, r.task_id) for r in reports.merge_task_snapshots(old, new).collect()} == {(1, 0), (2, 9)}
