import pytest

from emberscope import model as M
from emberscope.operators import reports, stage_rules
from tests.rows import MB, context, findings, stage


def test_uniform_stages_are_not_slow(spark):
    assert not findings(spark, [stage(i) for i in range(10)], rules=["slow_stage"])


def test_one_slow_stage(spark):
    rows = [stage(i) for i in range(9)] + [stage(9, executor_run_time=100_000)]
    (found,) = findings(spark, rows, rules=["slow_stage"])
    assert (found.stage_id, found.category, found.severity, found.job_id) == (9, M.SLOW_STAGE, M.WARN, 0)
    assert found.title == "Stage 9 took 1m 40s" and found.stage_name == "stage 9" and found.recommendation
    assert found.estimated_savings_ms == 89_100
    rows = [stage(i) for i in range(29)] + [stage(29, executor_run_time=100_000)]
    assert findings(spark, rows, rules=["slow_stage"])[0].severity == M.CRIT


@pytest.mark.parametrize("spilled, severity", [(500_000_000, M.WARN), (2_000_000_000, M.CRIT)])
def test_spill(spark, spilled, severity):
    (found,) = findings(spark, [stage(disk_bytes_spilled=spilled)], rules=["disk_spill"])
    assert found.severity == severity and found.estimated_savings_ms == 300


@pytest.mark.parametrize(
    "counters, pattern",
    [
        (dict(input_bytes=2048 * MB, output_bytes=MB), M.LARGE_SCAN),
        (dict(input_bytes=100 * MB, output_bytes=100 * MB, shuffle_write_bytes=600 * MB), M.WIDE_SHUFFLE),
        (dict(input_bytes=200 * MB, output_bytes=2048 * MB), M.DATA_EXPLOSION),
        (dict(input_bytes=10, output_bytes=100, shuffle_read_bytes=11), M.WIDE_SHUFFLE),
        (dict(input_bytes=0, output_bytes=0, shuffle_read_bytes=11), None),
        (dict(), None),
    ],
)
def test_bottleneck(spark, counters, pattern):
    assert context(spark, [stage(**counters)]).first().bottleneck == pattern


@pytest.mark.parametrize(
    "run_s, cpu_s, categories", [(30, 3, [M.IO_BOUND]), (50, 48, [M.CPU_BOUND]), (30, 15, [])]
)
def test_cpu(spark, run_s, cpu_s, categories):
    row = stage(executor_run_time=run_s * 1000, executor_cpu_time=cpu_s * 10**9)
    assert [f.category for f in findings(spark, [row], rules=["io_bound", "cpu_bound"])] == categories


def test_record_explosion(spark):
    (found,) = findings(spark, [stage(input_records=10_000, output_records=200_000)], rules=["record_explosion"])
    assert (found.severity, found.bottleneck) == (M.WARN, M.RECORD_EXPLOSION)
    assert not findings(spark, [stage(input_records=5, output_records=500)], rules=["record_explosion"])


@pytest.mark.parametrize("failed, tasks, severity", [(2, 100, M.WARN), (15, 10, M.CRIT), (1, 0, M.WARN)])
def test_failures(spark, failed, tasks, severity):
    (found,) = findings(spark, [stage(num_failed_tasks=failed, num_tasks=tasks)], rules=["task_failures"])
    assert found.severity == severity


def test_memory_pressure(spark):
    assert findings(spark, [stage(memory_bytes_spilled=100 * MB)], rules=["memory_pressure"])
    both = stage(memory_bytes_spilled=100 * MB, disk_bytes_spilled=100 * MB)
    assert not findings(spark, [both], rules=["memory_pressure"])


def test_partition_counts(spark):
    rules = ["too_many_partitions", "too_few_partitions"]
    many = stage(1, num_tasks=20_000, input_bytes=20_000 * 1000)
    few = stage(2, num_tasks=2, input_bytes=4 * 1024 * MB)
    none = stage(3, num_tasks=20_000, input_bytes=0, shuffle_read_bytes=0)
    found = {f.stage_id: f for f in findings(spark, [many, few, none], rules=rules)}
    assert found[1].category == M.TOO_MANY_PARTS and "coalesce(1)" in found[1].recommendation
    assert found[2].category == M.TOO_FEW_PARTS and "repartition(32)" in found[2].recommendation
    assert 3 not in found


def test_plan_rules(spark):
    join = "+- SortMergeJoin Inner (6)\n   +- Sort (3)"
    moved = stage(shuffle_write_bytes=MB, executor_run_time=6000)
    assert [f.category for f in findings(spark, [moved], join, ["broadcast_join"])] == [M.BCAST_JOIN]
    assert not findings(spark, [moved], None, ["broadcast_join"])
    udf = "+- Project (3)\n   +- ArrowEvalPython [f(x#1)#2]"
    slow = stage(executor_run_time=40_000, executor_cpu_time=39 * 10**9)
    assert [f.severity for f in findings(spark, [slow], udf, ["python_udf"])] == [M.CRIT]
    deep = "A (1)\n+- B (2)\n   +- C (3)\n      +- BatchEvalPython [g]"
    assert not findings(spark, [slow], deep, ["python_udf"])


def test_io_summary(spark):
    row = stage(input_bytes=3000, output_bytes=1000, shuffle_read_bytes=0, shuffle_write_bytes=2048)
    assert context(spark, [row]).first().io_summary == "in: 2.9 KB, out: 1000 B, shuf_w: 2.0 KB, ratio: 3:1 in:out"
    assert context(spark, [stage(input_bytes=0, output_bytes=0)]).first().io_summary == "no I/O"


def test_cache_opportunity(spark):
    name = 'Spark Connect - session_id: "{}" - collect at x.py:1'
    rows = [stage(i, name=name.format(i), executor_run_time=20_000) for i in range(3)] + [stage(9, executor_run_time=90_000)]
    (found,) = stage_rules.cache_opportunities(context(spark, rows)).collect()
    assert (found.stage_id, found.estimated_savings_ms) == (2, 40_000)  # the larger id of equals
    assert found.title == "'collect at x.py:1' repeated 3 times (total: 1m 0s)"


def test_order(spark):
    rows = [stage(1, disk_bytes_spilled=5, executor_run_time=50_000), stage(2, disk_bytes_spilled=2 * 1024 * MB)]
    found = stage_rules.stage_findings(context(spark, rows), [stage_rules.disk_spill])
    assert [f.stage_id for f in reports.sort_suspects(found).collect()] == [2, 1]
    ranked = reports.rank_suspects(found).collect()
    assert {(r.stage_id, r["rank"]) for r in ranked} == {(2, 1), (1, 2)}
