"""How much is written and shuffled: packed inputs, tasks dealt out as they are."""

import gzip
import json
import re

import pytest
from pyspark.sql import functions as F
from rows import frame, task

from checks import queries
from emberscope import fixtures
from emberscope import model as M
from emberscope.operators import quantiles, task_rules
from emberscope.sources import event_log as log
from emberscope.sources import json_arrays, store
from emberscope.streaming import batches

SF_DIR = "/root/testdata/sf0.001"


def names(path, pattern="*"):
    return [p.name for p in path.rglob(pattern) if p.is_file() and p.name.startswith(("part-", "events_"))]


def test_task_lines_of_derived_logs_are_packed(spark, tmp_path):
    fixtures.attempt_log(spark, SF_DIR, str(tmp_path / "attempts"), 1)
    assert all(n.endswith(".gz") for n in names(tmp_path / "attempts"))
    for root in (fixtures.event_log(spark, SF_DIR), fixtures.two_logs(spark, SF_DIR), fixtures.rest_snapshot(spark, SF_DIR)):
        files = log.log_files(spark, root).where("path LIKE '%part-%'").collect()
        assert files and all(f.path.endswith(".gz") for f in files)


def test_growing_log_keeps_closed_files(spark, tmp_path):
    fixtures.grown_log(spark, SF_DIR, str(tmp_path), False)
    first = {p.name: p.read_bytes() for p in tmp_path.rglob("events_*")}
    fixtures.grown_log(spark, SF_DIR, str(tmp_path), True)
    then = {p.name: p.read_bytes() for p in tmp_path.rglob("events_*")}
    assert all(then[n] == b if n.endswith(".gz") else then[n].startswith(b) for n, b in first.items())
    assert sum(len(then[n]) > len(b) for n, b in first.items()) > 2  # plain files grow
    lines = [x for n, b in then.items() for x in (gzip.decompress(b) if n.endswith(".gz") else b).decode().splitlines()]
    want = [r.value for r in fixtures.event_lines(fixtures.telemetry(spark, SF_DIR)).select("value").collect()]
    assert sorted(lines) == sorted(want)


def test_packed_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_arrays, "_BLOCK", 1 << 10)
    items = [{"id": i, "text": f'a "quoted", [text] \\ {i}'} for i in range(3000)]
    packed = gzip.compress(json.dumps(items).encode())
    (tmp_path / "whole.json.gz").write_bytes(packed)
    (tmp_path / "members.json.gz").write_bytes(gzip.compress(b"[1,") + gzip.compress(b"2]"))
    (tmp_path / "object.json.gz").write_bytes(gzip.compress(b'{"id": 1}'))
    (tmp_path / "cut.json.gz").write_bytes(packed[: len(packed) // 2])
    got = {}
    for r in json_arrays.array_elements(spark, f"{tmp_path}/*.gz", 100).collect():
        got.setdefault(r["file"].split("/")[-1], []).append(r["value"])
    assert [json.loads(v) for v in got["whole.json.gz"]] == items
    assert got["members.json.gz"] == ["1", "2"] and got["object.json.gz"] == ['{"id": 1}']
    *kept, broken = got["cut.json.gz"]
    assert 0 < len(kept) < 3000 and [json.loads(v) for v in kept] == items[: len(kept)]
    with pytest.raises(json.JSONDecodeError):
        json.loads(broken)


def test_gzip_without_suffix_is_not_shuffled(spark, tmp_path):
    (tmp_path / "packed").write_bytes(gzip.compress(b'{"Event":"a"}\n{"Event":"b"}'))
    (tmp_path / "plain").write_bytes(b'{"Event":"c"}\n')
    lines = log.read_lines(spark, str(tmp_path))
    assert sorted(r.value for r in lines.collect()) == ['{"Event":"a"}', '{"Event":"b"}', '{"Event":"c"}']
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(?<!Broadcast)Exchange hashpartitioning", plan)


def test_task_rows_are_dealt_out_not_buffers(spark):
    tasks = frame(spark, "tasks", [task(i, stage_id=i % 3) for i in range(30)])
    for df in (task_rules.executor_totals(tasks), task_rules.measure_counts(tasks)):
        assert "REPARTITION_BY_COL" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [4, quantiles.LARGE_GROUP])
def test_both_ways_of_totals_and_counts(spark, monkeypatch, large):
    rows = [task(i, stage_id=i % 3 if i < 12 else None, duration=None if i % 5 == 0 else i * i % 17, input_bytes=i * 7 % 23) for i in range(40)]
    tasks = frame(spark, "tasks", rows)
    want = task_rules._totals(tasks.select("stage_id", "executor_id", "task_id", "peak_execution_memory", *task_rules._measured(task_rules.MEASURES)), ["stage_id"])
    counts = quantiles.value_counts(task_rules._long(tasks.select("stage_id", *task_rules._measured(task_rules.MEASURES)), ["stage_id"], task_rules.MEASURES, "value"), ["stage_id", "measure"], "value")
    parted = quantiles.parted
    monkeypatch.setattr(task_rules, "parted", lambda df, sizes, keys, _=None: parted(df, sizes, keys, large))
    simple = lambda df: sorted(str([f"{v:.9g}" if isinstance(v, float) else str(v) for v in r]) for r in df.collect())
    assert simple(task_rules.executor_totals(tasks)) == simple(want)
    assert simple(task_rules.measure_counts(tasks).select(*counts.columns)) == simple(counts)
    found = task_rules.distributions(tasks)
    given = task_rules.distributions(None, totals=task_rules.executor_totals(tasks), counts=task_rules.measure_counts(tasks))
    assert simple(found) == simple(given) and found.count() > 0


@pytest.mark.parametrize("large", [4, quantiles.LARGE_GROUP])
def test_spreads_are_what_totals_and_counts_tell(spark, large):
    rows = [task(i, stage_id=i % 3 if i < 12 else i % 2 + 3 if i < 18 else None, executor_id=f"e{i % 7 % 2}", duration=None if i % 5 == 0 else i * i % 17, input_bytes=i * 7 % 23) for i in range(40)]
    tasks = frame(spark, "tasks", rows)
    simple = lambda df: sorted(str([f"{v:.9g}" if isinstance(v, float) else str(v) for v in r]) for r in df.collect())
    totals, spreads = task_rules.executor_totals(tasks), task_rules.stage_spreads(tasks, large=large)
    found = task_rules.distributions(None, spreads=spreads)
    assert simple(found) == simple(task_rules.distributions(None, totals=totals, counts=task_rules.measure_counts(tasks))) and found.count() > 9
    shares = task_rules._shares_of_spreads(spreads, ())
    assert simple(shares) == simple(task_rules.executor_shares(None, (), totals).select(*shares.columns))
    assert simple(task_rules.hotspots(None, spreads=spreads)) == simple(task_rules.hotspots(tasks).select(*shares.columns))


def test_tasks_are_dealt_out_once_for_moments_and_medians(spark):
    tasks = frame(spark, "tasks", [task(i, stage_id=i % 3) for i in range(30)])
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL")
    assert dealt(task_rules.stage_spreads(tasks)) == dealt(task_rules.distributions(tasks)) == 1
    spreads = task_rules.stage_spreads(tasks)
    assert dealt(task_rules.distributions(None, spreads=spreads)) == dealt(task_rules.hotspots(None, spreads=spreads)) == 1


def test_sizes_are_counted_by_cell_first(spark, monkeypatch):
    df = spark.createDataFrame([(None if i % 7 == 0 else i * i % 13, "x" if i % 2 else None) for i in range(90)], "a int, b string")
    want = sorted(map(str, df.groupBy("a", "b").count().where("count > 4").collect()))
    for cells in (1, 5, quantiles.SIZE_CELLS):
        monkeypatch.setattr(quantiles, "SIZE_CELLS", cells)
        assert sorted(map(str, quantiles.large_sizes(df, ["a", "b"], 4).withColumnRenamed("n", "count").collect())) == want and len(want) > 3
    tasks = frame(spark, "tasks", [task(i, stage_id=i % 3) for i in range(30)])
    for made in (task_rules.stage_spreads, task_rules.executor_totals, task_rules.measure_counts):
        assert "pmod(xxhash64(stage_id" in made(tasks)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [31, quantiles.LARGE_GROUP])
def test_stages_are_made_where_their_tasks_are_dealt_to(spark, large):
    view = fixtures._view
    want = view(spark, fixtures.STAGES, part=fixtures.source(spark, SF_DIR, "part"), tasks=fixtures.task_table(spark, SF_DIR))
    got = fixtures.stage_table(spark, SF_DIR, large)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_partkey") >= 1 and "REPARTITION_BY_COL" in plan


def test_only_what_is_returned_is_ranked(spark, monkeypatch):
    ranked = []
    monkeypatch.setattr(queries.reports, "rank_suspects", lambda found, by=(): (ranked.append(set(found.columns)), found.withColumn("rank", F.lit(1)))[1])
    monkeypatch.setattr(queries.analysis, "find_suspects", lambda t, by=(): spark.createDataFrame([], ", ".join(f"{n} string" for n in [*by, *M.SUSPECT_COLUMNS])))
    for name, by in (("r1_suspects", []), ("r1_suspects_by_app", ["app_id"])):
        queries.QUERIES[name](spark, SF_DIR)
        assert ranked.pop() == {*by, *queries.FINDING}


def test_a_few_applications_are_broadcast_to_their_tasks(spark):
    tables = log.telemetry_of(fixtures.staged_events(spark, SF_DIR))
    for name in ("tasks", "jobs"):
        plan = getattr(tables, name)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [app_key" in plan and "SortMergeJoin [app_key#" not in plan.split("BroadcastHashJoin [app_key")[0]


def test_events_are_written_without_a_sort(spark, tmp_path):
    name, path = "spark.sql.maxConcurrentOutputFileWriters", str(tmp_path / "events")
    before, planned = spark.conf.get(name, None), []
    lines = log.read_lines(spark, fixtures.event_log(spark, SF_DIR))
    with pytest.MonkeyPatch.context() as patch:
        from pyspark.sql.readwriter import DataFrameWriter

        write = DataFrameWriter.parquet
        patch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (planned.append(spark.conf.get(name, None)), write(self, *a, **k))[1])
        events = log.stage_events(log.parse_lines(lines), path)
    assert planned == ["2"] and spark.conf.get(name, None) == before
    assert events.where("part = 'tasks'").count() == events.where("kind = 'task_end'").count() > 0
    assert events.where("part = 'others'").count() > 0


def test_what_is_written_in_between_is_zstd(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "'task_end' AS kind")
    log.stage_events(rows, str(tmp_path / "events"))
    batches.add_batch(rows, str(tmp_path / "rollup"), 0)
    assert batches.compact(spark, str(tmp_path / "rollup"), lambda df: df) == 0
    kept = [f.split("/")[-1] for f in store.written(rows, "zstd").inputFiles()]
    found = names(tmp_path, "*.parquet") + kept
    assert len(found) >= 4 and all(n.endswith(".zstd.parquet") for n in found)


def test_applications_do_not_sort_all_lines(spark):
    events = fixtures.staged_events(spark, SF_DIR)
    plan = log.applications(events)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert any("pos:struct" in scan for scan in scans) and all("= others" in scan for scan in scans if "pos:struct" in scan)
    assert [r.app_id for r in log.applications(events).collect()] == ["app-1"]
