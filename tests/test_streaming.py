import gzip
import json
import random

import pytest

from emberscope.plans.analysis import find_suspects
from emberscope.sources import event_log as log
from emberscope.sources import tailing
from emberscope.streaming import batches, live
from emberscope.workspace import new_folder
from tests.test_event_log import LOG, T0, task_end, text


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text(events, False))


def test_stateful_metrics_equal_batch(spark, tmp_path):
    root = tmp_path / "logs"
    for app in ("a", "b"):
        write(root, f"{app}", LOG)
    stream = live.stream_tasks(live.stream_lines(spark, str(root), 1))
    for mode in ("update", "complete"):
        query = (
            live.live_stage_metrics(live.without_repeats(stream, "10 minutes") if mode == "update" else stream)
            .writeStream.outputMode(mode).format("memory").queryName(f"metrics_{mode}")
            .option("checkpointLocation", new_folder(spark, "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        got = {(r.app_id, r.stage_id, r.num_complete_tasks, r.num_failed_tasks, r.shuffle_read_bytes) for r in spark.table(f"metrics_{mode}").collect()}
        assert got == {("a", 0, 1, 1, 11), ("b", 0, 1, 1, 11)}


def test_watermarked_health(spark, tmp_path):
    root = tmp_path / "logs"
    minute = 60_000
    write(root, "1", [task_end(i, T0, T0 + i * 30_000) for i in range(4)])
    write(root, "2", [task_end(9, T0, T0 + 60 * minute)])
    write(root, "3", [task_end(11, T0, T0 + 120 * minute)])
    write(root, "4", [task_end(10, T0, T0 + 1000), task_end(12, T0, T0 + 180 * minute)])
    import os

    for i, name in enumerate("1234"):  # files are taken in the order of their times
        os.utime(root / name, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = live.stream_tasks(live.stream_lines(spark, str(root), 1))
    query = (
        live.live_health(stream).writeStream.outputMode("append").format("memory").queryName("health")
        .option("checkpointLocation", new_folder(spark, "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.n for r in spark.sql("select n from health where window_start < '2024-01-01 00:01:00'").collect()}
    assert got == {2}  # the row of file 4 that came too late is dropped


def test_rollup_keeps_late_rows_and_repeats_safely(spark, tmp_path):
    root, path, checkpoint = tmp_path / "logs", new_folder(spark, "rollup"), new_folder(spark, "cp")
    write(root, "1", [task_end(i, T0, T0 + i * 30_000) for i in range(4)])

    def run():
        stream = live.stream_tasks(live.stream_lines(spark, str(root), 1))
        live.run_rollup(stream, live.health_batch, path, checkpoint, once=True).awaitTermination()
        rows = live.read_rollup(spark, path, live.HEALTH_ROLLUP).collect()
        return {(r.app_id, r.window_start.hour * 60 + r.window_start.minute): r.n for r in rows}

    assert run() == {("1", 0): 2, ("1", 1): 2}
    assert run() == {("1", 0): 2, ("1", 1): 2}
    write(root, "2", [task_end(9, T0, T0 + 3_600_000), task_end(10, T0, T0 + 1000, "ExceptionFailure")])
    assert run() == {("1", 0): 2, ("1", 1): 2, ("2", 0): 1, ("2", 60): 1}


def test_findings_follow_the_log(spark, tmp_path):
    root, state, checkpoint = tmp_path / "logs", new_folder(spark, "state"), new_folder(spark, "cp")
    skewed = [task_end(i + 10, T0, T0 + (100_000 if i == 19 else 100)) for i in range(20)]
    write(root / "", "first", LOG)

    def run():
        live.run_findings(live.stream_lines(spark, str(root)), state, checkpoint, once=True).awaitTermination()
        return {(r.app_id, r.category) for r in live.current_findings(spark, state).collect()}

    assert run() == {("app-1", "Task Fail"), ("app-1", "Exec Hotspot")}
    other = [dict(LOG[0], **{"App ID": "app-2"}), *LOG[1:7], *skewed]
    write(root, "second", other)
    both = run()
    assert ("app-1", "Task Fail") in both and ("app-2", "Data Skew") in both
    kept = live.FindingState(spark, state)
    written = batches.snapshot(spark, f"{state}/findings").select("app_key", "batch_id").distinct().groupBy("app_key").count()
    assert {r["count"] for r in written.collect()} == {1}
    before = sorted(map(str, live.current_findings(spark, state).collect()))
    kept.compact()
    kept.expire(0)
    assert sorted(map(str, live.current_findings(spark, state).collect())) == before
    write(root, "third", [dict(LOG[0], **{"App ID": "app-2"}), *LOG[1:]])
    assert {a.split("@")[0] for a, _ in run()} == {"app-1", "app-2"} and len({a for a, _ in run()}) == 3


def by_batch(spark, root):
    """The findings of the batch analysis, without the parts that depend on the order of rows."""
    return sorted(map(str, find_suspects(log.read_event_log(spark, str(root)), ["app_id"]).select(*FINDING).collect()))


FINDING = ["app_id", "severity", "category", "stage_id", "title", "detail", "recommendation", "stage_name", "job_id", "sql_id"]


def test_findings_over_batches_equal_one_analysis(spark, tmp_path):
    """Stages whose tasks come in several batches, jobs after their tasks, compaction in between."""
    root, state, checkpoint = tmp_path / "logs", new_folder(spark, "state"), new_folder(spark, "cp")
    folder = root / "eventlog_v2_app-1"
    folder.mkdir(parents=True)
    tasks = [task_end(i + 10, T0, T0 + (100_000 if i == 39 else 100 + i)) for i in range(40)]
    pieces = [[*LOG[:3], *tasks[:15]], [*LOG[3:6], *tasks[15:]], LOG[6:]]
    for number, piece in enumerate(pieces):
        (folder / f"events_{number + 1}_app-1").write_text(text(piece, False))
        live.run_findings(tailing.tail_lines(spark, str(root)), state, checkpoint, once=True, compact_every=2).awaitTermination()
        got = sorted(map(str, live.current_findings(spark, state).select(*FINDING).collect()))
        assert got == by_batch(spark, root)
    assert len(got) > 1


def test_names_of_applications(spark):
    paths = ["file:///x/eventlog_v2_app-7/phase=5/part-0", "file:///x/app-8.zstd", "file:///x/app-9.lz4.inprogress"]
    rows = spark.createDataFrame([(p,) for p in paths], "file string")
    assert [r[0] for r in rows.select(live.app_from_path()).collect()] == ["app-7", "app-8", "app-9"]
    assert json.loads(json.dumps(sorted(log.EVENT_KINDS)))


def test_closed_files_only(spark, tmp_path):
    rolling = tmp_path / "eventlog_v2_x"
    rolling.mkdir()
    for name in ("events_1_x", "events_2_x", "appstatus_x.inprogress"):
        (rolling / name).write_text("{}\n")
    for name in ("app-progress", "s", "ss", "y.inprogress", "inprogress", "z"):
        (tmp_path / name).write_text("{}\n")
    closed = {r.path.split("/")[-1] for r in live.closed_files(spark, str(tmp_path)).collect()}
    assert closed == {"events_1_x", "app-progress", "s", "ss", "inprogress", "z"}
    named = spark.read.option("pathGlobFilter", live.closed_names()).option("recursiveFileLookup", "true").text(str(tmp_path))
    files = {f.split("/")[-1] for f in named.inputFiles()}
    assert files == closed | {"events_2_x"}


def test_compaction_keeps_the_totals(spark):
    path = new_folder(spark, "rollup")
    rows = spark.createDataFrame([("a", 1, 2, 1, 5)], "app_id string, window_start int, n long, failed long, bytes long")
    for i in range(3):
        batches.add_batch(rows, path, i)
    total = lambda: [tuple(r) for r in live.read_rollup(spark, path, live.HEALTH_ROLLUP).collect()]
    assert total() == [("a", 1, 6, 3, 15)]
    assert live.compact_rollup(spark, path, live.HEALTH_ROLLUP) == 2 and total() == [("a", 1, 6, 3, 15)]
    batches.add_batch(rows, path, 3)
    assert total() == [("a", 1, 8, 4, 20)]
    assert batches.expire(spark, path, 3600) == []
    assert len(batches.expire(spark, path, 0)) == 3 and total() == [("a", 1, 8, 4, 20)]
    assert live.compact_rollup(spark, path, live.HEALTH_ROLLUP) == 3 and total() == [("a", 1, 8, 4, 20)]
    assert len(batches.expire(spark, path, 0)) == 2 and total() == [("a", 1, 8, 4, 20)]


def test_a_batch_written_during_compaction_counts_once(spark):
    path = new_folder(spark, "rollup")
    rows = spark.createDataFrame([("a", 1, 1, 0, 0)], "app_id string, window_start int, n long, failed long, bytes long")
    for i in range(2):
        batches.add_batch(rows, path, i)

    def merge(df):
        batches.add_batch(rows, path, 2)  # beside the compaction
        return live.HEALTH_ROLLUP.total(df)

    assert batches.compact(spark, path, merge) == 1
    assert live.read_rollup(spark, path, live.HEALTH_ROLLUP).first()["n"] == 3


def test_a_batch_without_its_mark_is_not_read(spark):
    path = new_folder(spark, "rollup")
    rows = spark.createDataFrame([("a", 1, 1, 0, 0)], "app_id string, window_start int, n long, failed long, bytes long")
    batches.add_batch(rows, path, 0)
    rows.write.parquet(f"{path}/batches/batch_id=1")  # not complete
    rows.write.parquet(f"{path}/bases/upto=1")
    assert live.read_rollup(spark, path, live.HEALTH_ROLLUP).first()["n"] == 1
    batches.add_batch(rows, path, 1)
    assert live.compact_rollup(spark, path, live.HEALTH_ROLLUP) == 1
    assert live.read_rollup(spark, path, live.HEALTH_ROLLUP).first()["n"] == 2


def test_a_growing_rolling_log_arrives_once(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app-1"
    folder.mkdir()
    (folder / "appstatus_app-1.inprogress").write_text("")
    first, second = folder / "events_1_app-1", folder / "events_2_app-1"
    checkpoint, out = new_folder(spark, "cp"), new_folder(spark, "lines")

    def run():
        query = (
            tailing.tail_lines(spark, str(tmp_path)).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return [(r.file.split("/")[-1], r.value) for r in spark.read.parquet(out).orderBy("file", "block").collect()]

    first.write_text("a\nb\nhal")  # the open file ends inside a line
    assert run() == [("events_1_app-1", "a"), ("events_1_app-1", "b")]
    assert len(run()) == 2
    first.write_text("a\nb\nhalf\nc")  # it grew, and then the next file was begun
    second.write_text("d\n")
    assert [v for _, v in run()] == ["a", "b", "half", "c", "d"]
    with second.open("a") as more:
        more.write("é" * 40 + "\nf")
    (tmp_path / "single.inprogress").write_text("x\ny")
    (tmp_path / "packed.json").write_bytes(gzip.compress(b"p\nq\n") + gzip.compress(b"r"))
    (tmp_path / "broken").write_bytes(gzip.compress(b"s\n" * 9)[:-9])
    got = run()
    assert [v for f, v in got if f.startswith("events")] == ["a", "b", "half", "c", "d", "é" * 40]
    assert [v for f, v in got if f == "packed.json"] == ["p", "q", "r"] and [v for f, v in got if f == "single"] == ["x"]
    assert [v for f, v in got if f == "broken"][-1] == tailing.DAMAGED
    (folder / "appstatus_app-1.inprogress").rename(folder / "appstatus_app-1")
    (tmp_path / "single.inprogress").rename(tmp_path / "single")
    got = run()
    assert [v for f, v in got if f.startswith("events")][-1] == "f" and [v for f, v in got if f == "single"] == ["x", "y"]
    assert len(run()) == len(got)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1000])
def test_stretches_cut_no_line(tmp_path, stretch):
    rng = random.Random(stretch)
    for case in range(40):
        body = "".join(rng.choice(["\n", "a", "bé", "ccc\r\n"]) for _ in range(rng.randrange(30))).encode()
        path = tmp_path / f"log{case}"
        path.write_bytes(body)
        reader = tailing.LogTailReader({"path": str(tmp_path), "stretch": str(stretch)})
        key = f"file://{path}"
        cut = body.rfind(b"\n") + 1
        rows = []
        for start, end in ((0, cut), (cut, len(body))):
            for part in reader.partitions({key: start}, {key: end}):
                for batch in tailing.read_stretch(part):
                    rows += zip(batch["block"].to_pylist(), batch["value"].to_pylist())
        want = [line.removesuffix("\r") for line in body.decode().split("\n")]
        assert [v for _, v in sorted(rows)] == (want if want[-1] else want[:-1])
        path.unlink()
