import datetime as dt

import pytest

from emberscope.functions import bands, plan_text, texts, times


def evaluate(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").selectExpr(f"{expression} AS x").collect()]


def test_durations(spark):
    ms = [0, 500, 999, 1000, 1050, 1500, 60000, 90000, 3600000, 3660000, -1, None]
    want = ["0ms", "500ms", "999ms", "1s", "1.0s", "1.5s", "1m 0s", "1m 30s", "1h 0m", "1h 1m", "N/A", None]
    assert evaluate(spark, ms, "bigint", texts.duration_text("v")) == want


def test_bytes(spark):
    sizes = [0, 512, 1024, 1536, 2**20, 2**30, 2**40, -1]
    want = ["0 B", "512 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 GB", "1.0 TB", "N/A"]
    assert evaluate(spark, sizes, "bigint", texts.bytes_text("v")) == want
    assert evaluate(spark, [0, 1], "bigint", texts.bytes_or_dash("v")) == ["-", "1 B"]
    assert evaluate(spark, [1280, 1300], "bigint", texts.bytes_text("v")) == ["1.2 KB", "1.3 KB"]  # tie to even


def test_counts(spark):
    counts = [0, 999, 1500, 1_500_000, 2_500_000_000, -1]
    assert evaluate(spark, counts, "bigint", texts.count_text("v")) == ["0", "999", "1.5K", "1.5M", "2.5B", "N/A"]


@pytest.mark.parametrize(
    "text, limit, want", [("hello", 10, "hello"), ("hello world", 8, "hello..."), ("hi", 2, "hi"), ("hello", 3, "hel"), ("éééé", 6, "ééé...")]
)
def test_shorten(spark, text, limit, want):
    assert evaluate(spark, [text], "string", texts.shorten("v", limit)) == [want]


def test_stage_label(spark):
    names = [
        "count at a.py:1", 'Spark Connect - session_id: "0-1" - collect at b.py:2 ',
        'Spark Connect - session_id: "0-1"', 'Spark Connect - session_id: "x" - a " - b', 'Spark Connect - session_id: "x" - ',
    ]
    want = [names[0], "collect at b.py:2", names[2], 'a " - b', names[4]]
    assert evaluate(spark, names, "string", texts.stage_label("v")) == want


def test_plain_texts(spark):
    assert evaluate(spark, ["a\nb", "a\r\nb", "a\tb"], "string", texts.one_line("v")) == ["a b", "a  b", "a b"]
    assert evaluate(spark, ["a\tb\x07\r\nc"], "string", texts.printable("v")) == ["a    bc"]
    assert evaluate(spark, ["it's \\ {}"], "string", texts.fill("<{}> it's \\n", "v")) == ["<it's \\ {}> it's \\n"]


def test_cpu_ratio(spark):
    assert evaluate(spark, [1_999_999, 3_000_000], "bigint", texts.cpu_ratio("v", "2")) == [0.5, 1.5]
    assert evaluate(spark, [5], "bigint", texts.cpu_ratio("v", "0")) == [None]


PLAN = "== Physical Plan ==\n* HashAggregate (5)\n+- Exchange hashpartitioning(k#1, 200)\n   :- Scan parquet db.a [k#1]\n   +- *(1) Filter isnotnull(k#1)"


def test_plan_operators(spark):
    four = "+- Project (4)\n   +- Sort [k#1]\n      +- Project (2)\n         +- Exchange"
    assert evaluate(spark, [four], "string", plan_text.top_operators("v", 5)) == [["Project", "Sort", "Exchange"]]
    assert evaluate(spark, [four], "string", plan_text.top_operators("v", 2)) == [["Project", "Sort"]]
    assert evaluate(spark, [""], "string", plan_text.top_operators("v", 5)) == [[]]
    assert evaluate(spark, ["", PLAN], "string", plan_text.plan_hint("v")) == [
        None, "* HashAggregate → Exchange hashpartitioning → - Scan parquet db.a"
    ]
    assert evaluate(spark, [PLAN], "string", plan_text.plan_operators("v", False)) == [
        ["HashAggregate", "Exchange hashpartitioning", "Scan parquet db.a", "Filter isnotnull"]
    ]


def test_plan_tokens(spark):
    lines = ["   +- *(1) Filter isnotnull(k#1L)", "== Plan ==", "Sort 'a Sort' MySort SortX x1 12 1.5x 7", "ShuffleExchange Scan parquet"]
    assert evaluate(spark, lines, "string", plan_text.line_tokens("v")) == [
        ["1", "Filter", "k#1L"], None, ["Sort", "'a Sort'", "Sort", "12", "7"], ["Exchange", "Scan parquet"]
    ]


def test_times(spark):
    same = ["2024-01-15T10:30:00.000+00:00", "2024-01-15T12:30:00+02:00", "2024-01-15 10:30:00.000+0000", "2024-01-15T10:30:00.000GMT", "2024-01-15T10:30:00", "2024-01-15T10:30:00Z"]
    assert set(evaluate(spark, same, "string", f"unix_millis({times.parse_time('v')})")) == {1705314600000}
    assert evaluate(spark, ["2024-01-15", "junk", "", None], "string", times.parse_time("v")) == [None] * 4
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert evaluate(spark, ["2024-01-15T10:30:00"], "string", times.clock_text(times.parse_time("v"))) == ["10:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    start = dt.datetime(2024, 1, 15)
    assert evaluate(spark, [start, None], "timestamp", times.elapsed_ms("v", "v + INTERVAL '5.5' SECOND")) == [5500, None]
    assert evaluate(spark, [None], "timestamp", times.clock_text("v")) == ["-"]


def test_bands(spark):
    mb, gb = 2**20, 2**30
    assert evaluate(spark, [0, 1, 100 * mb, gb, 10 * gb], "bigint", bands.io_band("v")) == ["default", "muted", "ok", "warning", "critical"]
    assert evaluate(spark, [0, 100 * mb, 500 * mb], "bigint", bands.shuffle_band("v")) == ["default", "warning", "critical"]
    assert evaluate(spark, [0, 1, gb], "bigint", bands.spill_band("v")) == ["default", "warning", "critical"]
    assert evaluate(spark, [0.1, 0.3, 0.5, 0.95], "double", bands.cpu_band("v")) == ["critical", "warning", "ok", "critical"]
    assert evaluate(spark, [9, 10, 50, 80], "bigint", bands.memory_band("v", "100")) == ["default", "ok", "warning", "critical"]
    assert evaluate(spark, [1, 100 * mb, gb, 10 * gb], "bigint", bands.memory_band("v", "0")) == ["default", "ok", "warning", "critical"]
