"""SQL texts that compute what each registered query must return."""

from __future__ import annotations

from emberscope import fixtures as X

MB, GB = 1048576, 1073741824
METRICS = (
    "executor_run_time", "executor_cpu_time", "input_bytes", "input_records", "output_bytes",
    "output_records", "shuffle_read_bytes", "shuffle_read_records", "shuffle_write_bytes",
    "shuffle_write_records", "memory_bytes_spilled", "disk_bytes_spilled", "peak_execution_memory",
)


# -- texts ---------------------------------------------------------------------------------
def f1(x: str) -> str:
    return f"printf('%.1f', CAST({x} AS DOUBLE))"


def f0(x: str) -> str:
    return f"printf('%.0f', CAST({x} AS DOUBLE))"


def pct(x: str) -> str:
    return f"({f0(f'({x}) * 100.0::DOUBLE')} || '%')"


def dur(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN 'N/A' WHEN {x} < 1000 THEN ({x})::VARCHAR || 'ms' "
        f"WHEN {x} < 60000 THEN (({x}) // 1000)::VARCHAR || CASE WHEN ({x}) % 1000 > 0 THEN '.' || ((({x}) % 1000) // 100)::VARCHAR ELSE '' END || 's' "
        f"WHEN {x} < 3600000 THEN (({x}) // 60000)::VARCHAR || 'm ' || ((({x}) // 1000) % 60)::VARCHAR || 's' "
        f"ELSE (({x}) // 3600000)::VARCHAR || 'h ' || ((({x}) // 60000) % 60)::VARCHAR || 'm' END"
    )


def scaled(x: str, steps) -> str:
    text = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN 'N/A'"
    for limit, scale, unit in steps:
        shown = f"({x})::VARCHAR" if scale == 1 else f1(f"({x}) / {scale}.0::DOUBLE")
        when = "ELSE" if limit is None else f"WHEN {x} < {limit} THEN"
        text += f" {when} {shown} || '{unit}'"
    return text + " END"


def byt(x: str) -> str:
    return scaled(x, [(1024, 1, " B"), (1024**2, 1024, " KB"), (1024**3, 1024**2, " MB"),
                      (1024**4, 1024**3, " GB"), (None, 1024**4, " TB")])


def cnt(x: str) -> str:
    return scaled(x, [(1000, 1, ""), (10**6, 1000, "K"), (10**9, 10**6, "M"), (None, 10**9, "B")])


def cut(x: str, n: int) -> str:
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE left({x}, {n - 3}) || '...' END"


REST = "substr(name, 29)"
LABEL = (
    "CASE WHEN starts_with(name, 'Spark Connect - session_id: ') AND strpos(" + REST + ", '\" - ') > 0 "
    "AND length(substr(" + REST + ", strpos(" + REST + ", '\" - ') + 4)) > 0 "
    "THEN trim(substr(" + REST + ", strpos(" + REST + ", '\" - ') + 4)) ELSE name END"
)
BOTTLENECK = (
    f"CASE WHEN input_bytes > {100 * MB} AND output_bytes > 5 * input_bytes THEN 'Data Explosion' "
    f"WHEN input_bytes > {GB} AND input_bytes > 10 * (output_bytes + shuffle_write_bytes) THEN 'Large Scan' "
    f"WHEN shuffle_write_bytes > {500 * MB} OR (shuffle_read_bytes > input_bytes AND input_bytes > 0) THEN 'Wide Shuffle' END"
)
IO = (
    "CASE WHEN greatest(input_bytes, output_bytes, shuffle_read_bytes, shuffle_write_bytes) <= 0 THEN 'no I/O' ELSE concat_ws(', ', "
    + ", ".join(
        f"CASE WHEN {c} > 0 THEN '{t}: ' || {byt(c)} END"
        for t, c in (("in", "input_bytes"), ("out", "output_bytes"), ("shuf_r", "shuffle_read_bytes"), ("shuf_w", "shuffle_write_bytes"))
    )
    + f", CASE WHEN input_bytes > 0 AND output_bytes > 0 AND input_bytes::DOUBLE / output_bytes > 2 THEN 'ratio: ' || {f0('input_bytes::DOUBLE / output_bytes')} || ':1 in:out' END) END"
)

# -- shared tables -------------------------------------------------------------------------
APP_STAGE = "concat('app-', CAST(CAST(floor(stage_id / 30) AS BIGINT) % 7 AS VARCHAR))"
APP_JOB = "concat('app-', CAST(CAST(floor(job_id / 3) AS BIGINT) % 7 AS VARCHAR))"


def _op_lines(prefix: str) -> str:
    return f"""
  SELECT id, pos, CASE WHEN t LIKE '==%' THEN '' WHEN strpos(t, '(') > 0 THEN trim(split_part(t, '(', 1)) ELSE trim(split_part(t, '[', 1)) END AS op
  FROM (SELECT id, pos, trim(regexp_replace(trim(line), '{prefix}', '')) AS t FROM plan_lines)"""


STRICT_PREFIX, LENIENT_PREFIX = r"^\+*-*:*", r"^[\s+\-:|!*]*(\(\d+\))?"


def _ops(prefix: str) -> str:
    return f"""
  SELECT id, op, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn
  FROM (SELECT id, op, min(pos) AS pos FROM ({_op_lines(prefix)}) WHERE op <> '' GROUP BY id, op)"""


def hints(prefix: str = STRICT_PREFIX) -> str:
    return f"SELECT id, string_agg(op, ' → ' ORDER BY rn) AS hint FROM ({_ops(prefix)}) WHERE rn <= 3 GROUP BY id"


DERIVED = {
    **{name: text for name, text in X.VIEWS.items()},
    "plan_lines": "SELECT id, generate_subscripts(string_split(plan_description, chr(10)), 1) AS pos, unnest(string_split(plan_description, chr(10))) AS line FROM sql_executions",
    "hints": hints(),
    "stage_job": "SELECT stage_id, min(job_id) AS job_id FROM job_stages GROUP BY stage_id",
    "job_sql": "SELECT job_id, max(sql_id) AS sql_id FROM sql_jobs GROUP BY job_id",
    "ctx": f"""SELECT s.*, sj.job_id, js.sql_id, e.description AS sql_description, h.hint, {IO} AS io_summary, {BOTTLENECK} AS bottleneck,
      executor_run_time AS run, (executor_cpu_time // 1000000)::DOUBLE / nullif(executor_run_time, 0) AS cpu, ({LABEL}) AS label
    FROM stages s LEFT JOIN stage_job sj ON sj.stage_id = s.stage_id LEFT JOIN job_sql js ON js.job_id = sj.job_id
    LEFT JOIN sql_executions e ON e.id = js.sql_id LEFT JOIN hints h ON h.id = e.id""",
    "run_stats": "SELECT avg(executor_run_time) AS m, stddev_pop(executor_run_time) AS sd, count(*) AS n FROM stages WHERE status = 'COMPLETE' AND executor_run_time > 0",
    "measured": """SELECT stage_id, task_id, input_bytes + shuffle_read_bytes AS size_of, 'duration' AS measure, duration AS v FROM tasks WHERE duration IS NOT NULL
    UNION ALL SELECT stage_id, task_id, input_bytes + shuffle_read_bytes, 'size', input_bytes + shuffle_read_bytes FROM tasks
    UNION ALL SELECT stage_id, task_id, input_bytes + shuffle_read_bytes, 'records', input_records + shuffle_read_records FROM tasks""",
    "tops": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stage_id, measure ORDER BY v DESC, task_id DESC, size_of DESC) AS rn FROM measured) WHERE rn = 1",
    "dists": """SELECT d.*, CASE WHEN median > 0 THEN max_val / median ELSE 0 END AS ratio, t.task_id, t.size_of AS task_bytes FROM (
      SELECT stage_id, measure, count(*) AS n, stddev_pop(v) / avg(v) AS cv, quantile_cont(v, 0.5)::DOUBLE AS median, max(v) AS max_val
      FROM measured GROUP BY stage_id, measure HAVING count(*) >= 2 AND avg(v) > 0) d JOIN tops t USING (stage_id, measure)""",
    "graded": """SELECT *, CASE WHEN cv > 2 OR ratio > 10 THEN 'CRIT' WHEN cv > 1 OR ratio > 3 THEN 'WARN' END AS severity,
      CASE measure WHEN 'duration' THEN 'Data Skew' WHEN 'size' THEN 'Size Skew' ELSE 'Record Skew' END AS category FROM dists""",
    "skews": "SELECT * FROM graded WHERE severity IS NOT NULL AND (measure <> 'records' OR max_val > 1000)",
    "shares": """SELECT *, CASE WHEN stage_bytes > 0 THEN bytes::DOUBLE / stage_bytes ELSE 0 END AS share FROM (
      SELECT *, sum(bytes) OVER (PARTITION BY stage_id)::BIGINT AS stage_bytes, sum(tasks) OVER (PARTITION BY stage_id) AS stage_tasks FROM (
        SELECT stage_id, executor_id, count(*) AS tasks, sum(input_bytes + shuffle_read_bytes)::BIGINT AS bytes,
          sum(coalesce(duration, 0))::BIGINT AS dsum FROM tasks GROUP BY stage_id, executor_id))""",
    "hot": "SELECT * FROM shares WHERE stage_tasks >= 2 AND stage_bytes > 0 AND share > 0.5",
    "critical": """SELECT DISTINCT stage_id FROM (SELECT js.job_id, js.stage_id, row_number() OVER (PARTITION BY js.job_id ORDER BY completion_ms - submission_ms DESC, js.stage_id DESC) AS rn
      FROM job_stages js JOIN stages s ON s.stage_id = js.stage_id WHERE completion_ms IS NOT NULL) WHERE rn = 1""",
    "job_rows": """SELECT j.*, j.completion_ms - j.submission_ms AS duration_ms, js.sql_id, e.description AS sql_description, e.plan_description AS sql_plan
      FROM jobs j LEFT JOIN job_sql js ON js.job_id = j.job_id LEFT JOIN sql_executions e ON e.id = js.sql_id""",
    "cluster": """SELECT coalesce(sum(max_memory), 0)::BIGINT AS total_executor_memory, coalesce(sum(total_cores), 0)::BIGINT AS total_executor_cores, count(*) AS num_executors
      FROM executors WHERE id <> 'driver' AND is_active""",
}

ORDER = tuple(DERIVED)


# -- stage rules ---------------------------------------------------------------------------
def _save(k: float) -> str:
    return f"CAST(trunc(run * {k}::DOUBLE) AS BIGINT)"


EACH = "((input_bytes + shuffle_read_bytes) // nullif(num_tasks, 0))"
TOTAL = "(input_bytes + shuffle_read_bytes)"
LOST = "(num_failed_tasks + num_killed_tasks)"
RATE = f"coalesce({LOST}::DOUBLE / nullif(num_tasks, 0), 0.0)"
PARTS = f"'Total data: ' || {byt(TOTAL)} || ', ' || num_tasks || ' tasks × ' || {byt(EACH)} || ' avg'"
CRIT_IF = "CASE WHEN {} THEN 'CRIT' ELSE 'WARN' END"
RECORDS = "(output_records::DOUBLE / input_records)"

# name: condition, severity, category, bottleneck, savings, title, detail
RULES = {
    "d1": (
        "status = 'COMPLETE' AND run > 0 AND n >= 2 AND run > m + 2 * sd", CRIT_IF.format("run > m + 4 * sd"), "Slow Stage",
        "bottleneck", "CAST(trunc(run - m) AS BIGINT)",
        f"'Stage ' || stage_id || ' took ' || ({dur('run')}) || coalesce(' [' || bottleneck || ']', '')",
        f"'Mean: ' || ({dur('CAST(trunc(m) AS BIGINT)')}) || ', StdDev: ' || ({dur('CAST(trunc(sd) AS BIGINT)')}) || ', ' || {f1('run / m')} || 'x slower than average'",
    ),
    "d2": (
        "disk_bytes_spilled > 0", CRIT_IF.format(f"disk_bytes_spilled > {GB}"), "Disk Spill", "bottleneck", _save(0.3),
        f"'Stage ' || stage_id || ' spilled ' || ({byt('disk_bytes_spilled')}) || ' to disk'",
        f"'Memory spill: ' || ({byt('memory_bytes_spilled')}) || ', Disk spill: ' || ({byt('disk_bytes_spilled')})",
    ),
    "d3": (
        "status = 'COMPLETE' AND run > 10000 AND cpu < 0.3", "'WARN'", "I/O Bound", "NULL", _save(0.2),
        f"'Stage ' || stage_id || ' I/O bound: CPU ratio ' || {pct('cpu')}",
        f"'CPU time ' || ({dur('(executor_cpu_time // 1000000)')}) || ' vs runtime ' || ({dur('run')}) || ' (' || {pct('cpu')} || ' utilization)'",
    ),
    "d4": (
        "status = 'COMPLETE' AND run > 30000 AND cpu > 0.9", "'WARN'", "CPU Bound", "NULL", _save(0.2),
        f"'Stage ' || stage_id || ' CPU saturated: ' || {pct('cpu')} || ' utilization for ' || ({dur('run')})",
        f"'CPU time ' || ({dur('(executor_cpu_time // 1000000)')}) || ' vs runtime ' || ({dur('run')}) || ' — CPU fully utilized'",
    ),
    "d5": (
        "input_records > 1000 AND output_records > 10 * input_records", CRIT_IF.format(f"{RECORDS} > 100"), "Rec Explode",
        "'Record Explosion'", _save(0.5),
        f"'Stage ' || stage_id || ' output ' || {f0(RECORDS)} || 'x more records than input'",
        f"'Input: ' || input_records || ' records → Output: ' || output_records || ' records (' || {f0(RECORDS)} || 'x expansion)'",
    ),
    "d6": (
        "num_failed_tasks > 0 OR num_killed_tasks > 0", CRIT_IF.format(f"{RATE} > 0.1 OR {LOST} > 10"), "Task Fail", "NULL",
        f"CAST(trunc(run * {RATE}) AS BIGINT)",
        f"'Stage ' || stage_id || ' has ' || num_failed_tasks || ' failed + ' || num_killed_tasks || ' killed tasks (' || {pct(RATE)} || ')'",
        "'Total tasks: ' || num_tasks || ', Failed: ' || num_failed_tasks || ', Killed: ' || num_killed_tasks || ', Completed: ' || num_complete_tasks",
    ),
    "d7": (
        f"memory_bytes_spilled > {50 * MB} AND disk_bytes_spilled = 0", "'WARN'", "Mem Pressure", "NULL", _save(0.1),
        f"'Stage ' || stage_id || ' memory spill ' || ({byt('memory_bytes_spilled')}) || ' (no disk spill yet)'",
        f"'Memory spilled: ' || ({byt('memory_bytes_spilled')}) || ', Disk spilled: 0 — approaching disk spill threshold'",
    ),
    "d8a": (
        f"status = 'COMPLETE' AND num_tasks > 10000 AND {TOTAL} <> 0 AND {EACH} < {MB}", "'WARN'", "Too Many Parts", "NULL", _save(0.4),
        f"'Stage ' || stage_id || ' has ' || num_tasks || ' tasks with only ' || ({byt(EACH)}) || '/task avg'", PARTS,
    ),
    "d8b": (
        f"status = 'COMPLETE' AND num_tasks > 0 AND num_tasks <= 8 AND {EACH} > {GB}", "'WARN'", "Too Few Parts", "NULL", _save(0.5),
        f"'Stage ' || stage_id || ' has only ' || num_tasks || ' tasks with ' || ({byt(EACH)}) || '/task avg'", PARTS,
    ),
    "d9": (
        f"status = 'COMPLETE' AND shuffle_write_bytes > 0 AND shuffle_write_bytes < {100 * MB} AND run > 5000 AND (hint LIKE '%SortMerge%' OR hint LIKE '%ShuffledHash%' OR hint LIKE '%Join%')",
        "'WARN'", "Bcast Join", "NULL", _save(0.6),
        f"'Stage ' || stage_id || ' shuffles only ' || ({byt('shuffle_write_bytes')}) || ' — broadcast join candidate'",
        f"'Shuffle write: ' || ({byt('shuffle_write_bytes')}) || ' < 100MB threshold. A broadcast join would eliminate this shuffle.'",
    ),
    "d10": (
        "status = 'COMPLETE' AND run > 5000 AND (hint LIKE '%ArrowEvalPython%' OR hint LIKE '%BatchEvalPython%' OR hint LIKE '%PythonUDF%' OR hint LIKE '%PythonRunner%')",
        CRIT_IF.format("coalesce(cpu, 0) > 0.9 AND run > 30000"), "Python UDF", "NULL", _save(0.5),
        f"'Stage ' || stage_id || ' uses Python UDF (' || ({dur('run')}) || ')'",
        f"'Python UDF detected in SQL plan. CPU utilization: ' || {pct('coalesce(cpu, 0)')}",
    ),
}


def rule(name: str, source: str = "ctx CROSS JOIN run_stats", prefix: str = "") -> str:
    when, severity, category, pattern, savings, title, detail = RULES[name]
    return (
        f"SELECT {prefix}stage_id, job_id, sql_id, {severity} AS severity, '{category}' AS category, CAST({pattern} AS VARCHAR) AS bottleneck, "
        f"{savings} AS estimated_savings_ms, {title} AS title, {detail} AS detail FROM {source} WHERE {when}"
    )


CACHE = f"""SELECT {{app}}stage_id, job_id, sql_id, 'WARN' AS severity, 'Cache Oppty' AS category, CAST(NULL AS VARCHAR) AS bottleneck,
  (total - least)::BIGINT AS estimated_savings_ms, '''' || {cut('label', 40)} || ''' repeated ' || times || ' times (total: ' || ({dur('total')}) || ')' AS title,
  times || ' stages share name ''' || {cut('label', 30)} || '''. Total runtime: ' || ({dur('total')}) || '. Caching could eliminate ' || (times - 1) || ' re-computations.' AS detail
  FROM (SELECT *, count(*) OVER g AS times, sum(run) OVER g ::BIGINT AS total, min(run) OVER g AS least, row_number() OVER (PARTITION BY {{app}}label ORDER BY run DESC, stage_id DESC) AS rn
    FROM ctx WHERE status = 'COMPLETE' AND run > 0 WINDOW g AS (PARTITION BY {{app}}label)) WHERE rn = 1 AND times >= 2 AND total > 30000"""

SKEW_TITLE = f"CASE measure WHEN 'duration' THEN 'Duration skew' WHEN 'size' THEN 'Data size skew' ELSE 'Record count skew' END || ': CV=' || {f1('cv')} || ', max/median=' || {f1('ratio')} || 'x'"
MEDIAN = "CAST(trunc(median) AS BIGINT)"
SKEW_DETAIL = (
    f"CASE measure WHEN 'duration' THEN 'Task #' || task_id || ' took ' || ({dur('max_val')}) || ' (median ' || ({dur(MEDIAN)}) || '), processed ' || ({byt('task_bytes')}) "
    f"WHEN 'size' THEN 'Task #' || task_id || ' processed ' || ({byt('max_val')}) || ' (median ' || ({byt(MEDIAN)}) || ', max ' || ({byt('max_val')}) || ')' "
    f"ELSE 'Task #' || task_id || ' processed ' || max_val || ' records (median ' || {f0('median')} || ', max ' || {f0('max_val')} || ')' END"
)
HOT_TITLE = f"'Executor ' || executor_id || ' handles ' || {pct('share')} || ' of data'"
HOT_DETAIL = f"'Executor ' || executor_id || ' processed ' || ({byt('bytes')}) || ' (' || {pct('share')} || ' of total ' || ({byt('stage_bytes')}) || ') across ' || tasks || ' tasks'"


def _task_rows(columns: str, links: str = "ctx", app: str = "") -> str:
    nothing = "CAST(NULL AS VARCHAR) AS bottleneck, 0::BIGINT AS estimated_savings_ms"
    using = "stage_id"
    a = "c.app_id, " if app else ""
    return f"""SELECT {a}{columns} FROM (SELECT stage_id, severity, category, {SKEW_TITLE} AS title, {SKEW_DETAIL} AS detail, {nothing} FROM skews
      UNION ALL SELECT stage_id, 'WARN', 'Exec Hotspot', {HOT_TITLE}, {HOT_DETAIL}, {nothing} FROM hot) f
      LEFT JOIN {links} c USING ({using})"""


FOUND = "stage_id, job_id, sql_id, severity, category, bottleneck, estimated_savings_ms, title"
TASK_FOUND = "stage_id, c.job_id, c.sql_id, f.severity, f.category, f.bottleneck, f.estimated_savings_ms, f.title"
ALL_RULES = " UNION ALL ".join(f"SELECT {FOUND} FROM ({rule(r)})" for r in RULES)
SUSPECTS = f"{ALL_RULES} UNION ALL SELECT {FOUND} FROM ({CACHE.format(app='')}) UNION ALL {_task_rows(TASK_FOUND)}"
REMEDIES_SQL = "CASE bottleneck WHEN 'Large Scan' THEN '{}' WHEN 'Wide Shuffle' THEN '{}' WHEN 'Data Explosion' THEN '{}' END"


#: The texts of the remedies, stated here on their own.
REMEDY_TEXTS = (
    "Read less: select the columns you need and filter on partition columns such as date or region before anything else.",
    "Shuffle less: join small tables with broadcast(small_df) and aggregate before the join.",
    "Filter before explode() and make sure that no join lacks its condition.",
)


def _remedies() -> str:
    return REMEDIES_SQL.format(*[text.replace("'", "''") for text in REMEDY_TEXTS])


DETAILED = " UNION ALL ".join(
    [f"SELECT {FOUND}, detail FROM ({rule(r)})" for r in RULES] + [f"SELECT {FOUND}, detail FROM ({CACHE.format(app='')})", _task_rows(f"{TASK_FOUND}, f.detail")]
)
ADVICE = f"""CASE f.category
  WHEN 'Slow Stage' THEN coalesce({_remedies().replace('CASE bottleneck', 'CASE f.bottleneck')}, 'Look at the code location and at df.explain(True); a large shuffle often means a missing filter or a broad join.')
  WHEN 'Disk Spill' THEN concat_ws(' ', 'Raise spark.executor.memory or use smaller partitions with df.repartition(200).', {_remedies().replace('CASE bottleneck', 'CASE f.bottleneck')})
  WHEN 'I/O Bound' THEN 'Waiting for I/O: cache DataFrames that are read again with df.cache(), raise spark.executor.memory, or repartition for locality.'
  WHEN 'CPU Bound' THEN 'CPU is the limit: use built-in functions or @pandas_udf instead of @udf, cache with df.cache(), and raise parallelism with df.repartition(N).'
  WHEN 'Rec Explode' THEN 'Filter first and explode later, and give every join an explicit condition.'
  WHEN 'Task Fail' THEN 'Read the executor logs for out-of-memory and fetch failures; consider a larger spark.executor.memory and check spark.task.maxFailures.'
  WHEN 'Mem Pressure' THEN 'Raise spark.executor.memory and spark.executor.memoryOverhead, or use smaller partitions with df.repartition(N).'
  WHEN 'Too Many Parts' THEN 'Use df.coalesce(' || greatest((x.input_bytes + x.shuffle_read_bytes) // 134217728, 1) || ') for partitions of about 128MB.'
  WHEN 'Too Few Parts' THEN 'Use df.repartition(' || greatest((x.input_bytes + x.shuffle_read_bytes) // 134217728, 8) || ') for partitions of about 128MB.'
  WHEN 'Bcast Join' THEN 'Join with broadcast(small_df): the small side then needs no shuffle.'
  WHEN 'Python UDF' THEN 'Use built-in functions such as F.when() and F.expr(), or @pandas_udf; a plain @udf moves the data row by row.'
  WHEN 'Cache Oppty' THEN 'Call df.cache() or df.persist() before the first action and df.unpersist() after the last.'
  WHEN 'Data Skew' THEN 'Repartition, or salt the keys that hold most rows.'
  WHEN 'Size Skew' THEN 'Tasks get unequal amounts of data: repartition by a more even key or salt it.'
  WHEN 'Record Skew' THEN 'Tasks get unequal numbers of records: look for hot keys in joins and groupings.'
  WHEN 'Exec Hotspot' THEN 'One executor does most of the work: check data locality and how partitions are placed.' END"""
SUSPECT_ORDER = "(severity = 'CRIT') DESC, estimated_savings_ms DESC, category, stage_id, title"

# Per application: links inside one application, statistics per application.
APP_TABLES = {
    "stage_job": f"SELECT stage_id, min(job_id) AS job_id FROM job_stages WHERE {APP_STAGE} = {APP_JOB} GROUP BY stage_id",
    "ctx": DERIVED["ctx"].replace("SELECT s.*,", f"SELECT s.*, {APP_STAGE.replace('stage_id', 's.stage_id')} AS app_id,"),
    "run_stats": f"SELECT {APP_STAGE} AS app, avg(executor_run_time) AS m, stddev_pop(executor_run_time) AS sd, count(*) AS n FROM stages WHERE status = 'COMPLETE' AND executor_run_time > 0 GROUP BY 1",
}
APP_SOURCE = "ctx LEFT JOIN run_stats ON app = app_id"
APP_RULES = " UNION ALL ".join(f"SELECT app_id, {FOUND} FROM ({rule(r, APP_SOURCE, 'app_id, ')})" for r in RULES)
APP_SUSPECTS = f"{APP_RULES} UNION ALL SELECT app_id, {FOUND} FROM ({CACHE.format(app='app_id, ')}) UNION ALL {_task_rows(TASK_FOUND, app='x')}"


def _health(suspects: str, jobs: str, stages: str, app: str = "") -> str:
    """Counters by key; without a key the single row has a constant key."""
    key = "app_id" if app else "1"
    part = "PARTITION BY app_id " if app else ""
    out = "k AS app_id, " if app else ""
    return f"""SELECT {out}total_jobs, running_jobs, failed_jobs, total_input_bytes, total_output_bytes, total_shuffle_bytes, critical_count, warning_count, top_issue_1, top_issue_2, top_issue_3
    FROM (SELECT {key} AS k, count(*) AS total_jobs, count(*) FILTER (status = 'RUNNING') AS running_jobs, count(*) FILTER (status = 'FAILED') AS failed_jobs FROM {jobs} GROUP BY 1) a
    JOIN (SELECT {key} AS k, sum(input_bytes)::BIGINT AS total_input_bytes, sum(output_bytes)::BIGINT AS total_output_bytes,
      sum(shuffle_read_bytes + shuffle_write_bytes)::BIGINT AS total_shuffle_bytes FROM {stages} GROUP BY 1) b USING (k)
    JOIN (SELECT {key} AS k, count(*) FILTER (severity = 'CRIT') AS critical_count, count(*) FILTER (severity = 'WARN') AS warning_count,
      max(CASE WHEN rn = 1 AND severity = 'CRIT' THEN issue END) AS top_issue_1, max(CASE WHEN rn = 2 AND severity = 'CRIT' THEN issue END) AS top_issue_2,
      max(CASE WHEN rn = 3 AND severity = 'CRIT' THEN issue END) AS top_issue_3
      FROM (SELECT *, category || ' in stage ' || stage_id AS issue, row_number() OVER ({part}ORDER BY {SUSPECT_ORDER}) AS rn FROM ({suspects})) GROUP BY 1) c USING (k)"""


HEALTH = _health(SUSPECTS, "jobs", "stages")
APP_HEALTH = _health(
    APP_SUSPECTS, f"(SELECT *, {APP_JOB} AS app_id FROM jobs)", f"(SELECT *, {APP_STAGE} AS app_id FROM stages)", "x"
)


# -- bands ---------------------------------------------------------------------------------
def _io_band(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 'default' WHEN {x} < {100 * MB} THEN 'muted' WHEN {x} < {GB} THEN 'ok' WHEN {x} < {10 * GB} THEN 'warning' ELSE 'critical' END"


def _shuffle_band(x: str) -> str:
    return f"CASE WHEN {x} < {100 * MB} THEN 'default' WHEN {x} < {500 * MB} THEN 'warning' ELSE 'critical' END"


def _memory_band(x: str) -> str:
    share = f"({x})::DOUBLE / total_executor_memory"
    return (
        f"CASE WHEN total_executor_memory > 0 THEN CASE WHEN {share} >= 0.8 THEN 'critical' WHEN {share} >= 0.5 THEN 'warning' WHEN {share} >= 0.1 THEN 'ok' ELSE 'default' END "
        f"ELSE CASE WHEN {x} >= {10 * GB} THEN 'critical' WHEN {x} >= {GB} THEN 'warning' WHEN {x} >= {100 * MB} THEN 'ok' ELSE 'default' END END"
    )


CPU = "(executor_cpu_time // 1000000)::DOUBLE / nullif(executor_run_time, 0)"
WALL = "(completion_ms - submission_ms)"
CLOCK = "strftime(make_timestamp(submission_ms * 1000), '%H:%M:%S')"


def _dash(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {byt(x)} ELSE '-' END"


HEADER_IO = "concat_ws('  ', " + ", ".join(
    f"CASE WHEN {s}_bytes > 0 THEN '{t}: ' || ({byt(s + '_bytes')}) || ' (' || ({cnt(s + '_records')}) || ')' END"
    for t, s in (("in", "input"), ("out", "output"), ("shuf_r", "shuffle_read"), ("shuf_w", "shuffle_write"))
) + f", CASE WHEN disk_bytes_spilled > 0 THEN 'spill: ' || ({byt('disk_bytes_spilled')}) || ' (RAM: ' || ({byt('memory_bytes_spilled')}) || ')' END)"
PEAK = "CASE WHEN peak_execution_memory > 0 THEN peak_execution_memory WHEN task_peak > 0 THEN task_peak END"
SECOND = "nullif(ltrim(split_part(sql_plan, chr(10), 2)), '')"

KEYWORDS = (
    "AdaptiveSparkPlan|SortMergeJoin|Sort|Exchange|Scan parquet|Project|ArrowEvalPython|BatchEvalPython|Filter|HashAggregate|PythonUDF"
)

EVENT_ROWS = """SELECT 'app_start' AS kind, 1::BIGINT AS n UNION ALL SELECT 'executor_added', count(*) FROM executors
  UNION ALL SELECT 'sql_start', count(*) FROM sql_executions UNION ALL SELECT 'job_start', count(*) FROM jobs
  UNION ALL SELECT 'stage_submitted', count(*) FROM stages UNION ALL SELECT 'task_end', count(*) FROM tasks
  UNION ALL SELECT 'stage_completed', count(*) FROM stages WHERE completion_ms IS NOT NULL
  UNION ALL SELECT 'job_end', count(*) FROM jobs WHERE status <> 'RUNNING'
  UNION ALL SELECT 'sql_end', count(*) FROM sql_executions WHERE status = 'COMPLETED'
  UNION ALL SELECT 'executor_removed', count(*) FROM executors WHERE NOT is_active
  UNION ALL SELECT 'other', count(*) FROM stages WHERE stage_id % 100 = 0
  UNION ALL SELECT 'malformed', count(*) FROM stages WHERE stage_id % 100 = 1"""

LOGGED_STATUS = "CASE WHEN completion_ms IS NULL THEN 'ACTIVE' WHEN num_failed_tasks > 0 THEN 'FAILED' ELSE 'COMPLETE' END"
STAGE_SUMS = ", ".join(
    (f"max({m})" if m.startswith("peak") else f"sum({m})::BIGINT") + f" AS {m}" for m in METRICS
)
STAGE_METRICS = f"""SELECT stage_id, {STAGE_SUMS}, count(*) FILTER (status <> 'FAILED') AS num_complete_tasks,
  count(*) FILTER (status = 'FAILED') AS num_failed_tasks FROM tasks GROUP BY stage_id"""


def _found(name: str) -> str:
    return f"SELECT {FOUND} FROM ({rule(name)})"


def _k7(cap: str, app: str = "") -> str:
    """Stage attempts in the order of the three lists; the first one met stands for its stage."""
    col = "app_id, " if app else ""
    part = f"PARTITION BY {APP_STAGE} " if app else ""
    source = f"""SELECT *, {APP_STAGE} AS app_id FROM (
        SELECT stage_id, attempt_id, status, num_tasks, executor_run_time AS run, shuffle_write_bytes AS w FROM stages
        UNION ALL SELECT stage_id, 3, status, num_tasks, CASE WHEN stage_id % 2 = 0 THEN executor_run_time * 2 ELSE executor_run_time // 2 END,
          CASE WHEN stage_id % 2 = 0 THEN shuffle_write_bytes ELSE shuffle_write_bytes // 2 END FROM stages WHERE stage_id % 3 = 0
      ) WHERE status IN ('COMPLETE', 'FAILED')"""
    return f"""SELECT * FROM (WITH ended AS ({source}), ranked AS (
      SELECT *, row_number() OVER ({part}ORDER BY run DESC, stage_id, attempt_id) AS a, row_number() OVER ({part}ORDER BY w DESC, stage_id, attempt_id) AS b FROM ended
    ), met AS (
      SELECT *, a AS met_at FROM ranked WHERE a <= 5 UNION ALL SELECT *, 1000000 + b FROM ranked WHERE b <= 5 AND w > 0
      UNION ALL SELECT *, 2000000 + attempt_id FROM ranked WHERE num_tasks > 100
    ), places AS (SELECT {col}stage_id, arg_min(attempt_id, met_at) AS attempt_id, max(run) AS run FROM met GROUP BY {col}stage_id)
    SELECT {col}stage_id, attempt_id FROM (SELECT *, row_number() OVER ({"PARTITION BY app_id " if app else ""}ORDER BY run DESC, stage_id) AS pick FROM places) {cap})"""


def _skew(measure: str) -> str:
    return f"SELECT stage_id, severity, category, task_id, task_bytes, median, max_val FROM skews WHERE measure = '{measure}'"


BODIES: dict[str, str | tuple[str, dict[str, str]]] = {
    "d1_slow_stage": _found("d1"),
    "d2_disk_spill": _found("d2"),
    "d3_io_bound": _found("d3"),
    "d4_cpu_bound": _found("d4"),
    "d5_record_explosion": _found("d5"),
    "d6_task_failures": _found("d6"),
    "d7_memory_pressure": _found("d7"),
    "d8_partition_count": f"{_found('d8a')} UNION ALL {_found('d8b')}",
    "d9_broadcast_join": _found("d9"),
    "d10_python_udf": _found("d10"),
    "d1_slow_stage_by_app": (f"SELECT app_id, {FOUND} FROM ({rule('d1', APP_SOURCE, 'app_id, ')})", APP_TABLES),
    "d11_bottleneck": f"SELECT stage_id, {BOTTLENECK} AS bottleneck FROM stages",
    "d12_remedy": f"SELECT stage_id, {_remedies()} AS remedy FROM ctx WHERE bottleneck IS NOT NULL",
    "d13_io_summary": f"SELECT stage_id, {IO} AS io_summary FROM stages",
    "d14_cache_opportunity": f"SELECT {FOUND} FROM ({CACHE.format(app='')})",
    "d_details": " UNION ALL ".join(
        [f"SELECT stage_id, category, detail FROM ({rule(r)})" for r in RULES] + [f"SELECT stage_id, category, detail FROM ({CACHE.format(app='')})"]
    ),
    "x1_custom_detector": """SELECT stage_id, job_id, 'WARN' AS severity, 'Heavy Write' AS category, 'Stage ' || stage_id || ' writes more than it reads' AS title
      FROM ctx WHERE shuffle_write_bytes > input_bytes""",
    "k1_distribution": "SELECT stage_id, measure, n, round(cv, 6) AS cv, round(ratio, 6) AS max_median_ratio, median, max_val FROM dists",
    "k1_distribution_by_app": f"SELECT {APP_STAGE} AS app_id, stage_id, n, round(cv, 6) AS cv, median, max_val FROM dists WHERE measure = 'size'",
    "k1_one_stage": """SELECT 0::BIGINT AS stage_id, count(v) AS n, round(stddev_pop(v) / avg(v), 6) AS cv, quantile_cont(v, 0.5)::DOUBLE AS median, max(v) AS max_val
      FROM (SELECT 1000000000000 + duration * 1003 + task_id % 1000 AS v FROM tasks)""",
    "k2_skew_severity": "SELECT measure, severity, count(*) AS n FROM graded GROUP BY measure, severity",
    "k3_data_skew": _skew("duration"),
    "k4_size_skew": _skew("size"),
    "k5_record_skew": _skew("records"),
    "k6_executor_hotspot": "SELECT stage_id, executor_id, bytes, round(share, 6) AS share, tasks FROM hot",
    "k7_task_analysis_stages": _k7("WHERE pick <= 15"),
    "k7_task_analysis_stages_uncapped": _k7(""),
    "k7_task_analysis_stages_by_app": _k7("WHERE pick <= 15", "x"),
    "k7_chosen_tasks": f"SELECT stage_id, count(*) AS n, sum(duration)::BIGINT AS duration_sum FROM tasks WHERE stage_id IN (SELECT stage_id FROM ({_k7('WHERE pick <= 15')})) GROUP BY stage_id",
    "k_titles": _task_rows("stage_id, f.category, f.title, f.detail, c.name AS stage_name, c.hint AS sql_plan_hint"),
    "l1_job_to_sql": "SELECT job_id, sql_id FROM job_sql",
    "l2_stage_to_job": "SELECT stage_id, job_id FROM stage_job",
    "l3_job_sql": "SELECT job_id, sql_id, sql_description FROM job_rows",
    "l4_plan_hint": "SELECT stage_id, hint AS sql_plan_hint FROM ctx WHERE hint IS NOT NULL",
    "l4_plan_hint_lenient": ("SELECT stage_id, hint AS sql_plan_hint FROM ctx WHERE hint IS NOT NULL", {"hints": hints(LENIENT_PREFIX)}),
    "l5_stage_context": "SELECT stage_id, job_id, sql_id, sql_description, io_summary, hint AS sql_plan_hint, bottleneck FROM ctx",
    "r1_suspects": f"SELECT row_number() OVER (ORDER BY {SUSPECT_ORDER}) AS rank, {FOUND} FROM ({SUSPECTS})",
    "r1_suspects_by_app": (f"SELECT app_id, row_number() OVER (PARTITION BY app_id ORDER BY {SUSPECT_ORDER}) AS rank, {FOUND} FROM ({APP_SUSPECTS})", APP_TABLES),
    "r2_ranked_jobs": "SELECT row_number() OVER (ORDER BY duration_ms DESC NULLS LAST, job_id) AS rank, job_id, name, status, duration_ms, num_tasks, num_failed_tasks, sql_id, sql_description FROM job_rows",
    "r3_critical_stages": "SELECT stage_id FROM critical",
    "r4_health": HEALTH,
    "r4_health_by_app": (APP_HEALTH, APP_TABLES),
    "r5_stage_hints": "SELECT hint AS sql_plan_hint, count(*) AS stages FROM ctx WHERE hint IS NOT NULL GROUP BY hint",
    "r6_report_sizes": f"""SELECT 'suspects' AS table_name, count(*) AS n FROM ({SUSPECTS}) UNION ALL SELECT 'jobs', count(*) FROM jobs
      UNION ALL SELECT 'critical_stages', count(*) FROM critical UNION ALL SELECT 'stage_hints', count(*) FROM ctx WHERE hint IS NOT NULL
      UNION ALL SELECT 'health', count(*) FROM ({HEALTH}) UNION ALL SELECT 'cluster', count(*) FROM cluster""",
    "r6_report_contents": f"""SELECT 'suspects' AS table_name, severity || ' ' || category AS part, count(*) AS n, sum(estimated_savings_ms)::BIGINT AS total FROM ({SUSPECTS}) GROUP BY ALL
      UNION ALL SELECT 'jobs', status, count(*), sum(job_id)::BIGINT FROM jobs GROUP BY ALL
      UNION ALL SELECT 'critical_stages', 'critical', count(*), sum(stage_id)::BIGINT FROM critical
      UNION ALL SELECT 'stage_hints', hint, count(*), sum(stage_id)::BIGINT FROM ctx WHERE hint IS NOT NULL GROUP BY ALL""",
    "v1_jobs_report": f"""SELECT job_id, status, {CLOCK} AS started, coalesce({dur('duration_ms')}, 'running') AS duration, num_tasks, num_failed_tasks,
      coalesce('#' || sql_id, '-') AS sql, {cut('name', 50)} AS name FROM job_rows""",
    "v2_job_detail": f"""SELECT job_id, stage_id, status, CASE WHEN critical THEN ({cut('label', 27)}) || ' CP' ELSE {cut('label', 30)} END AS name,
      coalesce({dur(WALL)}, 'active') AS duration, num_tasks, {_dash('input_bytes')} AS input, {_dash('output_bytes')} AS output,
      {_dash('shuffle_read_bytes')} AS shuffle_read, {_dash('shuffle_write_bytes')} AS shuffle_write, {_dash('disk_bytes_spilled')} AS spill,
      critical, sql_id, {cut('sql_description', 70)} AS sql_text,
      CASE WHEN sql_plan = '' THEN '(empty plan)' ELSE {cut('split_part(sql_plan, chr(10), 1)', 80)} END AS plan_line_1, {cut(SECOND, 74)} AS plan_line_2
      FROM (SELECT js.job_id, s.*, ({LABEL.replace('name', 's.name')}) AS label, c.stage_id IS NOT NULL AS critical, j.sql_id, j.sql_description, j.sql_plan
        FROM job_stages js JOIN stages s ON s.stage_id = js.stage_id JOIN job_rows j ON j.job_id = js.job_id LEFT JOIN critical c ON c.stage_id = s.stage_id)""",
    "v3_suspect_detail": f"""SELECT f.severity, f.category, coalesce(f.bottleneck, '-') AS pattern, f.stage_id, f.job_id, j.name AS job_name, j.status AS job_status,
      coalesce('#' || f.sql_id, '-') AS sql, {cut('f.title', 50)} AS title, 'Stage ' || f.stage_id || ': ' || x.label AS stage,
      '#' || f.sql_id || ' — ' || {cut("coalesce(x.sql_description, '(no description)')", 70)} AS sql_text, {cut('x.hint', 80)} AS operators, {cut('f.detail', 80)} AS detail,
      CASE WHEN f.category NOT IN ('Data Skew', 'Size Skew', 'Record Skew', 'Exec Hotspot') THEN x.io_summary END AS io_summary, CASE WHEN f.estimated_savings_ms > 0 THEN '~' || ({dur('f.estimated_savings_ms')}) || ' potential savings' END AS savings, {ADVICE} AS recommendation, c.stage_id IS NOT NULL AS critical
      FROM ({DETAILED}) f JOIN ctx x ON x.stage_id = f.stage_id LEFT JOIN jobs j ON j.job_id = f.job_id LEFT JOIN critical c ON c.stage_id = f.stage_id""",
    "v4_sql_recommendations": f"""SELECT f.sql_id, f.severity, '[Stage ' || f.stage_id || ']' AS stage, f.category, f.stage_id, f.title, f.detail, {ADVICE} AS recommendation
      FROM ({DETAILED}) f JOIN stages x ON x.stage_id = f.stage_id WHERE f.sql_id IS NOT NULL""",
    "v5_stage_header": f"""SELECT stage_id, status, num_tasks, label AS name, coalesce({dur(WALL)}, 'active') AS duration, hint AS sql_plan_hint, nullif({HEADER_IO}, '') AS io,
      CASE WHEN run > 0 THEN {pct('cpu')} END AS cpu, CASE WHEN run > 0 THEN 'cpu: ' || ({dur('(executor_cpu_time // 1000000)')}) || ' / runtime: ' || ({dur('run')}) END AS cpu_detail,
      {PEAK} AS peak_memory, {byt(f'({PEAK})')} AS peak_memory_text,
      CASE WHEN peak_execution_memory > 0 THEN 'stage' WHEN task_peak > 0 THEN 'task max' END AS peak_source,
      CASE WHEN ({PEAK}) IS NOT NULL THEN {_memory_band(f'({PEAK})')} END AS memory_band,
      CASE WHEN num_failed_tasks > 0 OR num_killed_tasks > 0 THEN num_failed_tasks || ' failed, ' || num_killed_tasks || ' killed out of ' || num_tasks || ' tasks' END AS failures
      FROM ctx LEFT JOIN (SELECT stage_id AS tsid, max(peak_execution_memory) AS task_peak FROM tasks GROUP BY 1) ON tsid = stage_id CROSS JOIN cluster""",
    "v6_duration_profile": """SELECT stage_id, count(duration) AS n, min(duration)::DOUBLE AS min, round(quantile_cont(duration, 0.5)::DOUBLE, 6) AS median, round(quantile_cont(duration, 0.9)::DOUBLE, 6) AS p90,
      round(quantile_cont(duration, 0.99)::DOUBLE, 6) AS p99, max(duration)::DOUBLE AS max FROM tasks GROUP BY stage_id HAVING count(duration) >= 2""",
    "v7_duration_histogram": """SELECT stage_id, bucket, round(lo, 6) AS lo, round(lo + w, 6) AS hi, n, CAST(trunc(n::DOUBLE / max(n) OVER (PARTITION BY stage_id) * 40) AS BIGINT) AS bar FROM (
      SELECT r.stage_id, b.bucket, lo + b.bucket::DOUBLE * w AS lo, w, count(t.at) AS n
      FROM (SELECT stage_id, min(duration)::DOUBLE AS lo, (max(duration) - min(duration))::DOUBLE / 10 AS w FROM tasks GROUP BY 1 HAVING max(duration) > min(duration)) r
      CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS bucket) b
      LEFT JOIN (SELECT x.stage_id, least(CAST(floor((x.duration - y.least)::DOUBLE / ((y.most - y.least)::DOUBLE / 10)) AS BIGINT), 9) AS at FROM tasks x
        JOIN (SELECT stage_id, min(duration) AS least, max(duration) AS most FROM tasks GROUP BY 1 HAVING max(duration) > min(duration)) y ON x.stage_id = y.stage_id WHERE x.duration IS NOT NULL) t
      ON t.stage_id = r.stage_id AND t.at = b.bucket GROUP BY ALL)""",
    "v8_executor_breakdown": "SELECT stage_id, executor_id, tasks, dsum // tasks AS avg_duration, bytes, round(share * 100, 6) AS pct FROM shares",
    "v9_peak_memory": """SELECT stage_id, max(peak_execution_memory) AS max_memory, (sum(peak_execution_memory) // count(*))::BIGINT AS avg_memory, sum(peak_execution_memory)::BIGINT AS total_memory
      FROM tasks GROUP BY stage_id HAVING max(peak_execution_memory) > 0""",
    "v10_skew_metrics": """SELECT d.stage_id, round(cv, 6) AS cv, round(ratio, 6) AS max_median_ratio, s.task_id, s.executor_id FROM dists d
      JOIN (SELECT stage_id, task_id, executor_id, row_number() OVER (PARTITION BY stage_id ORDER BY coalesce(duration, 0) DESC, task_id DESC, executor_id DESC) AS rn FROM tasks) s
      ON s.stage_id = d.stage_id AND s.rn = 1 WHERE measure = 'duration'""",
    "v11_health_bands": f"""SELECT stage_id, {_io_band('input_bytes')} AS input_band, {_io_band('output_bytes')} AS output_band, {_shuffle_band('shuffle_read_bytes')} AS shuffle_read_band,
      {_shuffle_band('shuffle_write_bytes')} AS shuffle_write_band, CASE WHEN disk_bytes_spilled <= 0 THEN 'default' WHEN disk_bytes_spilled < {GB} THEN 'warning' ELSE 'critical' END AS spill_band,
      CASE WHEN {CPU} >= 0.95 THEN 'critical' WHEN {CPU} >= 0.5 THEN 'ok' WHEN {CPU} >= 0.3 THEN 'warning' WHEN {CPU} IS NOT NULL THEN 'critical' END AS cpu_band,
      {_memory_band('peak_execution_memory')} AS memory_band FROM stages CROSS JOIN cluster""",
    "v12_summary_lines": f"""SELECT 'Jobs: ' || total_jobs || CASE WHEN running_jobs > 0 OR failed_jobs > 0 THEN ' (' || running_jobs || ' running, ' || failed_jobs || ' failed)' ELSE '' END
      || ' | I/O: in ' || ({byt('total_input_bytes')}) || ' out ' || ({byt('total_output_bytes')}) || ' shuffle ' || ({byt('total_shuffle_bytes')}) || ' | '
      || CASE WHEN critical_count > 0 OR warning_count > 0 THEN 'Health: ' || critical_count || ' CRIT ' || warning_count || ' WARN' ELSE 'Health: OK' END AS summary,
      CASE WHEN top_issue_1 IS NULL THEN 'No critical issues detected' ELSE 'Top: ' || concat_ws(', ', top_issue_1, top_issue_2, top_issue_3) END AS issues,
      CASE WHEN critical_count > 0 THEN 'critical' WHEN warning_count > 0 THEN 'warning' ELSE 'ok' END AS state FROM ({HEALTH})""",
    "v13_merge_snapshots": """SELECT stage_id, count(*) AS n, sum(CASE WHEN fresh THEN duration * 2 ELSE duration END)::BIGINT AS duration_sum
      FROM (SELECT *, stage_id % 3 = 0 AND max(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY stage_id) = 1 AS fresh FROM tasks)
      WHERE NOT fresh OR status = 'SUCCESS' GROUP BY stage_id""",
    "v13_bucketed_snapshots": """SELECT stage_id, count(*) AS n, sum(CASE WHEN fresh THEN duration * 2 ELSE duration END)::BIGINT AS duration_sum
      FROM (SELECT *, stage_id % 3 = 0 AND max(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY stage_id) = 1 AS fresh FROM tasks)
      WHERE NOT fresh OR status = 'SUCCESS' GROUP BY stage_id""",
    "v14_plan_operators": f"""SELECT id AS sql_id, token AS operator, count(*) AS n FROM (
      SELECT id, unnest(regexp_extract_all(regexp_replace(line, '^[ +\\-:|!*]*', ''), '({KEYWORDS})(?:[^A-Za-z0-9]|$)', 1)) AS token FROM plan_lines
      WHERE NOT (trim(line) LIKE '==%' AND trim(line) LIKE '%==')) GROUP BY ALL""",
    "v14_plan_numbers": """SELECT id AS sql_id, token, count(*) AS n FROM (
      SELECT id, unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9_#.])([0-9][0-9.]*)(?:[^A-Za-z0-9_.]|$)', 1)) AS token FROM plan_lines
      WHERE NOT (trim(line) LIKE '==%' AND trim(line) LIKE '%==')) GROUP BY ALL""",
    "v14_plan_tokens": """SELECT id AS sql_id, token, count(*) AS n FROM (
      SELECT id, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*#[0-9]+[A-Za-z]?')) AS token FROM plan_lines) GROUP BY ALL""",
    "f_format": f"""SELECT stage_id, {dur('executor_run_time')} AS run_text, {dur('(executor_run_time % 70000 - 5)')} AS short_text, {byt('input_bytes')} AS input_text,
      {byt('(stage_id * stage_id - 9)')} AS small_bytes_text, {_dash('shuffle_write_bytes')} AS write_text, {cnt('output_records')} AS records_text, {cnt('(stage_id - 1)')} AS small_count_text,
      {cut('name', 12)} AS short_name, name || '  x' AS one_line, name || '    x' AS printable, {LABEL} AS label, {CLOCK} AS clock, round({CPU}, 6) AS cpu_ratio FROM stages""",
    "f9_plan_operators": f"SELECT id AS sql_id, rn - 1 AS position, op AS operator FROM ({_ops(STRICT_PREFIX)}) WHERE rn <= 5",
    "f10_parse_time": """SELECT event_id, ms, 1893456000000 - ms AS to_2030 FROM (SELECT event_id, CASE event_id % 6 WHEN 1 THEN epoch_us(ts) // 1000 - 7200000 WHEN 2 THEN epoch_us(ts) // 1000 + 12600000
      WHEN 4 THEN epoch_us(ts) // 1000000 * 1000 WHEN 5 THEN NULL ELSE epoch_us(ts) // 1000 END AS ms FROM events)""",
    "s1_event_log_scan": EVENT_ROWS,
    "s2_compressed_log": EVENT_ROWS,
    "s3_largest_log_file": f"""SELECT app, jobs, coalesce(stages, 0) AS stages, 1::BIGINT AS logs, app = min(app) OVER () AS is_first
      FROM (SELECT {APP_JOB} AS app, count(*) AS jobs FROM jobs WHERE job_id IN (SELECT job_id FROM job_stages WHERE {APP_STAGE} = {APP_JOB}) GROUP BY 1)
      LEFT JOIN (SELECT {APP_STAGE} AS app, count(*) AS stages FROM stages GROUP BY 1) USING (app)""",
    "s4_first_log": "SELECT 'app-1' AS app_id, status, count(*) AS n, 1::BIGINT AS unreadable FROM jobs GROUP BY status",
    "s6_broken_answers": """SELECT 'app-1' AS app_id, 'jobs.json' AS answer, count(*) AS n_rows, count(*) FILTER (job_id % 10 = 0) AS n_broken, count(*) FILTER (job_id % 10 <> 0) AS kept FROM jobs
      UNION ALL SELECT 'app-1', 'stages.json', count(*), count(*) FILTER (stage_id % 7 = 0), count(*) FILTER (stage_id % 7 <> 0) FROM stages""",
    "p1_applications": """SELECT app_id, count(*) AS jobs, sum(job_id)::BIGINT AS job_ids FROM (
      SELECT CASE WHEN job_id % 2 = 0 THEN 'app-1/1' ELSE 'app-1/2' END AS app_id, job_id FROM jobs UNION ALL SELECT 'log three', job_id FROM jobs WHERE job_id % 3 = 0) GROUP BY app_id""",
    "st2_native": STAGE_METRICS,
    "st4_native": """SELECT 'app-1' AS app_id, finish_ms - finish_ms % 60000 AS window_start, count(*) AS n, count(*) FILTER (status = 'FAILED') AS failed, sum(input_bytes + shuffle_read_bytes)::BIGINT AS bytes
      FROM tasks WHERE finish_ms IS NOT NULL GROUP BY 2""",
    "s5_rest_snapshot": """SELECT 'app-1' AS app_id, job_id, status, duration_ms, sql_id, (SELECT count(*) FROM job_stages js JOIN critical c ON c.stage_id = js.stage_id WHERE js.job_id = j.job_id) AS critical_stages
      FROM job_rows j""",
    "s5_rest_arrays": """SELECT 'jobs' AS table_name, count(*) AS n, sum(job_id)::BIGINT AS total FROM jobs UNION ALL SELECT 'stages', count(*), sum(stage_id)::BIGINT FROM stages
      UNION ALL SELECT 'sql_executions', count(*), sum(id)::BIGINT FROM sql_executions WHERE id IN (SELECT sql_id FROM sql_jobs) UNION ALL SELECT 'sql_jobs', count(*), sum(job_id)::BIGINT FROM sql_jobs
      UNION ALL SELECT 'job_stages', count(*), sum(stage_id)::BIGINT FROM job_stages UNION ALL SELECT 'tasks', count(*), sum(task_id)::BIGINT FROM tasks""",
    "s6_rest_array_tasks": f"SELECT 0::BIGINT AS attempt_id, * FROM ({STAGE_METRICS})",
    "s6_rest_tasks": f"SELECT 0::BIGINT AS attempt_id, * FROM ({STAGE_METRICS})",
    "s7_rest_without_sql": """SELECT 'jobs' AS table_name, count(*) AS n FROM jobs UNION ALL SELECT 'stages', count(*) FROM stages
      UNION ALL SELECT unnest(['tasks', 'job_stages', 'sql_executions', 'sql_jobs', 'executors']), 0""",
    "s8_store": (
        f"""SELECT 'tasks' AS table_name, {APP_STAGE} AS app_id, count(*) AS n, sum(task_id)::BIGINT AS total FROM tasks GROUP BY ALL
      UNION ALL SELECT 'stages', {APP_STAGE}, count(*), sum(stage_id)::BIGINT FROM stages GROUP BY ALL
      UNION ALL SELECT 'jobs', {APP_JOB}, count(*), sum(job_id)::BIGINT FROM jobs GROUP BY ALL
      UNION ALL SELECT 'job_stages', {APP_STAGE}, count(*), sum(stage_id)::BIGINT FROM job_stages WHERE {APP_STAGE} = {APP_JOB} GROUP BY ALL
      UNION ALL SELECT 'sql_executions', 'app-' || (id % 7), count(*), sum(id)::BIGINT FROM sql_executions GROUP BY ALL
      UNION ALL SELECT 'sql_jobs', 'app-' || (sql_id % 7), count(*), sum(job_id)::BIGINT FROM sql_jobs GROUP BY ALL
      UNION ALL SELECT 'executors', 'app-0', count(*), sum(total_cores)::BIGINT FROM executors GROUP BY ALL
      UNION ALL SELECT 'suspects', app_id, count(*), sum(estimated_savings_ms)::BIGINT FROM ({APP_SUSPECTS}) GROUP BY ALL
      UNION ALL SELECT 'suspects_json', app_id, count(*), sum(estimated_savings_ms)::BIGINT FROM ({APP_SUSPECTS}) GROUP BY ALL
      UNION ALL SELECT 'health', app_id, count(*), 0 FROM ({APP_HEALTH}) GROUP BY ALL""",
        APP_TABLES,
    ),
    "p2_jobs": """SELECT 'app-1' AS app_id, j.job_id, name, status, submission_ms, completion_ms, n AS num_tasks, CASE WHEN status = 'SUCCEEDED' THEN n ELSE 0 END AS num_completed_tasks,
      CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END::BIGINT AS num_failed_tasks
      FROM jobs j JOIN (SELECT js.job_id, sum(s.num_tasks)::BIGINT AS n FROM job_stages js JOIN stages s ON s.stage_id = js.stage_id GROUP BY 1) t ON t.job_id = j.job_id""",
    "p2_job_stages": "SELECT 'app-1' AS app_id, job_id, stage_id FROM job_stages",
    "p6_stages": f"SELECT 'app-1' AS app_id, stage_id, attempt_id, {LOGGED_STATUS} AS status, name, num_tasks, submission_ms, completion_ms FROM stages",
    "p7_tasks": "SELECT 'app-1' AS app_id, stage_id, task_id, task_index, executor_id, host, status, duration, executor_cpu_time, shuffle_read_bytes, finish_ms FROM tasks",
    "p8_stage_metrics": f"SELECT stage_id, num_complete_tasks, num_failed_tasks, {', '.join(METRICS)} FROM stages",
    "p9_executors": "SELECT 'app-1' AS app_id, id, total_cores, is_active FROM executors",
    "p10_cluster_resources": "SELECT * FROM cluster",
    "p11_sql_executions": """SELECT 'app-1' AS app_id, id, status, description, plan_description, submission_ms, CASE WHEN status = 'COMPLETED' THEN duration ELSE 0 END AS duration FROM sql_executions""",
    "p12_sql_jobs": "SELECT 'app-1' AS app_id, sql_id, job_id, 'success' AS state FROM sql_jobs",
    "st1_growing_log": "SELECT executor_id, status, count(*) AS n, sum(duration)::BIGINT AS duration_sum FROM tasks GROUP BY executor_id, status",
    "st1_stream_tasks": "SELECT executor_id, status, count(*) AS n, sum(duration)::BIGINT AS duration_sum FROM tasks GROUP BY executor_id, status",
    "st2_stream_stage_metrics": STAGE_METRICS,
    "st2_compacted": STAGE_METRICS,
    "st4_stream_health": """SELECT finish_ms - finish_ms % 60000 AS window_start, count(*) AS n, count(*) FILTER (status = 'FAILED') AS failed, sum(input_bytes + shuffle_read_bytes)::BIGINT AS bytes
      FROM tasks WHERE finish_ms IS NOT NULL GROUP BY 1""",
}

for _name, _apps in (("st3_stream_findings", "'app-1', 'log app-2'"), ("st3_two_attempts", "'app-1/1', 'app-1/2'")):
    BODIES[_name] = (
        f"SELECT app_id, category, severity, n, savings FROM (SELECT unnest([{_apps}]) AS app_id) CROSS JOIN ("
        f"SELECT category, severity, count(*) AS n, sum(estimated_savings_ms)::BIGINT AS savings FROM ({SUSPECTS}) GROUP BY category, severity)"
    )


def _uses(name: str, text: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None


def sql_for(body: str | tuple[str, dict[str, str]]) -> str:
    """The body with the tables it needs as common table expressions."""
    text, replaced = body if isinstance(body, tuple) else (body, {})
    tables = {**DERIVED, **replaced}
    needed: set[str] = set()
    todo = [text]
    while todo:
        current = todo.pop()
        for name in ORDER:
            if name not in needed and _uses(name, current):
                needed.add(name)
                todo.append(tables[name])
    ctes = ",\n".join(f"{name} AS ({tables[name].strip()})" for name in ORDER if name in needed)
    return f"WITH {ctes}\n{text}" if ctes else text


def oracle_sql() -> dict[str, str]:
    return {name: sql_for(body) for name, body in BODIES.items()}
