"""Reading physical plan texts with built-in string and array functions."""

from __future__ import annotations

from emberscope.functions.texts import lit, strip

# The plan operators that are counted.
PLAN_OPERATORS = (
    "AdaptiveSparkPlan", "AQEShuffleRead", "BroadcastExchange", "BroadcastHashJoin",
    "BroadcastNestedLoopJoin", "CartesianProduct", "CoalesceExec", "CollectLimit",
    "ColumnarToRow", "CustomShuffleReader", "Exchange", "Expand", "Filter", "Generate",
    "GlobalLimit", "HashAggregate", "InMemoryRelation", "InMemoryTableScan", "LocalLimit",
    "ObjectHashAggregate", "PhotonAdapter", "PhotonGroupingAgg", "PhotonResultStage",
    "PhotonScan", "PhotonShuffleExchangeSink", "PhotonShuffleExchangeSource",
    "PhotonShuffleMapStage", "Project", "ReusedExchange", "Scan parquet", "Scan csv",
    "Scan json", "Scan orc", "Scan delta", "ShuffleExchangeExec", "Sort", "SortAggregate",
    "SortMergeJoin", "SubqueryBroadcast", "TakeOrderedAndProject", "Union",
    "WholeStageCodegen", "Window", "WindowExec", "WindowGroupLimit", "ArrowEvalPython",
    "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF", "PythonUDAF",
    "PythonUDTF",
)

# How the other parts of a plan line look.
TREE_PREFIX = r"^[ +\-:|!*]*"
COLUMN_REF = r"[A-Za-z_][A-Za-z0-9_]*#[0-9]+[A-Za-z]?"
QUOTED = r"'(?:[^'\\]|\\.)*(?:'|$)|\"(?:[^\"\\]|\\.)*(?:\"|$)"
NUMBER = r"(?<![A-Za-z0-9_#])[0-9][0-9.]*+(?![A-Za-z_])"

HINT_SEPARATOR = " → "


def plan_lines(plan: str) -> str:
    return f"split({plan}, '\\n', -1)"


def _operator_name(line: str, strict: bool) -> str:
    # strict: plus, minus and colon marks are each taken off once, in that order, so a
    # join child keeps part of its marker; otherwise the whole tree marker goes.
    marker = r"^\+*-*:*" if strict else r"^[\s+\-:|!*]*(\(\d+\))?"
    text = strip(f"regexp_replace({strip(line)}, r'{marker}', '')")
    name = f"if(instr({text}, '(') > 0, substring_index({text}, '(', 1), substring_index({text}, '[', 1))"
    return f"if(startswith({text}, '=='), '', {strip(name)})"


def plan_operators(plan: str, strict: bool = True) -> str:
    """Distinct operator names in order of appearance."""
    names = f"transform({plan_lines(plan)}, line -> {_operator_name('line', strict)})"
    return f"array_distinct(filter({names}, name -> name <> ''))"


def top_operators(plan: str, n: int, strict: bool = True) -> str:
    return f"slice({plan_operators(plan, strict)}, 1, {n})"


def plan_hint(plan: str, n: int = 3, strict: bool = True) -> str:
    """The first ``n`` operators as one text, NULL when there is none."""
    return f"nullif(array_join({top_operators(plan, n, strict)}, {lit(HINT_SEPARATOR)}), '')"


def operator_pattern() -> str:
    """Listed operators in listed order; the word may not go on after the match."""
    return "(?:" + "|".join(PLAN_OPERATORS) + ")(?![A-Za-z0-9])"


def token_pattern() -> str:
    return "|".join([operator_pattern(), COLUMN_REF, QUOTED, NUMBER])


def line_tokens(line: str) -> str:
    """Operators, column references, quoted texts and numbers of one plan line."""
    content = f"regexp_replace({line}, r'{TREE_PREFIX}', '')"
    heading = f"startswith({strip(line)}, '==') AND endswith({strip(line)}, '==')"
    return f"if({heading}, NULL, regexp_extract_all({content}, {lit(token_pattern())}, 0))"


def token_kind(token: str) -> str:
    operators = ", ".join(lit(name) for name in PLAN_OPERATORS)
    return (
        f"CASE WHEN {token} IN ({operators}) THEN 'operator'"
        f" WHEN left({token}, 1) IN ({lit(chr(39))}, {lit(chr(34))}) THEN 'quoted'"
        f" WHEN {token} RLIKE '^[0-9]' THEN 'number' ELSE 'column' END"
    )
