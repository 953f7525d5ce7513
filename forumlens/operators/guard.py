"""Ad-hoc SQL that may only read the allowed tables.

A statement is parsed by Spark and its unresolved plan is looked at before
anything is analysed or run. What is not known to be harmless is refused:
kinds of plan nodes and of expressions, tables and functions each have a list of
what is allowed. The analysed plan is looked at once more before it is returned,
for what a harmless form could still have been resolved to.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

TABLES = ("evidence_units", "labels")

# Plan nodes a query is made of. Commands and anything newer are not among them.
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct",
    "Union", "Intersect", "Except", "Join", "LateralJoin", "SubqueryAlias",
    "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "UnresolvedWith", "UnresolvedRelation",
    "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "OneRowRelation$", "WithWindowDefinition",
    "Window", "Pivot", "Unpivot", "UnresolvedOrdinal",
}

# Expressions the parser makes of operators, literals, names and special forms.
# A function named by a computed text, a parameter or anything newer is not here.
EXPRESSIONS = set("""
    Add Alias And AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat
    CreateNamedStruct CreateStruct Cube CurrentDate CurrentRow$ CurrentTimestamp Divide EqualNullSafe EqualTo
    Exists Extract GreaterThan GreaterThanOrEqual GroupingSets In InSubquery IntegralDivide IsNotNull IsNull
    LambdaFunction LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Lower
    Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup ScalarSubquery SortOrder
    SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract
    UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute
    UnresolvedExtractValue UnresolvedFunction UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar
    UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition
""".split())
# Classes that no analysed query may hold, by the start of their name.
REACHING_OUT = (
    "CallMethodViaReflection", "InputFile", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaAggregator",
    "ScalaUDAF", "HiveSimpleUDF", "HiveGenericUDF", "HiveUDAF", "ApplyFunctionExpression", "Invoke", "StaticInvoke",
    "CurrentUser", "SparkVersion", "CurrentCatalog", "CurrentDatabase",
)

# Functions a query may call.
FUNCTIONS = set("""
    abs acos aggregate any any_value approx_count_distinct array array_agg array_contains array_distinct
    array_join array_max array_min array_position array_size array_sort arrays_overlap asin atan avg
    between bool_and bool_or bround btrim cardinality cast ceil ceiling char_length character_length
    coalesce collect_list collect_set concat concat_ws contains corr count count_if cume_dist curdate
    current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc
    dateadd datediff datepart day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exists
    exp extract filter first first_value floor format_number get greatest hour if ifnull ilike in initcap
    instr int isnan isnotnull isnull lag last last_day last_value lcase lead least left len length levenshtein
    like ln locate log log10 lower lpad ltrim make_date map max max_by mean median min min_by minute mod
    month nth_value ntile nullif nullifzero nvl nvl2 overlay percent_rank percentile percentile_approx pmod
    position pow power quarter rank regexp regexp_count regexp_extract regexp_instr regexp_like
    regexp_replace regr_slope replace reverse right rlike round row_number rpad rtrim second sign size
    skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp
    string struct substr substring substring_index sum timestamp to_char to_date to_timestamp transform
    trim trunc try_add try_avg try_divide try_sum try_to_timestamp typeof ucase upper var_pop var_samp
    variance weekday weekofyear width_bucket year zeroifnull
""".split())


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _check_expression(expression, tables: frozenset[str]) -> str | None:
    kind = _kind(expression)
    if kind == "UnresolvedFunction":
        parts = [str(p) for p in _items(expression.nameParts())]
        if len(parts) > 1 or parts[0].lower() not in FUNCTIONS:
            return f"function is not allowed: {'.'.join(parts)}"
    elif kind not in EXPRESSIONS:
        return f"expression is not allowed: {kind}"
    # Scalar, EXISTS and IN subqueries hold a plan of their own.
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        reason = _check_plan(expression.plan(), tables)
        if reason:
            return reason
    for child in _items(expression.children()):
        reason = _check_expression(child, tables)
        if reason:
            return reason
    return None


def _check_plan(plan, tables: frozenset[str]) -> str | None:
    kind = _kind(plan)
    if kind == "UnresolvedTableValuedFunction":
        return "table functions are not allowed"
    if kind not in QUERY_NODES:
        return f"only SELECT queries are allowed, not {kind}"
    if kind == "UnresolvedRelation":
        parts = [str(p) for p in _items(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0].lower() not in tables:
            return f"table is not allowed: {'.'.join(parts)}"
    if kind == "UnresolvedWith":
        # A CTE sees those before it; the query sees all of them, and nobody else.
        for alias in _items(plan.innerChildren()):
            reason = _check_plan(alias, tables)
            if reason:
                return reason
            tables = tables | {alias.alias().lower()}
    expressions = list(_items(plan.expressions()))
    if kind == "WithWindowDefinition":
        # Named windows are kept in a map, which is none of the node's expressions.
        expressions += _items(plan.windowDefinitions().values().toSeq())
    for expression in expressions:
        reason = _check_expression(expression, tables)
        if reason:
            return reason
    for child in _items(plan.children()):
        reason = _check_plan(child, tables)
        if reason:
            return reason
    return None


def unsafe_reason(spark: SparkSession, sql: str, tables: Iterable[str] = TABLES) -> str | None:
    """Why a statement is refused, or None if it may run."""
    if not sql.strip():
        return "empty SQL"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        return f"cannot be parsed: {str(error).strip().splitlines()[0]}"
    return _check_plan(plan, frozenset(t.lower() for t in tables))


# Leaves of an analysed plan that read nothing but the statement itself.
OWN_LEAVES = {"OneRowRelation", "OneRowRelation$", "LocalRelation", "CTERelationRef"}


def _outside_reason(plan, names: Iterable[str]) -> str | None:
    """Why an analysed plan reaches outside, or None.

    Whatever is read must lie below the view of a given frame. Such a view is not
    looked into: what a given frame does itself is its own.
    """
    allowed = {n.lower() for n in names}
    for node, below in _nodes(plan, allowed):
        kind = _kind(node)
        if kind.startswith(REACHING_OUT):
            return f"not allowed: {kind}"
        if below and node.children().isEmpty() and kind not in OWN_LEAVES:
            return f"not allowed: reading {kind}"
    return None


def _nodes(plan, allowed: set[str]) -> Iterator:
    """A plan with the plans below it (True) and all their expressions (False), down to the given views."""
    if _kind(plan) == "View" and plan.desc().identifier().table().lower() in allowed:
        return
    yield plan, True
    for expression in _items(plan.expressions()):
        yield from _parts(expression, allowed)
    inner = list(_items(plan.innerChildren())) if _kind(plan) == "WithCTE" else []
    for child in [*_items(plan.children()), *inner]:
        yield from _nodes(child, allowed)


def _parts(expression, allowed: set[str]) -> Iterator:
    yield expression, False
    if _kind(expression) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        yield from _nodes(expression.plan(), allowed)
    for child in _items(expression.children()):
        yield from _parts(child, allowed)


_VIEWS = threading.Lock()


def guarded_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run a query over the given frames only; ValueError if it is refused.

    The frames are temporary views only while the query is analysed. Views of the
    session that have the same names are put back after that.
    """
    reason = unsafe_reason(spark, sql, tables)
    if reason:
        raise ValueError(f"SQL refused: {reason}")
    with _VIEWS:
        before = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in tables}
        try:
            for name, df in tables.items():
                df.createOrReplaceTempView(name)
            found = spark.sql(sql)
        finally:
            for name in tables:
                spark.catalog.dropTempView(name)
            for name, df in before.items():
                df.createOrReplaceTempView(name)
    reason = _outside_reason(found._jdf.queryExecution().analyzed(), tables)
    if reason:
        raise ValueError(f"SQL refused: {reason}")
    return found
