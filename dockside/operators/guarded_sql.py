"""One read-only SELECT with a capped result, and an audit of many statements."""

import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockside.functions.text import BLANKS

# Texts that no statement may contain, in the order they are tried.
BLOCKED = (
    "drop", "delete", "insert", "update", "create",
    "alter", "truncate", "exec", "execute", "--", ";",
)

# Functions that reach past the views given to the statement.
OUTSIDE_CALLS = (
    "java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start",
    "input_file_block_length",
)

# String literals, which are no calls, and calls of the functions above.
LITERAL = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\""""
CALL = rf"(?i)`?\b({'|'.join(OUTSIDE_CALLS)})`?\s*\("

# Reasons given with a refused statement.
NOT_SELECT = "Only SELECT statements are permitted"
BLOCKED_WORD = "Blocked keyword in query: '{}'"

OUTSIDE_CALL = "function not permitted: '{}'"
OUTSIDE_TABLE = "only the given views may be read, not '{}'"
PRODUCT = "joins need a condition"


class GuardError(ValueError):
    """A statement that was refused or failed; the text says why."""


def sql_verdict(statement: Column) -> tuple[Column, Column]:
    """Verdict (``ok``, ``not_select``, ``blocked``) and the blocked text found."""
    is_select = F.coalesce(statement.rlike(f"(?iU)^[{BLANKS}]*SELECT\\b"), F.lit(False))
    lowered = F.lower(statement)
    found = F.lit(None).cast("string")
    for word in reversed(BLOCKED):
        found = F.when(lowered.contains(word), F.lit(word)).otherwise(found)
    call = F.lower(F.regexp_extract(F.regexp_replace(statement, LITERAL, "''"), CALL, 1))
    found = F.coalesce(found, F.nullif(call, F.lit("")))
    found = F.when(is_select, found)
    verdict = (
        F.when(~is_select, "not_select").when(found.isNotNull(), "blocked").otherwise("ok")
    )
    return verdict, found


def sql_audit(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``verdict`` and ``blocked_by`` for each statement."""
    verdict, found = sql_verdict(F.col(column))
    return df.withColumns({"verdict": verdict, "blocked_by": found})


def audit_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("verdict", "blocked_by").agg(F.count(F.lit(1)).alias("n"))


def check_statement(sql: str) -> None:
    """Raise :class:`GuardError` for a statement that :func:`sql_verdict` does not pass."""
    if not re.match(r"^\s*SELECT\b", sql, re.IGNORECASE):
        raise GuardError(NOT_SELECT)
    lowered = sql.lower()
    word = next((word for word in BLOCKED if word in lowered), None)
    if word:
        raise GuardError(BLOCKED_WORD.format(word))
    call = re.search(CALL, re.sub(LITERAL, "''", sql))
    if call:
        raise GuardError(OUTSIDE_CALL.format(call[1].lower()))


def check_plan(session: SparkSession, sql: str, views) -> None:
    """Raise :class:`GuardError` for a relation that is not one of ``views``, or a cross join.

    Looks at the parsed statement, subqueries included, before any name is resolved.
    """
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    allowed = {name.lower() for name in views}
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan):
        if name.lower() not in allowed:
            raise GuardError(OUTSIDE_TABLE.format(name.replace(", ", ".")))
    function = re.search(r"UnresolvedTableValuedFunction \[([^\]]*)\]", plan)
    if function:
        raise GuardError(OUTSIDE_TABLE.format(function[1]))
    if re.search(r"Join Cross\b", plan):
        raise GuardError(PRODUCT)


# Classes of expressions that reach past the views, however a statement names them.
OUTSIDE_EXPRESSIONS = (
    "CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
    "PythonUDF", "ScalaUDF", "HiveSimpleUDF", "HiveGenericUDF",
)

# Leaves that read no table: a single row, written-out rows, and uses of a WITH query.
OWN_LEAVES = ("OneRowRelation", "LocalRelation", "CTERelationRef")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(expression) -> None:
    if _kind(expression) in OUTSIDE_EXPRESSIONS:
        raise GuardError(OUTSIDE_CALL.format(expression.prettyName()))
    for child in _items(expression.children()):
        _check_expression(child)


def check_analyzed(frame: DataFrame, views) -> None:
    """Raise :class:`GuardError` for what the resolved statement reads besides ``views``.

    Walks the analysed plan and the plans of its subqueries from the top. Below the node of a given
    view anything may stand; any other leaf that could read data is refused, whichever clause or
    function brought it there, and so is every call that reaches outside.
    """
    allowed = {name.lower() for name in views}

    def walk(node, name: str) -> None:
        kind = _kind(node)
        if kind == "View":
            name = node.desc().identifier().unquotedString()
            if node.isTempView() and name.lower() in allowed:
                return
            raise GuardError(OUTSIDE_TABLE.format(name))
        if kind == "SubqueryAlias":
            name = node.identifier().toString()
        if kind == "Join" and node.joinType().toString() == "Cross":
            raise GuardError(PRODUCT)
        for expression in _items(node.expressions()):
            _check_expression(expression)
        below = _items(node.children())
        if not below and kind not in OWN_LEAVES:
            raise GuardError(OUTSIDE_TABLE.format(name or kind.lower()))
        for child in [*below, *_items(node.subqueries())]:
            walk(child, name)

    walk(frame._jdf.queryExecution().analyzed(), "")


def _message(error: PySparkException) -> str:
    """Text of a failure; a table that is not there is refused like one that is."""
    if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
        name = error.getMessageParameters()["relationName"].replace("`", "")
        return OUTSIDE_TABLE.format(name)
    return str(error)


class GuardedResult:
    """Result of a guarded SELECT: a capped frame, or its rows as a record.

    ``frame`` has the statement's columns and, with every row, ``row_count``, the rows
    given, and ``truncated``, whether there were more. It comes from one plan of at
    most ``limit + 1`` rows.
    """

    def __init__(self, frame: DataFrame, limit: int):
        self._probe = frame.limit(limit + 1)
        self._limit = limit
        self._columns = frame.columns
        # At most limit + 1 rows meet in this window.
        place, total = F.monotonically_increasing_id(), F.count(F.lit(1)).over(Window.partitionBy())
        numbered = self._probe.select("*", place.alias("_place"), total.alias("_total"))
        rank = F.row_number().over(Window.orderBy("_place"))
        self.frame = (
            numbered.select("*", rank.alias("_rank"))
            .where(F.col("_rank") <= limit)
            .select(
                *[numbered[c] for c in frame.columns],
                F.least("_total", F.lit(limit)).cast("long").alias("row_count"),
                (F.col("_total") > limit).alias("truncated"),
            )
        )

    def collect(self) -> dict:
        """Columns, at most ``limit`` rows, their count, and whether rows were cut."""
        try:
            rows = self._probe.collect()
        except PySparkException as error:
            raise GuardError(str(error)) from error
        kept = [list(row) for row in rows[: self._limit]]
        return {
            "columns": self._columns,
            "rows": kept,
            "row_count": len(kept),
            "truncated": len(rows) > self._limit,
        }


def _child_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` that reads no files by path and joins no products."""
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            child.conf.set(key, value)
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    child.conf.set("spark.sql.crossJoin.enabled", "false")
    return child


def guarded_select(
    spark: SparkSession,
    sql: str,
    views: dict[str, Callable[[SparkSession], DataFrame]],
    limit: int = 50,
) -> GuardedResult:
    """Run one SELECT over the given views only.

    The statement runs in a child session that has the caller's settings and may
    name just these views: no table of the catalog, no global view, no file, no
    table function. The parsed statement is looked at before any name is resolved, the
    analysed one before anything runs. The limit is part of the plan: the full result is never fetched.
    """
    check_statement(sql)
    child = _child_session(spark)
    try:
        check_plan(child, sql, views)
        for name, load in views.items():
            load(child).createOrReplaceTempView(name)
        frame = child.sql(sql)
        check_analyzed(frame, views)
        clash = {"row_count", "truncated"} & {c.lower() for c in frame.columns}
        if clash or len(set(frame.columns)) < len(frame.columns):
            raise GuardError("columns of the result need names of their own")
        return GuardedResult(frame, limit)
    except PySparkException as error:
        raise GuardError(_message(error)) from error
