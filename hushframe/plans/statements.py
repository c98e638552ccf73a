"""Which statements may run at all, in both modes: only queries over registered tables.

The text is parsed, not executed: ``spark.sql`` runs commands at once, so the parsed plan is classified before it.
Whatever node the list below does not name is refused.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

from hushframe.errors import StatementNotAllowed, Unplannable

# Nodes of parsed read-only queries.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedRelation UnresolvedWith Union Except Intersect Distinct Join LateralJoin UnresolvedInlineTable "
    "OneRowRelation UnresolvedHaving WithWindowDefinition Generate UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases Pivot Unpivot Sample UnresolvedHint "
    "ResolvedInlineTable LocalRelation Range Window".split()
)
# Functions that reach beyond the tables.
REFUSED_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length read_files version current_user session_user user".split())


def each(seq: JavaObject) -> list[JavaObject]:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]


def kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check(node: JavaObject, tables: set[str], named: set[str]) -> None:
    name = kind(node)
    if name not in QUERY_NODES:
        raise StatementNotAllowed
    if name == "UnresolvedWith":
        pairs = [x for x in each(node.cteRelations())]
        for x in pairs:
            named = named | {x._1().lower()}
        for x in pairs:
            _check(x._2(), tables, named)
    if name == "UnresolvedRelation":
        parts = each(node.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in tables | named:
            raise Unplannable
    for e in each(node.expressions()):
        _check_expression(e)
    for x in each(node.subqueries()):
        _check(x, tables, named)
    for x in each(node.children()):
        _check(x, tables, named)


def _check_expression(e: JavaObject) -> None:
    if kind(e) == "UnresolvedFunction":
        parts = each(e.nameParts())
        if len(parts) != 1 or parts[0].lower() in REFUSED_FUNCTIONS:
            raise StatementNotAllowed
    for x in each(e.children()):
        _check_expression(x)


def verify_statement(session: SparkSession, sql: str, tables: set[str]) -> None:
    """Raise StatementNotAllowed or Unplannable unless sql is one read-only query over tables (names in lower case)."""
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        raise StatementNotAllowed from None
    _check(plan, tables, set())
