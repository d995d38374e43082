"""Read-only SQL over a catalog (Q1-Q5).

Statements are parsed by Spark's own parser; the unresolved plan is walked
(children, inner children such as CTE and subquery bodies, and expressions)
and checked against an allow-list of read-only plan nodes. Relations must be
catalog tables or views created earlier in the same call; reflective and
unknown table functions are refused. This is a convenience layer on top of
real access control, not a substitute for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from tabscope.functions.expressions import PREVIEW_ROWS
from tabscope.sources.catalog import Catalog

# Plan nodes a read-only query may contain.
ALLOWED_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Tail",
    "Distinct", "Deduplicate", "Union", "Intersect", "Except", "Join", "LateralJoin", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedWith",
    "WithCTE", "CTERelationDef", "CTERelationRef", "UnresolvedHint", "Sample", "Generate", "Pivot",
    "Unpivot", "Window", "UnresolvedHaving", "RepartitionByExpression", "Repartition", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Expand", "CreateViewCommand", "Range",
    "UnresolvedFunctionName", "NamedParametersSupport",
}
# Functions that reach outside the data (JVM reflection).
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
# Table functions that only reshape their arguments.
ALLOWED_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "inline", "inline_outer", "posexplode",
                           "posexplode_outer", "stack", "json_tuple", "variant_explode"}


class RefusedQuery(ValueError):
    pass


def split_statements(query: str) -> list[str]:
    """Split on ``;`` outside quotes, backticks and comments; drop empty pieces."""
    out, buf, i, n = [], [], 0, len(query)
    quote = None
    while i < n:
        ch = query[i]
        if quote:
            buf.append(ch)
            if ch == "\\" and quote != "`" and i + 1 < n:
                buf.append(query[i + 1])
                i += 2
                continue
            if ch == quote:
                quote = None
        elif ch in ("'", '"', "`"):
            quote = ch
            buf.append(ch)
        elif query.startswith("--", i):
            j = query.find("\n", i)
            i = n if j < 0 else j
            continue
        elif query.startswith("/*", i):
            j = query.find("*/", i + 2)
            i = n if j < 0 else j + 2
            buf.append(" ")
            continue
        elif ch == ";":
            out.append("".join(buf))
            buf = []
        else:
            buf.append(ch)
        i += 1
    out.append("".join(buf))
    return [s.strip() for s in out if s.strip()]


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def _is_plan(o) -> bool:
    return "catalyst.plans.logical" in o.getClass().getName()


def _walk_expr(e, found: dict, scope: frozenset[str]):
    name = e.getClass().getSimpleName()
    if name == "UnresolvedFunction":
        found["functions"].add(".".join(_seq(e.nameParts())).lower())
    elif name == "ExpressionWithUnresolvedIdentifier":
        found["nodes"].append(name)  # IDENTIFIER(...): no allowed node
    if is_instance_of(SparkContext._gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
        _walk_plan(e.plan(), found, scope)
    for c in _seq(e.children()):
        _walk_expr(c, found, scope)


def _walk_plan(p, found: dict, scope: frozenset[str] = frozenset()):
    """Collects what a plan uses. ``scope``: the CTE names visible at this place."""
    name = p.getClass().getSimpleName()
    found["nodes"].append(name)
    if name == "UnresolvedRelation":
        parts = [str(x) for x in _seq(p.multipartIdentifier())]
        if not (len(parts) == 1 and parts[0].lower() in scope):
            found["relations"].append(parts)
    elif name == "SubqueryAlias":
        found["aliases"].append(str(p.alias()).lower())
    elif name == "UnresolvedTableValuedFunction":
        found["tvfs"].append(".".join(_seq(p.name())).lower())
    elif name == "CreateViewCommand":
        found["views"].append((str(p.name().table()), str(p.viewType().toString())))
    elif name == "UnresolvedWith":
        # Each CTE sees the ones before it (and itself, if recursive); the body sees all.
        inner = scope
        for rel in _seq(p.cteRelations()):
            own = str(rel._1()).lower()
            _walk_plan(rel._2(), found, inner | {own} if bool(p.allowRecursion()) else inner)
            inner = inner | {own}
        _walk_plan(p.child(), found, inner)
        return
    for c in _seq(p.children()):
        _walk_plan(c, found, scope)
    for c in _seq(p.innerChildren()):
        if _is_plan(c):
            _walk_plan(c, found, scope)
    for e in _seq(p.expressions()):
        _walk_expr(e, found, scope)


def check_read_only(spark: SparkSession, statement: str, known: set[str], used: set[str] | None = None) -> list[str]:
    """Q1: raise ``RefusedQuery`` unless the statement only reads known relations.

    Returns names of temp views the statement creates.
    """
    if not statement or not statement.strip():
        raise RefusedQuery("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise RefusedQuery(f"cannot parse: {str(e).splitlines()[0][:300]}") from None
    found = {"nodes": [], "relations": [], "aliases": [], "tvfs": [], "views": [], "functions": set()}
    try:
        _walk_plan(plan, found)
    except Exception as e:  # what cannot be read cannot be allowed
        raise RefusedQuery(f"cannot check the query: {str(e).splitlines()[0][:300]}") from None
    bad = [n for n in found["nodes"] if n not in ALLOWED_NODES]
    if bad:
        raise RefusedQuery(f"only read-only queries are allowed (found {bad[0]})")
    root = found["nodes"][0]
    created = []
    for view, kind in found["views"]:
        if kind != "LocalTempView":
            raise RefusedQuery("only CREATE TEMPORARY VIEW is allowed")
        created.append(view.lower())
    if root == "CreateViewCommand" and not created:
        raise RefusedQuery("only CREATE TEMPORARY VIEW is allowed")
    if "asof" in found["aliases"]:
        raise RefusedQuery("ASOF JOIN is not Spark SQL (it would run as a plain join); use tabscope.asof_join")
    allowed = {k.lower() for k in known} | set(created)
    for rel in found["relations"]:
        if len(rel) != 1 or rel[0].lower() not in allowed:
            raise RefusedQuery(f"unknown relation: {'.'.join(rel)}")
        if used is not None:
            used.add(rel[0].lower())
    for fn in found["functions"]:
        if fn.split(".")[-1] in REFUSED_FUNCTIONS:
            raise RefusedQuery(f"function not allowed: {fn}")
    for tvf in found["tvfs"]:
        if tvf.split(".")[-1] not in ALLOWED_TABLE_FUNCTIONS:
            raise RefusedQuery(f"table function not allowed: {tvf}")
    return created


def guarded_sql(cat: Catalog, query: str | list[str], current_table: str | None = None) -> DataFrame:
    """Q2/Q3: run one or more read-only statements over the catalog; return the
    last result as a (lazy) DataFrame.

    Tables are registered as temp views in a fresh session (views of one call
    are invisible to others), plus the alias ``df`` for the current table.
    In-memory catalog entries run in their own session instead.
    """
    statements = split_statements(query) if isinstance(query, str) else [s for s in query if s.strip()]
    if not statements:
        raise RefusedQuery("empty query")
    session = cat.spark if cat.pinned() else cat.spark.newSession()
    names = list(cat.names)
    current = current_table or cat.current or (names[0] if names else None)
    known = set(names) | ({"df"} if current else set())
    used: set[str] = set()
    created_all: list[str] = []
    for s in statements:  # check everything before running anything
        created = check_read_only(session, s, known, used)
        created_all += created
        known |= set(created)
    # Register only the tables the statements read. In the caller's session (in-memory
    # entries) a view of the same name would be lost, so such a call is refused.
    by_lower = {n.lower(): n for n in names}
    wanted = {by_lower[u]: by_lower[u] for u in used if u in by_lower}
    if current and "df" in used and "df" not in by_lower:
        wanted["df"] = current
    if session is cat.spark:
        taken = {t.name.lower() for t in session.catalog.listTables() if t.isTemporary}
        clash = sorted(taken & {v.lower() for v in [*wanted, *created_all]})
        if clash:
            raise RefusedQuery(f"the session already has a temporary view named {clash[0]}")
    for view, name in wanted.items():
        cat.loaders[name](session).createOrReplaceTempView(view)
    result = None
    try:
        for s in statements:
            result = session.sql(s)
        # The returned DataFrame holds an analysed plan, so the views can go.
        result = result.select("*") if result is not None else None
    finally:
        if session is cat.spark:
            for v in {*wanted, *created_all}:
                session.catalog.dropTempView(v)
    return result


@dataclass
class SqlResult:
    columns: list[str]
    rows: list[tuple]
    total_rows: int | None
    truncated: bool


def read_only_sql(cat: Catalog, query: str | list[str], current_table: str | None = None,
                  preview_rows: int = PREVIEW_ROWS, count_rows: bool = False) -> SqlResult:
    """Q2/Q5: guarded SQL with a bounded preview (``limit`` is pushed into the plan).

    One run shows whether there is more; ``count_rows`` runs the query again
    for the whole number of rows.
    """
    df = guarded_sql(cat, query, current_table)
    head = df.limit(preview_rows + 1).collect()
    truncated = len(head) > preview_rows
    total = len(head) if not truncated else df.count() if count_rows else None
    return SqlResult(df.columns, [tuple(r) for r in head[:preview_rows]], total, truncated)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, max_columns: int = 50, max_chars: int = 60) -> DataFrame:
    """K4: a bounded preview: first ``rows`` rows, ``max_columns`` columns, cells cut to ``max_chars``."""
    from pyspark.sql import functions as F

    cols = df.columns[:max_columns]
    return df.select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, max_chars).alias(c) for c in cols]).limit(rows)
