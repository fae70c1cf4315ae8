"""Queries over paths of the call graph, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwright.functions import text as T
from boundwright.jobs.catalogue import LOCATED, placed_alarms, query
from boundwright.operators import joins as J
from boundwright.operators import paths as P
from boundwright.operators.origins import COMMON, HOPS, origin_paths
from boundwright.sources.projections import view
from boundwright.sources.shared import written

#: Pairs asked for: of a function itself, of one that no call names, and of functions near and far.
ASKED = """SELECT concat('fn_', s_suppkey) AS a, CASE WHEN s_suppkey % 10 = 0 THEN concat('fn_', s_suppkey) WHEN s_suppkey % 11 = 0 THEN 'fn_none' WHEN s_suppkey % 3 = 0 THEN concat('fn_', s_suppkey DIV 4)
    WHEN s_suppkey % 3 = 1 THEN concat('fn_', s_suppkey * 2 + 1) ELSE concat('fn_', s_suppkey + 1) END AS b FROM supplier"""
ASKED_SQL = f"_asked AS (SELECT DISTINCT a, b FROM ({ASKED.replace(' DIV ', ' // ')}))"
LINKS_SQL = "_l AS (SELECT DISTINCT src, dst FROM sparse_edges WHERE src <> dst), _u AS (SELECT src, dst FROM _l UNION SELECT dst, src FROM _l), _n AS (SELECT src AS node FROM sparse_edges UNION SELECT dst FROM sparse_edges)"


def walk(name: str, starts: str, links: str, most: int) -> str:
    """All simple paths from starts, and the first of each end by length and nodes."""
    return f"""_{name}w AS (SELECT DISTINCT {starts} AS s, {starts} AS node, [{starts}] AS path FROM _asked UNION ALL SELECT s, l.dst, list_append(path, l.dst) FROM _{name}w w JOIN {links} l ON l.src = w.node WHERE len(path) <= {most} AND NOT list_contains(path, l.dst)),
    _{name} AS (SELECT s, node, path FROM _{name}w QUALIFY row_number() OVER (PARTITION BY s, node ORDER BY len(path), path) = 1)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ASKED.replace("FROM supplier", "FROM {supplier}"), supplier=view(spark, sf_dir, "supplier"))


@query(
    f"""{ASKED_SQL}, {LINKS_SQL}, {walk("d", "a", "_l", P.BRIDGE)}, {walk("r", "b", "_l", P.BRIDGE)}, {walk("f", "a", "_u", P.BRIDGE)},
    _c AS (SELECT a, b, min(x.src) AS bridge FROM _asked JOIN _l x ON x.dst = a JOIN _l y ON y.dst = b AND y.src = x.src GROUP BY a, b),
    _e AS (SELECT a, b, min(x.dst) AS bridge FROM _asked JOIN _l x ON x.src = a JOIN _l y ON y.src = b AND y.dst = x.dst GROUP BY a, b),
    _k AS (SELECT q.a, q.b, CASE WHEN q.a NOT IN (SELECT node FROM _n) OR q.b NOT IN (SELECT node FROM _n) THEN 'disconnected' WHEN q.a = q.b THEN 'same_node' WHEN len(d.path) = 2 THEN 'direct' WHEN d.path IS NOT NULL THEN 'directed_bridge'
      WHEN r.path IS NOT NULL THEN 'reverse_bridge' WHEN c.bridge IS NOT NULL THEN 'shared_caller' WHEN e.bridge IS NOT NULL THEN 'shared_callee' WHEN f.path IS NOT NULL THEN 'undirected_bridge' ELSE 'disconnected' END AS kind,
      d.path AS dp, list_reverse(r.path) AS rp, c.bridge AS cb, e.bridge AS eb, f.path AS fp
      FROM _asked q LEFT JOIN _d d ON d.s = q.a AND d.node = q.b LEFT JOIN _r r ON r.s = q.b AND r.node = q.a LEFT JOIN _c c ON c.a = q.a AND c.b = q.b LEFT JOIN _e e ON e.a = q.a AND e.b = q.b LEFT JOIN _f f ON f.s = q.a AND f.node = q.b)
    SELECT a, b, kind, CASE kind WHEN 'same_node' THEN a WHEN 'direct' THEN array_to_string(dp, '>') WHEN 'directed_bridge' THEN array_to_string(dp, '>') WHEN 'reverse_bridge' THEN array_to_string(rp, '>')
      WHEN 'shared_caller' THEN concat(a, '>', cb, '>', b) WHEN 'shared_callee' THEN concat(a, '>', eb, '>', b) WHEN 'undirected_bridge' THEN array_to_string(fp, '>') ELSE '' END AS nodes FROM _k""",
    "sparse_edges",
)
def callgraph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the call graph connects pairs of functions, and by which nodes."""
    found = P.segments(view(spark, sf_dir, "sparse_edges"), asked(spark, sf_dir))
    return found.select("a", "b", "kind", F.array_join("nodes", ">").alias("nodes"))


@query(
    f"""{ASKED_SQL}, {LINKS_SQL}, {walk("d", "a", "_l", P.LONGEST)}, {walk("f", "a", "_u", P.LONGEST)},
    _p AS (SELECT a, b, true AS directed, path FROM _asked JOIN _dw ON s = a AND node = b WHERE a <> b),
    _q AS (SELECT * FROM _p UNION ALL SELECT q.a, q.b, false, path FROM _asked q JOIN _fw ON s = q.a AND node = q.b WHERE q.a <> q.b AND NOT EXISTS (SELECT 1 FROM _p WHERE _p.a = q.a AND _p.b = q.b))
    SELECT a, b, directed, row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) AS rank, len(path) AS n_nodes, array_to_string(path, '>') AS path FROM _q QUALIFY rank <= {P.LISTED}""",
    "sparse_edges",
)
def callgraph_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple paths between pairs of functions, along the calls or else either way."""
    found = P.simple_paths(view(spark, sf_dir, "sparse_edges"), asked(spark, sf_dir))
    return found.select("a", "b", "directed", "rank", "n_nodes", F.array_join("path", ">").alias("path"))


@query(
    f"""{LOCATED}, _a AS (SELECT p.order_id, p.line, o.symbol, (SELECT max(struct_pack(s := f.start_line, i := f.fn_id, n := f.name)).n FROM functions f WHERE p.line BETWEEN f.start_line AND f.end_line) AS fn FROM located p JOIN operands o ON o.order_id = p.order_id),
    _w AS (SELECT function AS fn, split_part(variable, '@', 1) AS symbol, line, seq FROM data_flow WHERE access = 'write'), _m AS (SELECT fn, symbol, min(line) AS first_write FROM _w GROUP BY fn, symbol),
    _c AS (SELECT callee, caller, line AS call_line, argument FROM arguments WHERE caller <> '' QUALIFY row_number() OVER (PARTITION BY callee ORDER BY line NULLS LAST, caller, argument NULLS LAST) = 1),
    _p AS (SELECT fn, symbol FROM parameters),
    _h AS (SELECT order_id, 0 AS hop, fn, symbol, line, CAST([] AS VARCHAR[]) AS visited FROM _a
      UNION ALL SELECT h.order_id, h.hop + 1, c.caller, coalesce(c.argument, h.symbol), c.call_line, list_append(h.visited, h.fn) FROM _h h JOIN _p p ON p.fn = h.fn AND p.symbol = h.symbol JOIN _c c ON c.callee = h.fn
      LEFT JOIN _m m ON m.fn = h.fn AND m.symbol = h.symbol WHERE h.hop < {HOPS - 1} AND NOT coalesce(m.first_write < h.line, false) AND NOT list_contains(h.visited, c.caller) AND c.caller <> h.fn),
    _k AS (SELECT h.*, c.argument, CASE WHEN h.fn IS NULL THEN 'unresolved' WHEN m.first_write < h.line THEN 'written' WHEN p.fn IS NOT NULL AND c.caller IS NULL THEN 'no_caller' WHEN p.fn IS NOT NULL THEN 'called' ELSE 'other' END AS kind
      FROM _h h LEFT JOIN _m m ON m.fn = h.fn AND m.symbol = h.symbol LEFT JOIN _p p ON p.fn = h.fn AND p.symbol = h.symbol LEFT JOIN _c c ON c.callee = h.fn),
    _f AS (SELECT k.*, (SELECT max(struct_pack(l := w.line, s := w.seq, f := w.fn)) FROM _w w WHERE w.symbol = k.symbol AND w.line < k.line AND (k.hop = 0 OR w.fn = k.fn)) AS w FROM _k k),
    _g AS (SELECT *, CASE WHEN hop = 0 AND kind = 'other' AND length(symbol) > {COMMON} AND w.f <> fn THEN 'global' ELSE kind END AS own FROM _f),
    _rows AS (SELECT order_id, hop, fn, symbol, CASE WHEN hop > 0 AND own = 'written' THEN w.l ELSE line END AS line, own, argument FROM _g UNION ALL SELECT order_id, 1, w.f, symbol, w.l, own, argument FROM _g WHERE own = 'global')
    SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY hop DESC) AS step,
    CASE WHEN max(hop) OVER (PARTITION BY order_id) = 0 THEN 'origin_and_alarm' WHEN hop = 0 THEN 'alarm' WHEN hop = max(hop) OVER (PARTITION BY order_id) THEN 'origin' ELSE 'call' END AS role, fn AS function, symbol,
    CASE WHEN own IN ('called', 'no_caller') THEN 'parameter' WHEN own = 'written' THEN 'local' WHEN own = 'global' THEN 'global' ELSE 'unknown' END AS scope, line,
    CASE WHEN own = 'unresolved' THEN 'unresolved_function,empty_path' WHEN own = 'no_caller' THEN 'no_caller' WHEN own = 'called' AND argument IS NULL THEN 'arg_extract_failed' WHEN own = 'other' THEN 'missing_df' ELSE '' END AS gap FROM _rows""",
    "alarms",
    "operands",
    "functions",
    "data_flow",
    "arguments",
    "parameters",
)
def origin_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each alarm from the origin of its index to itself, through callers, with the gaps that it has."""
    # Parsed once, as in alarm_enclosing_function.
    placed = J.enclosing(written(placed_alarms(spark, sf_dir), "placed"), view(spark, sf_dir, "functions")).select("order_id", F.col("name").alias("fn"), "line")
    alarms = placed.join(view(spark, sf_dir, "operands"), "order_id")
    flow = view(spark, sf_dir, "data_flow").filter("access = 'write'").select(F.col("function").alias("fn"), T.bare_name(F.col("variable")).alias("symbol"), "line", "seq")
    calls = view(spark, sf_dir, "arguments").filter("caller <> ''")
    order = [F.asc_nulls_last("line"), F.asc("caller"), F.asc_nulls_last("argument")]
    callers = J.first_of(calls, ["callee"], order, 1).select("callee", "caller", F.col("line").alias("call_line"), "argument")
    return origin_paths(alarms, flow, view(spark, sf_dir, "parameters"), written(callers, "callers"))
