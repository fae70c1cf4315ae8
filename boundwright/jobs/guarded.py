"""Queries over conditions: what stands before each alarm, in its function and in its callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwright.jobs.catalogue import PLACED, placed_alarms, query
from boundwright.operators import guards as G
from boundwright.sources.projections import view
from boundwright.sources.shared import written

VIEWS = ("alarms", "functions", "calls", "guards")
#: The same search by joins over ranges and windows, one CTE a round.
SEARCH = f"""{PLACED}, _file AS (SELECT count(*) * 40 AS n FROM part), _ask AS (SELECT order_id, line, concat('v', order_id % 12) AS token FROM placed WHERE line IS NOT NULL),
    _points AS (SELECT line FROM _ask UNION SELECT line FROM calls WHERE line IS NOT NULL),
    _met AS (SELECT p.line, max(struct_pack(s := f.start_line, i := f.fn_id, n := f.name, e := f.end_line)) AS f FROM _points p JOIN functions f ON p.line BETWEEN f.start_line AND f.end_line GROUP BY p.line),
    _at AS (SELECT p.line, coalesce(m.f.n, '') AS fn, coalesce(m.f.s, greatest(1, p.line - {G.AROUND})) AS lo, least(p.line, coalesce(m.f.e, p.line)) AS hi FROM _points p LEFT JOIN _met m ON m.line = p.line),
    _top AS (SELECT callee, line, row_number() OVER (PARTITION BY callee ORDER BY seq) AS rank FROM calls QUALIFY rank <= {G.CALLERS}),
    _callers AS (SELECT t.callee, a.fn, min(struct_pack(r := t.rank, l := a.lo, h := a.hi)) AS c FROM _top t JOIN _at a ON a.line = t.line GROUP BY ALL),
    _v0 AS (SELECT order_id, token, 0 AS depth, 0 AS r1, 0 AS r2, a.fn, a.lo, a.hi FROM _ask q JOIN _at a ON a.line = q.line),
    _v1 AS (SELECT v.order_id, v.token, 1 AS depth, c.c.r AS r1, 0 AS r2, c.fn, c.c.l AS lo, c.c.h AS hi FROM _v0 v JOIN _callers c ON c.callee = v.fn WHERE v.fn <> '' AND c.fn <> v.fn),
    _v2 AS (SELECT DISTINCT ON (v.order_id, c.fn) v.order_id, v.token, 2 AS depth, v.r1, c.c.r AS r2, c.fn, c.c.l AS lo, c.c.h AS hi FROM _v1 v JOIN _callers c ON c.callee = v.fn
      WHERE v.fn <> '' AND NOT EXISTS (SELECT 1 FROM _v0 x WHERE x.order_id = v.order_id AND x.fn = c.fn) AND NOT EXISTS (SELECT 1 FROM _v1 x WHERE x.order_id = v.order_id AND x.fn = c.fn) ORDER BY v.order_id, c.fn, v.r1, c.c.r),
    _seen AS (SELECT * FROM _v0 UNION ALL SELECT * FROM _v1 UNION ALL SELECT * FROM _v2),
    _word AS (SELECT *, unnest(list_distinct(regexp_extract_all(condition, '[A-Za-z_][A-Za-z0-9_]*'))) AS word FROM guards),
    _hits AS (SELECT v.order_id, v.depth, v.r1, v.r2, v.fn, w.line, w.seq, w.kind, w.condition, row_number() OVER (PARTITION BY v.order_id ORDER BY v.depth, v.r1, v.r2, w.line, w.seq) AS n FROM _seen v JOIN _word w ON w.word = v.token AND w.line BETWEEN v.lo AND v.hi),
    _taken AS (SELECT *, min(n) OVER (PARTITION BY order_id, depth, r1, r2) AS f FROM _hits QUALIFY f <= {G.BUDGET}),
    _once AS (SELECT DISTINCT ON (order_id, line, condition) * FROM _taken ORDER BY order_id, line, condition, n),
    _total AS (SELECT order_id, count(*) >= {G.BUDGET} AS truncated FROM _taken GROUP BY order_id),
    _found AS (SELECT o.order_id, row_number() OVER (PARTITION BY o.order_id ORDER BY o.n) AS pos, o.depth, o.fn, o.line, o.kind, o.condition, t.truncated FROM _once o JOIN _total t ON t.order_id = o.order_id QUALIFY pos <= {G.BUDGET})"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_alarms(spark, sf_dir).filter("line IS NOT NULL")
    return written(placed.withColumn("token", F.expr("concat('v', order_id % 12)")), "alarms")


def found(spark: SparkSession, sf_dir: str, search) -> DataFrame:
    calls, spans, guards = (written(view(spark, sf_dir, name), name) for name in ("calls", "functions", "guards"))
    length = view(spark, sf_dir, "part").count() * 40
    return search(asked(spark, sf_dir).select("order_id", "line", F.array("token").alias("tokens")), calls, spans, guards, length)


@query(f"{SEARCH} SELECT order_id, pos, depth, fn, line, kind, condition, truncated FROM _found", *VIEWS)
def guard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first conditions on each alarm's operand, its callers' included."""
    return found(spark, sf_dir, G.searched)


@query(
    f"""{SEARCH}, _kept AS (SELECT f.order_id, f.pos, concat(f.kind, CASE WHEN f.fn = '' THEN ': ' ELSE concat(' in ', f.fn, ': ') END, f.condition) AS label FROM _found f JOIN _ask q ON q.order_id = f.order_id
      WHERE f.line <> q.line AND NOT starts_with(f.condition, 'ready')), _first AS (SELECT order_id, label, min(pos) AS pos FROM _kept GROUP BY order_id, label)
    SELECT order_id, string_agg(label, ' | ' ORDER BY pos) AS labels FROM _first GROUP BY order_id""",
    *VIEWS,
)
def guard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the conditions that bound each alarm's operand."""
    return G.labels(found(spark, sf_dir, G.listed)).withColumn("labels", F.array_join("labels", " | "))
