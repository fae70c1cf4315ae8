"""Queries over the lines around calls and accesses, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwright.functions import c_text as C
from boundwright.functions import text as T
from boundwright.jobs.catalogue import PLACED, placed_alarms, query
from boundwright.operators import joins as J
from boundwright.operators import probes as P
from boundwright.sources.projections import view
from boundwright.sources.shared import written

ASKED = f"""{PLACED}, _met AS (SELECT p.order_id, p.line, max(struct_pack(s := f.start_line, i := f.fn_id, n := f.name, e := f.end_line)) AS s FROM placed p JOIN functions f ON p.line BETWEEN f.start_line AND f.end_line GROUP BY ALL),
    _ask AS (SELECT order_id, line, s.n AS fn, s.s AS lo, least(s.e, line - 1) AS hi, concat('v', CAST(substr(s.n, 4) AS BIGINT) % 40) AS root, order_id % 2 = 0 AS dotted FROM _met)"""
ASSIGNED = """_g AS (SELECT seq, line, CASE kind WHEN 0 THEN concat('v', CAST(k AS BIGINT)) WHEN 3 THEN 'zz' ELSE 'f' END AS key FROM assignments WHERE kind <> 4),
    _a AS (SELECT a.order_id, s.line, s.seq FROM _ask a JOIN _g s ON s.line BETWEEN a.lo AND a.hi AND s.key = CASE WHEN a.dotted THEN 'f' ELSE a.root END)"""
VIEWS = ("alarms", "functions")
CALLED = """_q AS (SELECT o_orderkey AS order_id, concat('fn_', o_custkey % 7) AS callee, (o_orderkey * 37 + 11) % (SELECT count(*) * 40 FROM part) + 1 AS call_line, o_orderkey % 3 AS arg_index FROM orders)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their arguments, taken from the text of each."""
    text = F.concat(F.lit("  x = "), "target", F.lit("("), F.concat_ws(", ", "first", "second"), F.lit("); y(1, 2);"))
    calls = view(spark, sf_dir, "source_calls").select("line", "seq", "target", text.alias("call_text"))
    return calls.withColumn("args", C.arguments(F.col("call_text"), F.instr("call_text", "(")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms in a function (fn, lo, hi up to the line before the alarm) with the name of their operand."""
    placed = written(placed_alarms(spark, sf_dir).filter("line IS NOT NULL"), "alarms")
    met = J.enclosing(placed, view(spark, sf_dir, "functions")).filter("name IS NOT NULL")
    name = F.concat(F.lit("v"), F.substring("name", 4, 20).cast("bigint") % 40, F.when(F.col("order_id") % 2 == 0, ".f").otherwise(""))
    return met.select("order_id", "line", F.col("name").alias("fn"), F.col("start_line").alias("lo"), F.least(F.col("end_line"), F.col("line") - 1).alias("hi"), name.alias("name"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments by the last member of what is assigned to."""
    left = F.expr("CASE kind WHEN 0 THEN concat('v', k) WHEN 1 THEN concat('v', k, ' . f') WHEN 2 THEN 's -> f' WHEN 3 THEN 'zz' ELSE concat('arr[v', k, ']') END")
    return view(spark, sf_dir, "assignments").select("seq", "line", C.last_member(left).alias("key"))


@query(
    f"""{CALLED}, _c AS (SELECT *, list_filter([first, second], lambda x: x IS NOT NULL) AS args, concat('  x = ', target, '(', concat_ws(', ', first, second), '); y(1, 2);') AS call_text FROM source_calls),
    _o AS (SELECT *, unnest(range({P.CALL_BAND[0]}, {P.CALL_BAND[1] + 1})) AS d FROM _q),
    _h AS (SELECT o.order_id, o.callee, c.line, c.seq, c.args[o.arg_index + 1] AS e, c.call_text, CASE WHEN contains(target, callee) OR contains(target, '[') THEN 0 WHEN d = 0 THEN 1 END AS rank FROM _o o JOIN _c c ON c.line = o.call_line + d WHERE len(c.args) > o.arg_index),
    _f AS (SELECT DISTINCT ON (order_id) * FROM _h WHERE rank IS NOT NULL ORDER BY order_id, rank, line, seq, e, call_text)
    SELECT q.order_id, q.callee, q.arg_index, f.e AS expression, array_to_string(list_filter(regexp_extract_all(f.e, '\\b[A-Za-z_][A-Za-z0-9_]*'), lambda x: x <> q.callee), ',') AS names, f.line AS at, f.call_text FROM _q q LEFT JOIN _f f ON f.order_id = q.order_id""",
    "source_calls",
)
def call_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The argument that each asked call passes, taken from the calls on the lines around it."""
    lines = view(spark, sf_dir, "part").count() * 40
    questions = view(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.concat(F.lit("fn_"), F.col("o_custkey") % 7).alias("callee"), ((F.col("o_orderkey") * 37 + 11) % lines + 1).alias("call_line"), (F.col("o_orderkey") % 3).alias("arg_index")
    )
    found = P.call_arguments(questions, sites(spark, sf_dir))
    return found.select("order_id", "callee", "arg_index", "expression", F.array_join("names", ",").alias("names"), "at", "call_text")


@query(
    """_q AS (SELECT seq, replace(split_part(variable, '@', 1), '"', '') AS name, line + seq % 7 - 3 AS line FROM member_flow WHERE access <> 'read'), _p AS (SELECT unnest([0, -1, 1, -2, 2]) AS d, unnest([1, 2, 3, 4, 5]) AS r),
    _h AS (SELECT q.seq, p.r, t.text FROM _q q JOIN _p p ON true JOIN source_text t ON t.line = q.line + p.d WHERE contains(t.text, q.name) AND (contains(t.text, '=') OR contains(t.text, concat(q.name, '++')) OR contains(t.text, concat(q.name, '--')))
      UNION ALL SELECT q.seq, 6, t.text FROM _q q JOIN source_text t ON t.line = q.line)
    SELECT q.seq, q.name, q.line, coalesce((SELECT trim(arg_min(h.text, h.r)) FROM _h h WHERE h.seq = q.seq AND EXISTS (SELECT 1 FROM source_text t WHERE t.line = q.line)), '') AS text FROM _q q""",
    "member_flow",
    "source_text",
)
def assignment_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the assignment nearest to each write of the data flow."""
    writes = view(spark, sf_dir, "member_flow").filter("access <> 'read'").select("seq", T.bare_name(F.col("variable")).alias("name"), (F.col("line") + F.col("seq") % 7 - 3).alias("line"))
    return P.assignment_texts(writes, view(spark, sf_dir, "source_text")).select("seq", "name", "line", "text")


@query(f"{ASKED}, {ASSIGNED} SELECT order_id, line, seq FROM _a", *VIEWS, "assignments")
def source_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignments to each alarm's operand in its function and before it."""
    rows = asked(spark, sf_dir).withColumn("key", F.substring_index("name", ".", -1))
    return P.assigned_before(rows, assigned(spark, sf_dir))


@query(
    f"""{ASKED}, {ASSIGNED}, _w AS (SELECT seq, line, replace(split_part(variable, '@', 1), '"', '') AS bare, split_part(variable, '@', 2) AS scope, function FROM member_flow WHERE access <> 'read'),
    _d AS (SELECT seq, line, bare, function AS fn FROM _w UNION SELECT seq, line, bare, scope FROM _w WHERE scope <> ''),
    _p AS (SELECT DISTINCT a.order_id, d.line, d.seq FROM _ask a JOIN _d d ON d.fn = a.fn AND d.line < a.line LEFT JOIN source_text t ON t.line = d.line
      WHERE CASE WHEN a.dotted THEN d.bare IN (concat(a.root, '.f'), 'f') OR d.bare = a.root AND (contains(t.text, '.f') OR contains(t.text, '->f') OR regexp_matches(t.text, '\\bf\\b')) ELSE d.bare = a.root END),
    _o AS (SELECT a.order_id, c.line, c.seq FROM _ask a JOIN source_calls c ON c.line BETWEEN a.lo AND a.hi AND c.first = concat('&', a.root)),
    _all AS (SELECT order_id, 0 AS class, line, seq FROM _p UNION ALL SELECT order_id, 1, line, seq FROM _a UNION ALL SELECT order_id, 2, line, seq FROM _o),
    _z AS (SELECT *, row_number() OVER (PARTITION BY order_id, line ORDER BY class, seq) AS n FROM _all)
    SELECT order_id, CAST(class AS BIGINT) AS class, line, seq, row_number() OVER (PARTITION BY order_id ORDER BY class, line, seq) AS pos FROM _z WHERE class = 0 OR n = 1""",
    *VIEWS,
    "assignments",
    "member_flow",
    "source_text",
    "source_calls",
)
def writes_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All writes of each alarm's operand before it: of the data flow, then of the source text, then calls that take its address."""
    rows = written(asked(spark, sf_dir), "asked")
    flow = view(spark, sf_dir, "member_flow").filter("lower(access) = 'write'").select("seq", T.bare_name(F.col("variable")).alias("bare"), T.after(F.col("variable"), "@").alias("scope"), "function", "line")
    lists = written(P.write_lists(rows, flow, view(spark, sf_dir, "source_text")), "lists")
    seen = P.assigned_before(rows.withColumn("key", F.substring_index("name", ".", -1)), assigned(spark, sf_dir))
    passed = sites(spark, sf_dir).select("line", "seq", F.explode(F.array_distinct("args")).alias("arg")).select("line", "seq", F.regexp_extract("arg", r"^\(*&\s*([A-Za-z_][A-Za-z0-9_]*)\)*$", 1).alias("key")).filter("key <> ''")
    handed = P.assigned_before(rows.withColumn("key", F.substring_index("name", ".", 1)), passed)
    return P.writes_in_order(rows, lists, [seen, handed])
