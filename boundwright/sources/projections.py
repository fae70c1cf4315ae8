"""The alarm-triage tables as views over the driver's tables, in SQL that Spark and DuckDB both read.

Each view has its own columns; `view` gives it as a DataFrame and `with_views` as a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "functions": """SELECT p_partkey AS fn_id, concat('fn_', p_partkey % 1500) AS name,
        p_partkey * 40 + 1 AS start_line, p_partkey * 40 + p_size AS end_line FROM part""",
    "alarms": """SELECT o_orderkey AS order_id, o_orderpriority AS category,
        CASE WHEN o_orderkey % 97 = 0 THEN 'no-location'
             WHEN o_orderkey % 89 = 0 THEN concat('src.c:', o_orderkey % 500 + 1, '.3-xyz')
             WHEN o_orderkey % 83 = 0 THEN concat(' dir:src.c:', o_orderkey % 500 + 1, '.4-')
             WHEN o_orderkey % 79 = 0 THEN concat('src.c:', o_orderkey % 500 + 1, '.5-9.y')
             WHEN o_orderkey % 73 = 0 THEN concat('src.c:', o_orderkey % 500 + 1, '.6-', o_orderkey % 500 + 3, '.8 ')
             WHEN o_orderkey % 71 = 0 THEN concat('src.c:x', o_orderkey, '.7')
             WHEN o_orderkey % 5 = 0 THEN concat('src.c:', (o_orderkey * 37 + 11) % (SELECT count(*) * 40 FROM part) + 1, '.', o_custkey % 80 + 1)
             ELSE concat('src.c:', (o_orderkey * 37 + 11) % (SELECT count(*) * 40 FROM part) + 1, '.', o_custkey % 80 + 1, '-', o_custkey % 80 + 9) END AS location,
        CASE o_orderstatus WHEN 'F' THEN 'false' WHEN 'O' THEN 'true' ELSE 'true (low)' END AS classification FROM orders""",
    "data_flow": """SELECT event_id AS seq,
        concat('v', user_id % 40, CASE WHEN event_id % 4 = 0 THEN '.f' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN concat('@fn_', user_id) ELSE '' END) AS variable,
        concat('fn_', user_id) AS function, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS access,
        (event_id * 13 + 5) % (SELECT count(*) * 40 FROM part) + 1 AS line FROM events""",
    "control_flow": """SELECT CASE WHEN l_orderkey % 43 <> 0 THEN concat('fn_', l_suppkey) ELSE '' END AS caller, concat('fn_', l_partkey % 100) AS callee,
        l_returnflag AS process, CASE WHEN l_orderkey % 41 <> 0 THEN l_orderkey * 10 + l_linenumber END AS line FROM lineitem""",
    "call_edges": """SELECT DISTINCT concat('fn_', l_suppkey) AS src, concat('fn_', l_partkey % 100) AS dst FROM lineitem WHERE l_orderkey % 43 <> 0""",
    "sparse_edges": """SELECT concat('fn_', s_suppkey) AS src, concat('fn_', CAST(floor(s_suppkey / 2) AS BIGINT)) AS dst FROM supplier
        UNION SELECT concat('fn_', s_suppkey) AS src, concat('fn_', (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier)) AS dst FROM supplier""",
    "operands": """SELECT o_orderkey AS order_id, concat('v', o_custkey % 40) AS symbol FROM orders""",
    "parameters": """SELECT DISTINCT concat('fn_', p_partkey % 1500) AS fn, concat('v', (p_partkey % 1500 + 4 * p_size) % 40) AS symbol FROM part""",
    "arguments": """SELECT CASE WHEN l_orderkey % 43 <> 0 THEN concat('fn_', l_suppkey) ELSE '' END AS caller, concat('fn_', l_partkey % 100) AS callee,
        CASE WHEN l_orderkey % 41 <> 0 THEN l_orderkey * 10 + l_linenumber END AS line,
        CASE WHEN l_linenumber % 2 = 0 THEN concat('v', l_suppkey % 40) WHEN l_linenumber <> 5 THEN concat('v', (l_orderkey + l_linenumber * 7) % 40) END AS argument FROM lineitem""",
    "truth": """SELECT doc_id AS order_id, CASE WHEN quality = 0 THEN 'true' WHEN toxic = 1 THEN 'true (low)' ELSE 'false' END AS human FROM labels""",
    "verdicts": """SELECT doc_id AS order_id,
        CASE n_chars % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'true (low)' WHEN 3 THEN 'review' ELSE 'undecided' END AS classification,
        CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE NULL END AS confidence, n_chars AS tokens_used FROM documents""",
    "tool_events": """SELECT conv_id AS order_id, turn AS seq,
        CASE (conv_id + turn) % 5 WHEN 0 THEN 'get_micro_window' WHEN 1 THEN 'run_simulation' WHEN 2 THEN 'query_call_graph' WHEN 3 THEN 'inspect' ELSE 'submit_verdict' END AS tool,
        CASE (conv_id * 7 + turn) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE NULL END AS confidence FROM conversations""",
    "c_lines": """SELECT event_id AS line, concat('v', user_id % 40) AS operand,
        CASE event_id % 3
          WHEN 0 THEN concat('arr', event_id % 9, '[v', user_id % 40, ' & 0x0', event_id % 8, '] = tab', event_id % 5, '[', event_id % 13, 'u];')
          WHEN 1 THEN concat('if (v', user_id % 40, ' < ', user_id, 'u) arr', event_id % 9, '[v', user_id % 40, '] = 0;')
          ELSE concat('s->buf[v', user_id % 40, ' & ', event_id % 16, 'u] = Get(v', user_id % 40, ');') END AS text FROM events""",
    "declarations": """SELECT l_orderkey * 8 + l_linenumber AS seq,
        CASE l_partkey % 5 WHEN 0 THEN concat('arr', l_partkey, '_', l_linenumber) WHEN 1 THEN concat('obj', l_partkey, '.f', l_linenumber) WHEN 2 THEN concat('T', l_partkey, '.f', l_linenumber)
          WHEN 3 THEN concat('f', l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('x', l_partkey) END) ELSE concat('obj', l_partkey, CASE WHEN l_linenumber = 2 THEN '.a.f6' ELSE '' END) END AS name,
        CASE WHEN l_partkey % 5 = 4 OR l_quantity < 20 THEN CASE WHEN l_partkey % 10 = 4 AND l_quantity > 45 THEN CAST(l_quantity AS BIGINT) END WHEN l_quantity < 32 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS size,
        l_suppkey % 5 < 3 AS noted, l_partkey % 3 = 1 AS pointer FROM lineitem""",
    "calls": """SELECT concat('fn_', CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 7 ELSE l_partkey % 1500 END) AS callee, l_orderkey * 8 + l_linenumber AS seq,
        CASE WHEN l_orderkey % 41 <> 0 THEN (l_orderkey * 29 + l_linenumber * 401) % (SELECT count(*) * 40 FROM part) + 1 END AS line FROM lineitem""",
    "guards": """SELECT event_id AS seq, (event_id * 13 + 5) % (SELECT count(*) * 40 FROM part) + 1 AS line, CASE event_id % 4 WHEN 0 THEN 'while' WHEN 1 THEN 'for' ELSE 'if' END AS kind,
        CASE event_id % 4 WHEN 1 THEN concat('for (v', user_id % 12, ' = 0; i; i++)') WHEN 2 THEN concat('v', user_id % 12, '.n <= ', event_id % 5, 'u') WHEN 3 THEN concat('ready(v', user_id % 12, ')') ELSE concat(event_id % 7, ' > v', user_id % 12) END AS condition FROM events""",
    "session_events": """SELECT conv_id AS order_id, turn AS seq, 1 + conv_id % 6 AS n_steps, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'get_micro_window' ELSE 'move_window' END AS tool,
        CASE (conv_id * 3 + turn) % 10 WHEN 0 THEN 'prev' WHEN 1 THEN ' Back' WHEN 2 THEN 'sideways' WHEN 3 THEN 'callee' WHEN 4 THEN '' WHEN 5 THEN 'toward_alarm' WHEN 6 THEN 'CALLER' WHEN 7 THEN 'previous' WHEN 8 THEN 'forward' END AS direction,
        CASE WHEN (conv_id + 2 * turn) % 7 = 0 THEN turn * 3 - 4 WHEN (conv_id + turn) % 5 = 0 THEN 0 END AS step FROM conversations""",
    "sibling_cases": """SELECT o_orderkey AS order_id, concat(o_orderpriority, '|', o_custkey % 100) AS fingerprint, o_orderkey * 7919 % 10007 AS finished,
        CASE WHEN o_orderkey % 5 < 3 THEN 'false' WHEN o_orderstatus = 'O' THEN 'true' ELSE 'true (low)' END AS classification, CASE o_orderkey % 7 WHEN 0 THEN 'A1968' WHEN 1 THEN 'e' ELSE '' END AS tag FROM orders""",
    "member_flow": """SELECT event_id AS seq, concat(CASE event_id % 8 WHEN 4 THEN 'f' WHEN 5 THEN concat('"v', user_id % 40, '"') ELSE concat('v', user_id % 40, CASE event_id % 8 WHEN 0 THEN '.f' ELSE '' END) END,
        CASE event_id % 3 WHEN 0 THEN concat('@fn_', user_id) ELSE '' END) AS variable, concat('fn_', CASE WHEN event_id % 9 = 0 THEN 9999 ELSE user_id END) AS function,
        CASE WHEN event_type = 'click' THEN 'read' ELSE 'Write' END AS access, (event_id * 13 + 5) % (SELECT count(*) FROM events) + 1 AS line FROM events""",
    "source_text": """SELECT (event_id * 13 + 5) % (SELECT count(*) FROM events) + 1 AS line, CASE event_id % 7 WHEN 0 THEN concat('  v', user_id % 40, '.f = ', event_id, ';') WHEN 1 THEN concat('s->v', user_id % 40, ' = f;')
        WHEN 2 THEN '  break;' WHEN 3 THEN concat('v', user_id % 40, '++;') WHEN 4 THEN concat('v', user_id % 40, '->f--;') WHEN 5 THEN concat('if (v', user_id % 40, '.ff < 3)') ELSE concat(' g(v', user_id % 40, '); /* f */ ') END AS text FROM events""",
    "assignments": """SELECT event_id AS seq, (event_id * 13 + 5) % (SELECT count(*) FROM events) + 1 AS line, CAST(floor((event_id * 13 + 5) % (SELECT count(*) FROM events) / 40) AS BIGINT) % 1500 % 40 AS k, event_id % 5 AS kind FROM events""",
    "source_calls": """SELECT l_orderkey * 8 + l_linenumber AS seq, (l_orderkey * 29 + l_linenumber * 401) % (SELECT count(*) * 40 FROM part) + 1 AS line,
        CASE l_linenumber % 5 WHEN 0 THEN concat('table[', l_partkey % 5, ']') WHEN 1 THEN concat('s->fn_', l_partkey % 7) WHEN 2 THEN concat('fn_', l_partkey % 7, '_wrap') ELSE concat('fn_', l_partkey % 7) END AS target,
        CASE l_suppkey % 4 WHEN 0 THEN concat('Get(v', l_suppkey % 9, ', 2)') WHEN 1 THEN concat('m[v', l_suppkey % 9, ']') WHEN 2 THEN concat('&v', CAST(floor((l_orderkey * 29 + l_linenumber * 401) % (SELECT count(*) * 40 FROM part) / 40) AS BIGINT) % 1500 % 40) END AS first,
        CASE WHEN l_suppkey % 4 <> 3 AND l_quantity > 20 THEN concat('v', l_partkey % 11, ' & 7u') END AS second FROM lineitem""",
    "object_types": """SELECT concat('obj', p_partkey) AS object, concat('T', p_partkey - p_partkey % 5 + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END) AS type FROM part WHERE p_partkey % 5 IN (1, 4) AND p_partkey % 7 <> 0""",
    "type_fields": """SELECT concat('T', l_partkey) AS type, concat('f', l_linenumber) AS field, min(l_orderkey * 8 + l_linenumber) AS seq, max(CASE WHEN l_quantity > 45 THEN CAST(l_quantity AS BIGINT) END) AS size,
        l_linenumber = 5 AS pointer FROM lineitem WHERE l_partkey % 5 = 2 AND l_linenumber % 2 = 1 GROUP BY l_partkey, l_linenumber""",
    "object_uses": """SELECT concat('obj', l_partkey, '.u', l_linenumber, CASE WHEN l_linenumber = 3 THEN '.f8' ELSE '' END) AS name FROM lineitem WHERE l_partkey % 4 <> 2""",
    "asked_objects": """SELECT o_orderkey AS order_id, CASE o_orderkey % 11 WHEN 0 THEN concat('arr', o_custkey, '_', o_orderkey % 7 + 1) WHEN 1 THEN concat('obj', o_custkey, '.f', o_orderkey % 9 + 1)
        WHEN 2 THEN concat('obj', o_custkey) WHEN 3 THEN concat('obj', o_custkey, '.a.f', o_orderkey % 9 + 1) WHEN 4 THEN concat('f', o_orderkey % 9 + 1, 'x', o_custkey) WHEN 5 THEN concat('obj', o_custkey, '.u', o_orderkey % 8)
        WHEN 6 THEN CASE WHEN o_custkey % 2 = 0 THEN '*()' ELSE '' END WHEN 7 THEN concat('none', o_custkey, '.q') WHEN 8 THEN concat('arr', o_custkey, '_', o_orderkey % 7 + 1, '.q') WHEN 9 THEN concat('s.f', o_orderkey % 9 + 1, 'x', o_custkey)
        ELSE concat('obj', o_custkey, '.u3.f', o_orderkey % 9 + 1) END AS key FROM orders""",
}
BASE = {
    "functions": ("part",), "alarms": ("orders", "part"), "data_flow": ("events", "part"), "control_flow": ("lineitem",), "operands": ("orders",), "parameters": ("part",), "arguments": ("lineitem",), "call_edges": ("lineitem",), "sparse_edges": ("supplier",),
    "member_flow": ("events",), "source_text": ("events",), "assignments": ("events",), "source_calls": ("lineitem", "part"),
    "truth": ("labels",), "verdicts": ("documents",), "tool_events": ("conversations",), "c_lines": ("events",),
    "session_events": ("conversations",), "sibling_cases": ("orders",), "calls": ("lineitem", "part"), "guards": ("events", "part"), "declarations": ("lineitem",), "object_types": ("part",), "type_fields": ("lineitem",), "object_uses": ("lineitem",), "asked_objects": ("orders",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; other names are the driver's own tables. The session's own views are left alone."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(rf"\b({'|'.join(BASE[name])})\b", r"{\1}", VIEWS[name])
    return spark.sql(sql, **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet") for base in BASE[name]})


def with_views(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " "
