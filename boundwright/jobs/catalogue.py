"""The registered queries of alarm triage, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boundwright.functions import text as T
from boundwright.operators import evaluation as E
from boundwright.operators import graph as G
from boundwright.operators import joins as J
from boundwright.operators import sessions as S
from boundwright.sources.exports import scrubbed
from boundwright.sources.projections import view, with_views
from boundwright.sources.shared import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The parts of a location by string functions alone.
LOCATED = """_t AS (SELECT order_id, trim(location) AS t FROM alarms), _r AS (SELECT *, CASE WHEN contains(t, ':') THEN reverse(split_part(reverse(t), ':', 1)) ELSE '' END AS rest FROM _t),
    _s AS (SELECT *, split_part(rest, '-', 1) AS s, CASE WHEN contains(rest, '-') THEN substr(rest, strpos(rest, '-') + 1) ELSE '' END AS e FROM _r),
    _n AS (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(split_part(s, '.', 1), '[0-9]+') THEN split_part(s, '.', 1) END AS BIGINT) AS l,
      TRY_CAST(CASE WHEN contains(s, '.') AND regexp_full_match(substr(s, strpos(s, '.') + 1), '[0-9]+') THEN substr(s, strpos(s, '.') + 1) END AS BIGINT) AS c,
      CASE WHEN contains(e, '.') THEN split_part(e, '.', 1) ELSE '' END AS el, CASE WHEN contains(e, '.') THEN substr(e, strpos(e, '.') + 1) ELSE e END AS ec FROM _s),
    located AS (SELECT order_id, CASE WHEN l IS NOT NULL AND c IS NOT NULL THEN substr(t, 1, length(t) - length(rest) - 1) END AS file, CASE WHEN c IS NOT NULL THEN l END AS line, CASE WHEN l IS NOT NULL THEN c END AS col_start,
      CASE WHEN l IS NOT NULL AND c IS NOT NULL THEN coalesce(TRY_CAST(CASE WHEN regexp_full_match(el, '[0-9]+') THEN el END AS BIGINT), l) END AS end_line,
      CASE WHEN l IS NOT NULL AND c IS NOT NULL THEN coalesce(TRY_CAST(CASE WHEN regexp_full_match(ec, '[0-9]+') THEN ec END AS BIGINT), c) END AS col_end FROM _n)"""
PLACED = f"{LOCATED}, placed AS (SELECT order_id, line FROM located)"


def query(sql: str, *views: str):
    """Register a function as a query; sql goes after a WITH clause of the views that it names."""

    def register(function):
        QUERIES[function.__name__] = function
        more = ", " if sql.startswith(("placed AS", "_")) else " "
        ORACLE_SQL[function.__name__] = (with_views(*views).rstrip() + more + sql).replace("WITH ", "WITH RECURSIVE ", 1) if views else sql
        return function

    return register


@query(f"{LOCATED} SELECT order_id, file, line, col_start, end_line, col_end FROM located", "alarms")
def scan_alarms_parse_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = T.location(F.col("location"))
    return view(spark, sf_dir, "alarms").select("order_id", *(c.alias(k) for k, c in where.items()))


def placed_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "alarms").select("order_id", T.location(F.col("location"))["line"].alias("line"))


@query(
    f"""{PLACED}, met AS (SELECT p.order_id, p.line, max(struct_pack(s := f.start_line, i := f.fn_id, n := f.name, e := f.end_line)) AS s
      FROM placed p JOIN functions f ON p.line BETWEEN f.start_line AND f.end_line GROUP BY ALL)
    SELECT p.order_id, p.line, s.n AS function_name, coalesce(s.s, CASE WHEN p.line IS NOT NULL THEN greatest(1, p.line - 20) END) AS window_start,
      coalesce(s.e, CASE WHEN p.line IS NOT NULL THEN least((SELECT count(*) * 40 FROM part), p.line + 20) END) AS window_end FROM placed p LEFT JOIN met m ON p.order_id = m.order_id""",
    "alarms",
    "functions",
)
def alarm_enclosing_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function around each alarm, or the lines around it, within the file's, where there is none."""
    # Parsed once: the join would repeat the parsing of locations for each use of a line.
    met = J.enclosing(written(placed_alarms(spark, sf_dir), "placed"), view(spark, sf_dir, "functions"))
    around = F.when(F.col("line").isNotNull(), F.greatest(F.lit(1).cast("bigint"), F.col("line") - 20))
    length = view(spark, sf_dir, "part").count() * 40
    last = F.when(F.col("line").isNotNull(), F.least(F.lit(length), F.col("line") + 20))
    return met.select("order_id", "line", F.col("name").alias("function_name"), F.coalesce("start_line", around).alias("window_start"), F.coalesce("end_line", last).alias("window_end"))


@query(
    """SELECT caller, callee, line, (SELECT max(f.start_line) FROM functions f WHERE f.name = c.callee AND f.start_line < c.line) AS span_before FROM control_flow c""",
    "control_flow",
    "functions",
)
def nearest_span_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each call the latest function of the callee's name that starts before it."""
    calls = view(spark, sf_dir, "control_flow").select("caller", F.col("callee").alias("name"), "line")
    spans = view(spark, sf_dir, "functions").select("name", F.col("start_line").alias("line"))
    found = J.last_before(calls, spans, "name", "line", F.col("line"), width=1 << 16)
    return found.select("caller", F.col("name").alias("callee"), "line", F.col("found").alias("span_before"))


@query(
    """_flow AS (SELECT seq, split_part(variable, '@', 1) AS bare, access, line FROM data_flow)
    SELECT r.seq, r.bare, r.line, (SELECT max(struct_pack(l := w.line, s := w.seq)).s FROM _flow w WHERE w.bare = r.bare AND w.access = 'write' AND w.line < r.line) AS last_write
    FROM _flow r WHERE r.access = 'read'""",
    "data_flow",
)
def last_write_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each read the latest write of the variable on an earlier line."""
    flow = view(spark, sf_dir, "data_flow").select("seq", T.bare_name(F.col("variable")).alias("bare"), "access", "line")
    found = J.last_before(flow.filter("access = 'read'").drop("access"), flow.filter("access = 'write'"), "bare", "line", F.col("seq"))
    return found.select("seq", "bare", "line", F.col("found").alias("last_write"))


@query(
    """_n AS (SELECT line, seq, split_part(variable, '@', 1) AS bare FROM data_flow), _r AS (SELECT line, seq, bare FROM _n UNION ALL SELECT line, NULL, split_part(bare, '.', 1) FROM _n)
    SELECT line, array_to_string(list_sort(list(DISTINCT bare)), ',') AS names, arg_min(bare, seq) AS first_name FROM _r GROUP BY line""",
    "data_flow",
)
def dataflow_names_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and roots of the variables at each line, and the first of them."""
    bare, root = T.bare_name(F.col("variable")), T.root_name(F.col("variable"))
    rows = view(spark, sf_dir, "data_flow").select("line", "seq", bare.alias("bare"), F.explode(F.array(bare, root)).alias("name"))
    return rows.groupBy("line").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.min_by("bare", "seq").alias("first_name"))


@query(
    """_w AS (SELECT split_part(variable, '@', 1) AS bare, line, seq FROM data_flow WHERE access = 'write')
    SELECT bare, line, seq, row_number() OVER (PARTITION BY bare ORDER BY line DESC, seq DESC) AS rank FROM _w QUALIFY rank <= 12""",
    "data_flow",
)
def global_assign_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve writes of each variable."""
    writes = view(spark, sf_dir, "data_flow").filter("access = 'write'").select(T.bare_name(F.col("variable")).alias("bare"), "line", "seq")
    return J.first_of(writes, ["bare"], [F.desc("line"), F.desc("seq")], 12)


@query(
    """_d AS (SELECT DISTINCT callee, caller, line FROM control_flow WHERE caller <> ''), _k AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY line NULLS LAST, caller) AS rank FROM _d QUALIFY rank <= 6)
    SELECT callee, max(CASE WHEN rank = 1 THEN caller END) AS caller, max(CASE WHEN rank = 1 THEN line END) AS line,
    coalesce(string_agg(caller, ',' ORDER BY rank) FILTER (rank > 1), '') AS extras FROM _k GROUP BY callee""",
    "control_flow",
)
def caller_pick_top1_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call of each function and the callers of the next five; calls without a caller do not count, those without a line come last."""
    calls = view(spark, sf_dir, "control_flow").filter("caller <> ''").select("callee", "caller", "line").distinct()
    top = J.first_of(calls, ["callee"], [F.asc_nulls_last("line"), F.asc("caller")], 6)
    extras = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "caller"))))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    return top.groupBy("callee").agg(first("caller"), first("line"), F.array_join(F.transform(extras, lambda x: x["caller"]), ",").alias("extras"))


@query(
    """_d AS (SELECT DISTINCT caller, callee FROM control_flow WHERE caller <> '' AND callee <> ''), _e AS (SELECT callee AS node, 'caller' AS side, caller AS other FROM _d UNION ALL SELECT caller, 'callee', callee FROM _d),
    _k AS (SELECT *, row_number() OVER (PARTITION BY node, side ORDER BY other) AS rank FROM _e QUALIFY rank <= 24)
    SELECT node, coalesce(string_agg(other, ',' ORDER BY other) FILTER (side = 'caller'), '') AS callers, coalesce(string_agg(other, ',' ORDER BY other) FILTER (side = 'callee'), '') AS callees FROM _k GROUP BY node""",
    "control_flow",
)
def call_neighbours_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 24 distinct callers and callees of each function."""
    calls = view(spark, sf_dir, "control_flow").filter("caller <> '' AND callee <> ''").select("caller", "callee").distinct()
    ends = calls.select(F.col("callee").alias("node"), F.lit("caller").alias("side"), F.col("caller").alias("other")).unionAll(calls.select("caller", F.lit("callee"), "callee"))
    top = J.first_of(ends, ["node", "side"], [F.asc("other")], 24)
    listed = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("other")))), ",").alias(f"{side}s")
    return top.groupBy("node").agg(listed("caller"), listed("callee"))


@query("SELECT caller, callee, count(*) AS n_calls, count(DISTINCT line) AS n_sites, min(line) AS first_line FROM control_flow WHERE caller <> '' AND callee <> '' GROUP BY caller, callee", "control_flow")
def callgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(view(spark, sf_dir, "control_flow"))


@query(
    """_e AS (SELECT src AS node, 1 AS o, 0 AS i FROM call_edges UNION ALL SELECT dst, 0, 1 FROM call_edges), _s AS (SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM _e GROUP BY node)
    SELECT node, n_in, n_out, round(1.6 + least(6.0, sqrt(n_in + n_out)), 2) AS size FROM _s""",
    "call_edges",
)
def callgraph_degree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and drawn sizes over the distinct edges of all calls."""
    return G.degrees(view(spark, sf_dir, "call_edges"))


@query(
    """_b AS (SELECT src AS a, dst AS b FROM sparse_edges UNION SELECT dst, src FROM sparse_edges), _t AS (SELECT a AS node, a AS other FROM _b UNION SELECT t.node, e.b FROM _t t JOIN _b e ON e.a = t.other)
    SELECT node, min(other) AS component FROM _t GROUP BY node""",
    "sparse_edges",
)
def callgraph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(view(spark, sf_dir, "sparse_edges"))


@query(
    """_l AS (SELECT DISTINCT src, dst FROM sparse_edges WHERE src <> dst), _h AS (SELECT dst AS node, CAST(0 AS BIGINT) AS hops FROM _l GROUP BY dst HAVING count(*) = 1
    UNION SELECT l.dst, h.hops + 1 FROM _h h JOIN _l l ON l.src = h.node WHERE h.hops < 5) SELECT node, min(hops) AS hops FROM _h GROUP BY node""",
    "sparse_edges",
)
def callgraph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest calls, at most five, from a function that has one caller."""
    links = view(spark, sf_dir, "sparse_edges")
    callers = links.filter("src <> dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return G.fewest_hops(links, callers.filter("n = 1").select("node"))


@query(
    """_l AS (SELECT DISTINCT src, dst FROM sparse_edges WHERE src <> dst), _p AS (SELECT src, dst, 1 AS d FROM _l UNION ALL SELECT y.src, x.dst, 2 FROM _l x JOIN _l y ON x.src = y.dst WHERE y.src <> x.dst),
    _m AS (SELECT src, dst, min(d) AS d FROM _p GROUP BY src, dst) SELECT dst AS node, count(*) FILTER (d = 1) AS direct, count(*) AS within_two FROM _m GROUP BY dst""",
    "sparse_edges",
)
def caller_bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.callers_within_two(view(spark, sf_dir, "sparse_edges"))


@query("SELECT p.src, p.dst, min(a.src) AS bridge FROM sparse_edges p JOIN sparse_edges a ON a.dst = p.src JOIN sparse_edges b ON b.dst = p.dst AND b.src = a.src GROUP BY p.src, p.dst", "sparse_edges")
def shared_caller_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "sparse_edges")
    return G.shared_neighbour(links, links, "dst", "src")


@query("SELECT p.src, p.dst, min(a.dst) AS bridge FROM sparse_edges p JOIN sparse_edges a ON a.src = p.src JOIN sparse_edges b ON b.src = p.dst AND b.dst = a.dst GROUP BY p.src, p.dst", "sparse_edges")
def shared_callee_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "sparse_edges")
    return G.shared_neighbour(links, links, "src", "dst")


@query("SELECT seq, variable, seq = min(seq) OVER (PARTITION BY variable) AS is_first FROM data_flow", "data_flow")
def path_first_access_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an access is its variable's first; the firsts are added up before they are joined."""
    flow = view(spark, sf_dir, "data_flow").select("seq", "variable")
    return flow.join(flow.groupBy("variable").agg(F.min("seq").alias("first")), "variable").select("seq", "variable", (F.col("seq") == F.col("first")).alias("is_first"))


@query("_l AS (SELECT order_id, seq, tool, lag(tool) OVER (PARTITION BY order_id ORDER BY seq) AS earlier FROM tool_events) SELECT order_id, seq, tool FROM _l WHERE tool IS DISTINCT FROM earlier", "tool_events")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's events without those that repeat the tool before."""
    earlier = F.lag("tool").over(Window.partitionBy("order_id").orderBy("seq"))
    return view(spark, sf_dir, "tool_events").withColumn("earlier", earlier).filter(~F.col("tool").eqNullSafe(F.col("earlier"))).select("order_id", "seq", "tool")


@query("_l AS (SELECT order_id, tool, lead(tool) OVER (PARTITION BY order_id ORDER BY seq) AS later FROM tool_events) SELECT tool, later, count(*) AS n FROM _l WHERE later IS NOT NULL GROUP BY ALL", "tool_events")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tool follows each other one."""
    later = F.lead("tool").over(Window.partitionBy("order_id").orderBy("seq"))
    return view(spark, sf_dir, "tool_events").withColumn("later", later).filter("later IS NOT NULL").groupBy("tool", "later").agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), m AS (SELECT *, (len(lines) + 1) // 2 AS anchor FROM l)
    SELECT doc_id, CAST(greatest(1, anchor - 2) AS BIGINT) AS first_line, CAST(least(len(lines), anchor + 2) AS BIGINT) AS last_line, len(lines) > least(len(lines), anchor + 2) - greatest(1, anchor - 2) + 1 AS truncated,
    md5(array_to_string(lines[greatest(1, anchor - 2):least(len(lines), anchor + 2)], chr(10))) AS window_md5 FROM m"""
)
def micro_window_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines on each side of a text's middle line, cut where the text lies."""
    rows = view(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines")).withColumn("n", F.size("lines"))
    anchor = F.expr("(n + 1) DIV 2")
    rows = rows.withColumn("first_line", F.greatest(F.lit(1), anchor - 2).cast("bigint")).withColumn("last_line", F.least(F.col("n"), anchor + 2).cast("bigint"))
    held = F.col("last_line") - F.col("first_line") + 1
    text = F.array_join(F.slice("lines", F.col("first_line").cast("int"), held.cast("int")), "\n")
    return rows.select("doc_id", "first_line", "last_line", (F.col("n") > held).alias("truncated"), F.md5(text.cast("binary")).alias("window_md5"))


@query(
    """WITH t AS (SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens, CAST(greatest(1, length(split_part(text, chr(10), 1)) // 4) AS BIGINT) AS window_tokens FROM documents)
    SELECT doc_id, tokens, window_tokens, CASE WHEN tokens > 0 THEN round_even(greatest(0.0, least(100.0, 100.0 * (1 - window_tokens / tokens))), 4) ELSE 0.0 END AS savings_percent FROM t"""
)
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of a text and of its first line, and what the line saves."""
    first = F.split("text", "\n", 2)[0]
    rows = view(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), F.greatest(F.lit(1).cast("bigint"), T.estimated_tokens(first)).alias("window_tokens"))
    saved = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1 - F.col("window_tokens") / F.col("tokens"))))
    return rows.withColumn("savings_percent", F.when(F.col("tokens") > 0, F.bround(saved, 4)).otherwise(0.0))


@query(
    """_f AS (SELECT order_id, substr(sha256(concat_ws('|', category, coalesce(classification, 'None'))), 1, 16) AS fingerprint FROM alarms)
    SELECT order_id, fingerprint, count(*) OVER (PARTITION BY fingerprint) - 1 AS n_siblings, min(order_id) OVER (PARTITION BY fingerprint) AS first_order FROM _f""",
    "alarms",
)
def fingerprint_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alarm's structural fingerprint, its siblings and the first of them; groups are added up before they are joined."""
    own = view(spark, sf_dir, "alarms").select("order_id", T.fingerprint(F.col("category"), F.col("classification")).alias("fingerprint"))
    sums = own.groupBy("fingerprint").agg((F.count("*") - 1).alias("n_siblings"), F.min("order_id").alias("first_order"))
    return own.join(sums, "fingerprint").select("order_id", "fingerprint", "n_siblings", "first_order")


@query(
    """SELECT line, operand, coalesce(CASE WHEN regexp_matches(text, '&\\s*0[xX][0-9a-fA-F]+') THEN CAST(concat('0x', regexp_extract(text, '&\\s*0[xX]([0-9a-fA-F]+)', 1)) AS BIGINT) END,
    TRY_CAST(nullif(regexp_extract(text, '&\\s*([0-9]+)', 1), '') AS BIGINT)) AS mask_max FROM c_lines""",
    "c_lines",
)
def mask_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest index that a line's mask lets through."""
    return view(spark, sf_dir, "c_lines").select("line", "operand", T.mask(F.col("text")).alias("mask_max"))


@query(
    """WITH t AS (SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'u' WHEN 1 THEN 's' ELSE '' END, 'int', CASE p_size % 3 WHEN 0 THEN '8' WHEN 1 THEN '16' ELSE '32' END, '_t idx') AS dtype FROM part),
    r AS (VALUES ('uint8', 0, 255, 1), ('uint16', 0, 65535, 2), ('uint32', 0, 4294967295, 3), ('int8', -128, 127, 4), ('int16', -32768, 32767, 5), ('int32', -2147483648, 2147483647, 6))
    SELECT p_partkey, dtype, CAST(arg_min(col1, col3) AS BIGINT) AS least, CAST(arg_min(col2, col3) AS BIGINT) AS most FROM t JOIN r ON contains(dtype, col0) GROUP BY ALL"""
)
def dtype_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of the integer type that a declaration names."""
    sign = F.when(F.col("p_partkey") % 4 == 0, "u").when(F.col("p_partkey") % 4 == 1, "s").otherwise("")
    width = F.when(F.col("p_size") % 3 == 0, "8").when(F.col("p_size") % 3 == 1, "16").otherwise("32")
    low, high = T.type_range(F.col("dtype"))
    return view(spark, sf_dir, "part").select("p_partkey", F.concat(sign, F.lit("int"), width, F.lit("_t idx")).alias("dtype")).select("p_partkey", "dtype", low.alias("least"), high.alias("most"))


@query(
    """WITH t AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN concat('0x', p_partkey % 10, 'Fu') WHEN 1 THEN concat('( (', p_size, 'UL) )') WHEN 2 THEN concat(' ', p_partkey, ' ') ELSE concat('-', p_size) END AS literal FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 10) * 16 + 15 WHEN 1 THEN CAST(p_size AS BIGINT) WHEN 2 THEN p_partkey END AS value FROM t"""
)
def int_literal_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of C literals, in parentheses or not; a negative one has none."""
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 4
    literal = F.when(kind == 0, F.concat(F.lit("0x"), (key % 10).cast("string"), F.lit("Fu"))).when(kind == 1, F.concat(F.lit("( ("), size.cast("string"), F.lit("UL) )"))).when(kind == 2, F.concat(F.lit(" "), key.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("-"), size.cast("string")))
    return view(spark, sf_dir, "part").select("p_partkey", T.int_literal(literal).alias("value"))


@query("SELECT line, operand, array_to_string(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\\[', 1), ',') AS indexed, array_to_string(regexp_extract_all(text, '\\[([^\\[\\]]*)\\]', 1), ',') AS operands FROM c_lines", "c_lines")
def index_access_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrays that a line indexes, and with what."""
    all_of = lambda pattern: F.array_join(F.regexp_extract_all("text", F.lit(pattern), 1), ",")
    return view(spark, sf_dir, "c_lines").select("line", "operand", all_of(r"([A-Za-z_][A-Za-z0-9_]*)\[").alias("indexed"), all_of(r"\[([^\[\]]*)\]").alias("operands"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') AS has_token FROM documents")
def token_boundary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", T.has_token(F.col("text"), "the").alias("has_token"))


EVIDENCE = """SELECT order_id, count(*) AS n_calls, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools, bool_or(tool = 'run_simulation') AS simulated,
    bool_or(tool IN ('query_call_graph', 'query_data_flow', 'inspect')) AS gaps_addressed, count(*) FILTER (tool = 'submit_verdict') AS n_submits,
    arg_max(confidence, seq) FILTER (confidence IS NOT NULL) AS confidence_so_far,
    count(*) >= 20 AND NOT (coalesce(arg_max(confidence, seq) FILTER (confidence IS NOT NULL), 'low') = 'high' AND bool_or(tool = 'run_simulation')) AS forced FROM tool_events GROUP BY order_id"""


@query(EVIDENCE, "tool_events")
def session_evidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evidence(view(spark, sf_dir, "tool_events"))


@query(
    f"""_ev AS ({EVIDENCE}) SELECT v.order_id, CASE WHEN v.classification = 'review' AND v.order_id % 3 = 0 THEN 'review_needs_reason' WHEN v.classification <> 'review' AND NOT simulated THEN 'simulation_required'
    WHEN v.order_id % 2 = 0 AND NOT gaps_addressed AND v.classification NOT IN ('review', 'undecided') THEN 'gaps_unaddressed'
    WHEN v.classification NOT IN ('review', 'undecided') AND coalesce(confidence_so_far, 'low') <> 'high' AND NOT forced THEN 'confidence_not_high'
    WHEN v.classification IN ('true', 'false') AND v.order_id % 7 = 0 THEN 'unknown_capacity' ELSE 'accepted' END AS gate FROM verdicts v JOIN _ev ON v.order_id = _ev.order_id""",
    "verdicts",
    "tool_events",
)
def verdict_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate that stops each verdict, over its session's evidence."""
    both = view(spark, sf_dir, "verdicts").join(S.evidence(view(spark, sf_dir, "tool_events")), "order_id")
    number = F.col("order_id")
    stopped = S.gate(T.normal_class(F.col("classification")), F.when(number % 3 != 0, "a reason"), number % 2 == 0, F.when(number % 7 != 0, 8))
    return both.select("order_id", stopped.alias("gate"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "verdicts").join(view(spark, sf_dir, "truth"), "order_id")


SCORED = "_s AS (SELECT v.*, t.human FROM verdicts v JOIN truth t ON v.order_id = t.order_id)"
COUNTED = "SELECT '{0}' AS policy, count(*) AS n_scored, count(*) FILTER (classification = 'review') AS n_review, count(*) FILTER (human LIKE 'true%' AND classification IN ({1})) AS tp, count(*) FILTER (human NOT LIKE 'true%' AND classification IN ({1})) AS fp, count(*) FILTER (human NOT LIKE 'true%' AND classification = 'false') AS tn, count(*) FILTER (human LIKE 'true%' AND classification = 'false') AS fn FROM _s"
POLICIES_SQL = " UNION ALL ".join(COUNTED.format(*x) for x in (("batch", "'true'"), ("population", "'true', 'true (low)'"), ("calibration", "'true', 'true (low)', 'review'")))


@query(f"{SCORED}, _c AS ({POLICIES_SQL}) SELECT *, CASE WHEN n_scored > 0 THEN round((tp + tn) / n_scored, 6) END AS accuracy_all, CASE WHEN tp + tn + fp + fn > 0 THEN round((tp + tn) / (tp + tn + fp + fn), 6) END AS accuracy_decided FROM _c", "verdicts", "truth")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(scored(spark, sf_dir))


@query(
    f"""{SCORED} SELECT order_id, CASE WHEN classification = 'review' THEN 'review' WHEN human LIKE 'true%' AND classification LIKE 'true%' THEN 'TP' WHEN human = 'false' AND classification = 'false' THEN 'TN'
    WHEN human = 'false' AND classification LIKE 'true%' THEN 'FP' WHEN human LIKE 'true%' AND classification = 'false' THEN 'FN' ELSE classification END AS outcome FROM _s""",
    "verdicts",
    "truth",
)
def outcome_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("order_id", E.outcome(F.col("human"), F.col("classification")).alias("outcome"))


@query(
    f"""{SCORED} SELECT lower(coalesce(confidence, 'unknown')) AS confidence, count(*) AS n, round(count(*) FILTER (CASE WHEN human LIKE 'true%' THEN classification LIKE 'true%' OR classification = 'review' ELSE classification = 'false' END) / count(*), 6) AS match_rate,
    count(*) FILTER (human LIKE 'true%' AND classification = 'false') AS false_on_human_true FROM _s GROUP BY 1""",
    "verdicts",
    "truth",
)
def calibration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration(scored(spark, sf_dir))


@query(
    """_l AS (SELECT classification, count(*) AS n, list_sort(list(tokens_used)) AS v, round_even(sum(tokens_used) / count(*), 2) AS mean FROM verdicts GROUP BY 1)
    SELECT classification, n, mean, v[n // 2 + 1] AS median, v[least(n - 1, n * 95 // 100) + 1] AS p95 FROM _l""",
    "verdicts",
)
def median_p95_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.upper_quantiles(view(spark, sf_dir, "verdicts"), "tokens_used", "classification").select("classification", "n", "mean", "median", "p95")


@query(f"{SCORED} SELECT order_id, human, classification FROM _s WHERE human LIKE 'true%' AND classification = 'false'", "verdicts", "truth")
def recall_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall_violations(scored(spark, sf_dir))


@query("SELECT location, count(*) AS n, min(order_id) AS first_seen, count(*) FILTER (classification LIKE 'true%') AS n_true FROM alarms GROUP BY location ORDER BY n DESC, first_seen LIMIT 20", "alarms")
def cluster_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty commonest locations."""
    return E.top_clusters(view(spark, sf_dir, "alarms"), "location", "order_id", 20)


@query("SELECT category, classification, CAST(grouping(category) * 2 + grouping(classification) AS BIGINT) AS level, count(*) AS n, min(order_id) AS first_seen FROM alarms GROUP BY GROUPING SETS ((category), (classification), (category, classification), ())", "alarms")
def cluster_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by category, class, both and in all, in one pass; level: 1 without the class, 2 without the category, 3 in all."""
    rows = view(spark, sf_dir, "alarms")
    return rows.cube("category", "classification").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.min("order_id").alias("first_seen"))


@query("SELECT classification, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM alarms GROUP BY classification", "alarms")
def tag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shares(view(spark, sf_dir, "alarms").select("classification"), "classification")


@query(
    """_o AS (SELECT order_id, human, row_number() OVER (ORDER BY CASE WHEN human LIKE 'true%' THEN -1 ELSE (order_id * 7919 + 20260824::BIGINT * 104729) % 1000003 END, order_id) AS place FROM truth)
    SELECT order_id, human FROM _o WHERE human LIKE 'true%' OR place <= 100""",
    "truth",
)
def sample_forced_plus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All true alarms, filled up to a hundred with false ones."""
    return E.sampled(view(spark, sf_dir, "truth"), 100, 20260824)


@query(
    """_r AS (SELECT order_id, human, row_number() OVER (PARTITION BY human ORDER BY (order_id * 7919 + 20260823::BIGINT * 104729) % 1000003, order_id) AS rank FROM truth)
    SELECT order_id, human, rank FROM _r WHERE rank <= CASE human WHEN 'true' THEN 16 WHEN 'true (low)' THEN 4 WHEN 'false' THEN 30 ELSE 0 END""",
    "truth",
)
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified(view(spark, sf_dir, "truth"), {"true": 16, "true (low)": 4, "false": 30}, 20260823)


@query("SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_verdict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON answer, null where it has none."""
    return view(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT order_id, '' AS classification, trim(CASE WHEN instr(concat(category, ': ', location), ': ') > 0 THEN substr(concat(category, ': ', location), instr(concat(category, ': ', location), ': ') + 2) END) AS message FROM alarms", "alarms")
def label_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms as the engine may see them: without labels, messages without their prefix."""
    rows = view(spark, sf_dir, "alarms").select("order_id", "classification", F.concat("category", F.lit(": "), "location").alias("message"))
    return scrubbed(rows, "message", ["classification"])


@query(
    """SELECT caller, callee, line, (SELECT min(struct_pack(d := coalesce(abs(f.start_line - c.line), 0), s := f.start_line)).s FROM functions f WHERE f.name = c.callee) AS nearest_span FROM control_flow c""",
    "control_flow",
    "functions",
)
def nearest_span_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each call the function of the callee's name that starts nearest; the first of that name for a call without a line."""
    calls = view(spark, sf_dir, "control_flow").select("caller", F.col("callee").alias("name"), "line")
    spans = view(spark, sf_dir, "functions").select("name", F.col("start_line").alias("line"))
    found = J.nearest(calls, spans, "name", "line", width=1 << 16).join(spans.groupBy("name").agg(F.min("line").alias("first")), "name", "left")
    return found.select("caller", F.col("name").alias("callee"), "line", F.when(F.col("line").isNull(), F.col("first")).otherwise(F.col("found")).alias("nearest_span"))


@query(
    """_w AS (SELECT split_part(variable, '@', 1) AS symbol, line, 1 AS source FROM data_flow WHERE access = 'write' UNION ALL SELECT operand, line, 2 FROM c_lines WHERE text LIKE '% = %')
    SELECT symbol, line, CAST(min(source) AS BIGINT) AS source, count(*) AS n_rows FROM _w GROUP BY symbol, line""",
    "data_flow",
    "c_lines",
)
def write_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes from the data flow and from the source text; a line of both counts for the first."""
    flow = view(spark, sf_dir, "data_flow").filter("access = 'write'").select(T.bare_name(F.col("variable")).alias("symbol"), "line", F.lit(1).cast("bigint").alias("source"))
    text = view(spark, sf_dir, "c_lines").filter(F.contains("text", F.lit(" = "))).select(F.col("operand").alias("symbol"), "line", F.lit(2).cast("bigint").alias("source"))
    return flow.unionByName(text).groupBy("symbol", "line").agg(F.min("source").alias("source"), F.count("*").alias("n_rows"))


@query(
    """_n AS (SELECT split_part(variable, '@', 1) AS bare, seq FROM data_flow), _k AS (SELECT bare, seq, row_number() OVER (PARTITION BY bare ORDER BY seq) AS r FROM _n QUALIFY r <= 20),
    _s AS (SELECT bare, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS sites FROM _k GROUP BY bare), _a AS (SELECT DISTINCT split_part(bare, '.', 1) || m AS asked FROM _n, (VALUES (''), ('.f'), ('.g')) t(m))
    SELECT asked, coalesce(a.sites, b.sites) AS sites FROM _a LEFT JOIN _s a ON a.bare = asked LEFT JOIN _s b ON b.bare = split_part(asked, '.', 1)""",
    "data_flow",
)
def dataflow_sites_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty accesses of a member, or of its object where the member has none."""
    flow = view(spark, sf_dir, "data_flow").select(T.bare_name(F.col("variable")).alias("bare"), "seq")
    top = J.first_of(flow, ["bare"], [F.asc("seq")], 20).groupBy("bare").agg(F.array_join(F.array_sort(F.collect_list("seq")).cast("array<string>"), ",").alias("sites"))
    asked = flow.select(F.substring_index("bare", ".", 1).alias("root")).distinct().select("root", F.explode(F.array(F.lit(""), F.lit(".f"), F.lit(".g"))).alias("member")).select("root", F.concat("root", "member").alias("asked"))
    own = asked.join(top.withColumnRenamed("bare", "asked"), "asked", "left")
    return own.join(top.select(F.col("bare").alias("root"), F.col("sites").alias("of_root")), "root", "left").select("asked", F.coalesce("sites", "of_root").alias("sites"))


@query(
    """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages) SELECT page_id, count(*) FILTER (trim(line) <> '') AS n_lines,
    coalesce(CAST(min(length(line) - length(ltrim(line, ' \t'))) FILTER (ltrim(line, ' \t') NOT IN ('', '{', '}') AND ltrim(line, ' \t') NOT LIKE '#%') AS BIGINT), 0) AS indent FROM l GROUP BY page_id"""
)
def dedent_min_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not blank, and the least indent of those that are no preprocessor line and no bare brace; none: zero."""
    lines = F.filter(F.split("html", "\n", -1), lambda x: F.trim(x) != "")
    bare = lambda x: F.ltrim(x, F.lit(" \t"))
    counted = F.filter(lines, lambda x: ~bare(x).isin("", "{", "}") & ~bare(x).startswith("#"))
    indents = F.transform(counted, lambda x: F.length(x) - F.length(bare(x)))
    return view(spark, sf_dir, "pages").select("page_id", F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.array_min(indents), F.lit(0)).cast("bigint").alias("indent"))


@query("SELECT t.order_id, t.human FROM truth t WHERE NOT EXISTS (SELECT 1 FROM tool_events e WHERE e.order_id = t.order_id AND e.tool = 'submit_verdict')", "truth", "tool_events")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled alarms that have no submitted verdict yet."""
    done = view(spark, sf_dir, "tool_events").filter("tool = 'submit_verdict'").select("order_id")
    return view(spark, sf_dir, "truth").join(done, "order_id", "left_anti").select("order_id", "human")


@query("SELECT order_id, string_agg(tool, '>' ORDER BY seq) AS trace, count(*) AS n_calls, max(seq) FILTER (tool = 'submit_verdict') AS last_submit FROM tool_events GROUP BY order_id", "tool_events")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's tools in order, and its last submission."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "tool"))), lambda x: x["tool"])
    return view(spark, sf_dir, "tool_events").groupBy("order_id").agg(F.array_join(ordered, ">").alias("trace"), F.count("*").alias("n_calls"), F.max(F.when(F.col("tool") == "submit_verdict", F.col("seq"))).alias("last_submit"))


@query("SELECT order_id, location, (SELECT count(*) FROM alarms) AS total FROM alarms ORDER BY order_id LIMIT 500", "alarms")
def order_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the alarm list, with the number of all alarms."""
    rows = view(spark, sf_dir, "alarms")
    return spark.sql("SELECT order_id, location, (SELECT count(*) FROM {rows}) AS total FROM {rows} ORDER BY order_id LIMIT 500", rows=rows)
