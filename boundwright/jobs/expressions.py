"""Queries over C text, messages and reports, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwright.functions import c_text as C
from boundwright.functions import text as T
from boundwright.jobs.catalogue import LOCATED, placed_alarms, query
from boundwright.operators import joins as J
from boundwright.sources.projections import view
from boundwright.sources.shared import written

SKIPPED = ", ".join(f"'{x}'" for x in C.NO_SYMBOLS)
ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
NAMES = ORDERED.format("regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*')")
CALLED = f"list_filter(regexp_extract_all(text, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), lambda x: x NOT IN ({SKIPPED}))"


@query(
    f"""_f AS (SELECT *, {NAMES} AS ids, {ORDERED.format(CALLED)} AS called FROM c_lines)
    SELECT line, operand, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, trim(regexp_replace(replace(text, '->', '.'), '\\.\\s+', '.', 'g')) AS members,
    trim(regexp_replace(trim(text), '^(?i)({'|'.join(C.LEADING)})\\b', '')) AS bare, trim(regexp_extract(replace(split_part(text, '[', 1), '->', '.'), '[A-Za-z0-9_.]*$'), ' .') AS indexed_path,
    array_to_string(ids, ',') AS identifiers, array_to_string(called, ',') AS callees,
    array_to_string(list_filter(ids, lambda x: x NOT IN ({SKIPPED}) AND NOT list_contains(called, x) AND NOT x LIKE '%Type' AND NOT (regexp_matches(x, '^C[A-Z][a-z]+$') AND NOT contains(x, 'Idx'))), ',') AS symbols,
    regexp_full_match(operand, '[A-Za-z_][A-Za-z0-9_]*') AS is_identifier, concat('src.c:', line, '.1-', greatest(1, line % 9)) AS location FROM _f""",
    "c_lines",
)
def expression_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of each C line: blanks, member accesses, keywords, identifiers in order, callees and usable symbols."""
    text, joined = F.col("text"), lambda x: F.array_join(x, ",")
    names, called = C.identifiers(text), C.callees(text)
    return view(spark, sf_dir, "c_lines").select(
        "line", "operand", C.collapsed(text).alias("collapsed"), C.member_access(text).alias("members"), C.without_keyword(text).alias("bare"),
        C.rightmost_path(C.member_access(F.substring_index(text, "[", 1))).alias("indexed_path"), joined(names).alias("identifiers"), joined(called).alias("callees"),
        joined(C.symbols(names, called)).alias("symbols"), C.is_identifier(F.col("operand")).alias("is_identifier"), C.made_location(F.lit("src.c"), F.col("line"), F.col("line") % 9).alias("location"),
    )


@query(
    """_b AS (SELECT line, operand, text, line % 20 + 1 AS col, unnest(list_filter(range(1, length(text) + 1), lambda i: text[i] = '[')) - 1 AS place FROM c_lines)
    SELECT line, any_value(operand) AS operand, any_value(col) AS col, min(struct_pack(d := abs(place - (col - 1)), p := place)).p AS bracket FROM _b GROUP BY line""",
    "c_lines",
)
def nearest_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bracket of each line that opens nearest to a column, the earlier of two, within the row itself."""
    rows = view(spark, sf_dir, "c_lines").withColumn("col", F.col("line") % 20 + 1)
    letters = F.split("text", "")
    places = F.filter(F.transform(letters, lambda x, i: F.when(x == "[", i)), lambda x: x.isNotNull())
    near = F.array_min(F.transform(places, lambda p: F.struct(F.abs(p - (F.col("col") - 1)).alias("d"), p.alias("p"))))
    return rows.select("line", "operand", "col", near["p"].cast("bigint").alias("bracket")).filter("bracket IS NOT NULL")


@query(
    f"""_i AS (SELECT line, text, unnest({NAMES}) AS name, unnest(range(len({NAMES}))) AS seq FROM c_lines), _w AS (SELECT DISTINCT line, split_part(variable, '@', 1) AS name FROM data_flow),
    _s AS (SELECT i.line, i.name, seq, CASE WHEN regexp_matches(text, concat('\\b', i.name, '\\s*\\(')) THEN 1 ELSE 0 END AS called,
      CASE WHEN regexp_matches(i.name, '^v[0-9]*[036]$') THEN 100 ELSE 0 END + CASE WHEN w.name IS NOT NULL THEN 50 ELSE 0 END + CASE WHEN i.name LIKE 'arr%' THEN 20 ELSE 0 END
      - CASE WHEN regexp_matches(text, concat('\\b', i.name, '\\s*\\(')) THEN 80 ELSE 0 END - CASE WHEN regexp_matches(text, concat('\\b', i.name, '\\s*\\[')) THEN 120 ELSE 0 END AS score
      FROM _i i LEFT JOIN _w w ON w.line = i.line AND w.name = i.name),
    _b AS (SELECT line, min(struct_pack(k := -score, n := length(name), q := seq, name := name)) AS best, arg_max(name, seq) FILTER (called = 0) AS last_name, arg_min(name, seq) AS first_name FROM _s GROUP BY line)
    SELECT line, CASE WHEN best.k < 80 THEN best.name ELSE coalesce(last_name, first_name) END AS operand, CAST(-best.k AS BIGINT) AS score FROM _b""",
    "c_lines",
    "data_flow",
)
def operand_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest index operand of each line: parameters, names of the data flow at the line and declared names before others, callees and arrays last; the shorter of equals."""
    flow = view(spark, sf_dir, "data_flow").select("line", T.bare_name(F.col("variable")).alias("name"), F.lit(50).alias("seen")).distinct()
    rows = view(spark, sf_dir, "c_lines").select("line", "text", F.posexplode(C.identifiers(F.col("text"))).alias("seq", "name")).join(flow, ["line", "name"], "left")
    followed = lambda sign: F.expr(f"regexp_like(text, concat('\\\\b', name, '\\\\s*\\\\{sign}'))")
    called = followed("(")
    score = F.when(F.col("name").rlike("^v[0-9]*[036]$"), 100).otherwise(0) + F.coalesce("seen", F.lit(0)) + F.when(F.col("name").startswith("arr"), 20).otherwise(0)
    score = score - F.when(called, 80).otherwise(0) - F.when(followed("["), 120).otherwise(0)
    best = rows.groupBy("line").agg(
        F.min(F.struct((-score).alias("k"), F.length("name").alias("n"), "seq", "name")).alias("best"), F.max_by("name", F.when(~called, F.col("seq"))).alias("last_name"), F.min_by("name", "seq").alias("first_name")
    )
    return best.select("line", F.when(F.col("best.k") < 80, F.col("best.name")).otherwise(F.coalesce("last_name", "first_name")).alias("operand"), (-F.col("best.k")).cast("bigint").alias("score"))


ERROR_SQL = "CASE event_id % 7 WHEN 0 THEN concat('Read timed out after ', user_id, ' s') WHEN 1 THEN 'HTTP 429: Too Many Requests' WHEN 2 THEN concat('Connection reset by peer ', user_id) WHEN 3 THEN concat('no such function fn_', user_id, ' in a very long message that goes on and on and on until it is cut somewhere') ELSE NULL END"


@query(
    f"""WITH e AS (SELECT event_id, {ERROR_SQL} AS error FROM events), k AS (SELECT *, lower(error) AS low FROM e WHERE error IS NOT NULL)
    SELECT left(error, 80) AS error, CASE WHEN contains(low, 'timed out') OR contains(low, 'timeout') THEN 'timeout' WHEN contains(low, '429') OR contains(low, 'too many requests') THEN 'rate_limit' WHEN contains(low, 'connection reset') THEN 'network' END AS kind,
    count(*) AS n FROM k GROUP BY ALL"""
)
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each error, cut to 80 characters, came, and whether it is worth a retry."""
    errors = view(spark, sf_dir, "events").select(F.expr(ERROR_SQL).alias("error")).filter("error IS NOT NULL")
    return errors.groupBy(F.substring("error", 1, 80).alias("error"), C.error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT conv_id, CASE WHEN turn % 3 = 0 AND turn > 0 THEN turn * 100 WHEN turn % 3 = 1 THEN turn * 10 + 7 WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM conversations)
    SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY conv_id"""
)
def message_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each conversation: those that a provider states, in all or given and made, else estimated ones."""
    turn = F.col("turn")
    tokens = C.message_tokens(F.col("text"), F.when(turn % 3 == 0, turn * 100), F.when(turn % 3 == 1, turn * 10), F.when(turn % 3 == 1, F.lit(7)))
    return view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(tokens).alias("tokens"))


RAW_CLASS = "CASE doc_id % 11 WHEN 0 THEN 'FP' WHEN 1 THEN 'true_low' WHEN 2 THEN ' T ' WHEN 3 THEN 'u' WHEN 4 THEN 'tp' WHEN 5 THEN 'weird' WHEN 6 THEN NULL WHEN 7 THEN 'Low' WHEN 8 THEN 'bug' WHEN 9 THEN 'inter_procedural' ELSE 'uncertain' END"


@query(
    f"""WITH r AS (SELECT doc_id, {RAW_CLASS} AS raw, CASE doc_id % 4 WHEN 0 THEN ' High' WHEN 1 THEN 'sure' WHEN 2 THEN 'low' END AS conf FROM documents)
    SELECT doc_id, CASE raw WHEN 'FP' THEN 'false' WHEN 'true_low' THEN 'true (low)' WHEN 'Low' THEN 'true (low)' WHEN ' T ' THEN 'true' WHEN 'tp' THEN 'true' WHEN 'bug' THEN 'true' WHEN 'u' THEN 'undecided' WHEN 'inter_procedural' THEN 'undecided' ELSE 'review' END AS classification,
    CASE raw WHEN 'FP' THEN 'false' WHEN 'true_low' THEN 'true (low)' WHEN 'Low' THEN 'true (low)' WHEN ' T ' THEN 'true' WHEN 'bug' THEN 'true' WHEN 'u' THEN 'undecided' WHEN 'inter_procedural' THEN 'undecided' WHEN 'uncertain' THEN 'review' END AS submitted,
    CASE conf WHEN ' High' THEN 'high' WHEN 'low' THEN 'low' ELSE 'medium' END AS confidence FROM r"""
)
def report_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their class, as a report and as a submission take it (null: unknown), and confidence by aliases and defaults."""
    raw, conf = F.expr(RAW_CLASS), F.lower(F.trim(F.expr("CASE doc_id % 4 WHEN 0 THEN ' High' WHEN 1 THEN 'sure' WHEN 2 THEN 'low' END")))
    stated = F.when(conf.isin("low", "medium", "high"), conf).otherwise("medium")
    return view(spark, sf_dir, "documents").select("doc_id", C.report_class(raw).alias("classification"), T.normal_class(raw).alias("submitted"), stated.alias("confidence"))


@query(
    f"""{LOCATED}, _d AS (SELECT line, array_to_string(list_sort(list(DISTINCT split_part(variable, '@', 1))), ',') AS names FROM data_flow GROUP BY line),
    _m AS (SELECT p.order_id, max(struct_pack(s := f.start_line, i := f.fn_id, n := f.name)).n AS name FROM located p JOIN functions f ON p.line BETWEEN f.start_line AND f.end_line GROUP BY p.order_id)
    SELECT p.order_id, p.line, m.name AS function_name, coalesce(d.names, '') AS names FROM located p LEFT JOIN _m m ON m.order_id = p.order_id LEFT JOIN _d d ON d.line = p.line""",
    "alarms",
    "functions",
    "data_flow",
)
def alarm_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alarm with its enclosing function and the names of the data flow at its line."""
    placed = written(placed_alarms(spark, sf_dir), "placed")
    names = view(spark, sf_dir, "data_flow").groupBy(F.col("line").alias("at")).agg(F.array_join(F.array_sort(F.collect_set(T.bare_name(F.col("variable")))), ",").alias("names"))
    met = J.enclosing(placed, view(spark, sf_dir, "functions"))
    return met.join(names, met["line"] == names["at"], "left").select("order_id", "line", F.col("name").alias("function_name"), F.coalesce("names", F.lit("")).alias("names"))


@query(
    """_n AS (SELECT seq, split_part(variable, '@', 1) AS bare, CASE WHEN contains(variable, '@') THEN substr(variable, strpos(variable, '@') + 1) ELSE function END AS scope, access, line FROM data_flow)
    SELECT r.seq, r.bare, r.scope, r.line, (SELECT count(*) FROM _n w WHERE w.bare = r.bare AND w.scope = r.scope AND w.access = 'write' AND w.line < r.line) AS n_prior FROM _n r WHERE r.access = 'read'""",
    "data_flow",
)
def prior_writes_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many writes of the variable in the scope of each read stand on earlier lines: writes are counted by line before their running sum."""
    at = F.instr("variable", "@")
    scope = F.when(at > 0, F.col("variable").substr(at + 1, F.length("variable"))).otherwise(F.col("function"))
    flow = view(spark, sf_dir, "data_flow").select("seq", T.bare_name(F.col("variable")).alias("bare"), scope.alias("scope"), "access", "line")
    counts = J.running_before(flow.filter("access = 'read'").drop("access"), flow.filter("access = 'write'"), ["bare", "scope"], "line")
    return counts.select("seq", "bare", "scope", "line", F.col("before").alias("n_prior"))
