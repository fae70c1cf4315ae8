"""Queries over export files: the test tables are written as the analyser's exports and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwright.jobs.catalogue import LOCATED, query
from boundwright.sources import exports as X
from boundwright.sources.projections import view
from boundwright.sources.shared import written

#: Orders or rows in a file.
PART = 20_000
#: Calls in a file, about.
CALLS = 200_000
MARK = "﻿sep=;"


@query(
    f"""{LOCATED}, _a AS (SELECT order_id, category, classification FROM alarms WHERE order_id % 101 <> 0)
    SELECT a.order_id, a.category, l.file AS source, l.line, l.col_start, l.end_line, l.col_end, a.classification, concat('index; "v', a.order_id % 40, '" : out of bounds') AS message FROM _a a JOIN located l ON l.order_id = a.order_id""",
    "alarms",
)
def export_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms from export files with a byte order mark, a title before the header, quoted messages, orders with separators, repeated and bad orders."""
    rows = view(spark, sf_dir, "alarms").select("*", F.expr(f"CAST(order_id DIV {PART} AS INT)").alias("part"))
    order = F.expr("CASE WHEN order_id % 101 = 0 THEN 'n/a' WHEN order_id % 3 = 0 THEN format_number(order_id, 0) ELSE concat(' ', order_id) END")
    message = F.expr("""concat('"index; ""v', order_id % 40, '"" : out of bounds"')""")
    line = lambda label: F.concat_ws(";", message, "category", order, "location", label)
    first = rows.filter("order_id % 7 = 0").select("part", (F.col("order_id") * 2).alias("place"), line(F.lit("review")).alias("text"))
    blank = rows.filter("order_id % 50 = 1").select("part", (F.col("order_id") * 2).alias("place"), F.lit(" ; ;;").alias("text"))
    last = rows.select("part", (F.col("order_id") * 2 + 1).alias("place"), line(F.col("classification")).alias("text"))
    path = X.export_files(first.unionByName(blank).unionByName(last), [MARK, "", "Run; of the analyser", "Message;Category;Order;Location;Classification"], "alarm-export")
    # Cut once: the aggregate would cut a line again for each column.
    read = X.latest(written(X.alarms(X.semicolon_csv(spark, path, X.ALARMS)), "alarms"), "order_id")
    return read.select("order_id", F.col("Category").alias("category"), "source", "line", "col_start", "end_line", "col_end", F.col("Classification").alias("classification"), F.col("Message").alias("message"))


@query(
    f"""_p AS (SELECT *, seq // {PART} AS part FROM data_flow) SELECT CAST(part AS BIGINT) AS part, row_number() OVER (PARTITION BY part ORDER BY seq) + 2 AS row, variable, split_part(variable, '@', 1) AS bare, function, access, line FROM _p""",
    "data_flow",
)
def export_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses from export files, with the row that each has in its file."""
    flow = view(spark, sf_dir, "data_flow")
    text = F.concat_ws(";", F.lit("P1"), "variable", "access", F.concat(F.lit(" "), F.col("function")), F.concat(F.lit("src.c:"), F.col("line"), F.lit(".1-9")))
    path = X.export_files(flow.select(F.expr(f"CAST(seq DIV {PART} AS INT)").alias("part"), F.col("seq").alias("place"), text.alias("text")), ["sep=;", "Process;Variable;Access;Function;Location"], "access-export", "\r\n")
    read = X.accesses(X.semicolon_csv(spark, path, X.ACCESSES)).withColumn("part", F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint"))
    return read.select("part", "row", F.col("Variable").alias("variable"), "bare", F.col("Function").alias("function"), F.col("Access").alias("access"), "line")


@query("SELECT caller, callee, process, line, count(*) AS n FROM control_flow GROUP BY ALL", "control_flow")
def export_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each call stands in export files; calls may lack a site or a caller."""
    calls = view(spark, sf_dir, "control_flow")
    site = F.coalesce(F.concat(F.lit("src.c:"), F.col("line"), F.lit(".3")), F.lit("unknown"))
    # As many files as calls need; 16 at least.
    files = max(16, calls.count() // CALLS + 1)
    part = F.pmod(F.xxhash64("caller", "callee", "line"), F.lit(files)).cast("int")
    path = X.export_files(calls.select(part.alias("part"), F.lit(0).cast("bigint").alias("place"), F.concat_ws(";", "caller", "callee", site, "process").alias("text")), ["Caller;Callee;Call site;Process"], "call-export", "\r")
    read = X.calls(X.semicolon_csv(spark, path, X.CALLS))
    return read.groupBy(F.col("Caller").alias("caller"), F.col("Callee").alias("callee"), F.col("Process").alias("process"), "line").agg(F.count("*").alias("n"))


@query("SELECT order_id, CASE WHEN order_id % 9 = 0 THEN 'review' ELSE human END AS human FROM truth", "truth")
def export_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of each order in export files where orders repeat, later ones partly without a label."""
    truth = view(spark, sf_dir, "truth").withColumn("part", F.expr(f"CAST(order_id DIV {PART} AS INT)"))
    line = lambda place, label: truth.select("part", (F.col("order_id") + place).alias("place"), F.concat_ws(";", F.format_number("order_id", 0), label).alias("text"))
    rows = line(0, F.lit("review")).unionByName(line(1 << 40, F.expr("CASE WHEN order_id % 9 = 0 THEN ' ' ELSE human END"))).unionByName(line(1 << 41, F.lit("")))
    return X.labels(X.semicolon_csv(spark, X.export_files(rows, [MARK, "Order;Classification"], "label-export"), X.LABELS))


@query(
    f"""_p AS (SELECT line // {PART} AS part, line AS place, 0 AS piece, text FROM c_lines UNION ALL SELECT line // {PART}, line, 1, concat('/* page ', line, ' */') FROM c_lines WHERE line % 10 = 0)
    SELECT CAST(part AS BIGINT) AS part, row_number() OVER (PARTITION BY part ORDER BY place, piece) AS line, text FROM _p""",
    "c_lines",
)
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered lines of source files in which form feeds break lines too."""
    text = F.expr("CASE WHEN line % 10 = 0 THEN concat(text, '\f', '/* page ', line, ' */') ELSE text END")
    rows = view(spark, sf_dir, "c_lines").select(F.expr(f"CAST(line DIV {PART} AS INT)").alias("part"), F.col("line").alias("place"), text.alias("text"))
    read = X.text_lines(spark, X.export_files(rows, [], "source", "\r\n"))
    return read.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part"), "line", "text")
