"""Readers of the analyser's exports and of source text, line by line, and the label scrub.

A file is read in splits, however long it is: its lines get their numbers from the splits' own counts and a running
sum over splits, one row each. Lines are written to the shared folder once, so later steps see one numbering even
where executors are lost between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boundwright.functions import text as T
from boundwright.sources.shared import WRITTEN, shared_dir, written

#: Line breaks besides LF, CR and CR LF.
BREAKS = "[\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Words that mark a header for certain, and the columns of each export.
MARKS = ("Caller", "Variable", "Order")
ALARMS = ("Order", "Type", "Category", "Location", "Classification", "Comment", "Message")
ACCESSES = ("Variable", "Function", "Access", "Process", "Data races", "Shared variable", "Byte offset", "Location")
CALLS = ("Caller", "Callee", "Call site", "Process")
LABELS = ("Order", "Classification")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of all lines below a path, counted from 1 in each file; any line break counts. A break that ends a file opens no line."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.posexplode(F.split("value", BREAKS)).alias("piece", "text"))
    rows = written(read.withColumn("at", F.monotonically_increasing_id()), "lines")
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(of.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"), F.sum("n").over(of).alias("total"))
    numbered = rows.join(blocks, ["file", "block"]).withColumn("line", F.col("at") + F.col("shift"))
    return numbered.filter("NOT (piece > 0 AND text = '' AND line = total)").select("file", "line", "text")


def cells(text: Column) -> Column:
    """The cells of a line between semicolons: quoted ones may hold semicolons and doubled quotes; a quote left open ends with its line."""
    quoted = r'"([^"]*+(?:""[^"]*+)*+)'
    parts = F.regexp_extract_all(F.concat(F.lit(";"), text), F.lit(rf';({quoted}(?:"[^;]*+|$)|[^;]*+)'), F.lit(1))
    inner = lambda x: F.concat(F.replace(F.regexp_extract(x, f"^{quoted}", 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, rf'^{quoted}"(.*)$', 2))
    return F.transform(parts, lambda x: F.when(x.startswith('"'), inner(x)).otherwise(x))


def semicolon_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """file, row (the line's number) and the given columns of semicolon-separated exports, stripped strings; a column that a file or line lacks is empty.

    Each file has a header of its own, in any order: the first line with a semicolon, a letter in its first cell and a word of
    MARKS; without such a word the last line with the others. Lines before it (`sep=`, titles), a byte order mark and blank rows are
    skipped; of columns of one name the last counts. A file whose lines hold no header is an error; one without lines has no rows.
    """
    lines = text_lines(spark, path).withColumn("text", F.when(F.col("line") == 1, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")))
    head = F.contains(F.col("text"), F.lit(";")) & ~F.lower("text").startswith("sep=") & F.substring_index("text", ";", 1).rlike(r"\p{L}")
    sure = F.when(head & F.col("text").rlike("|".join(MARKS)), F.col("line"))
    maybe = F.when(head, F.col("line"))
    # Numbers first, then the text of those lines: no task sorts the texts of its files.
    heads = lines.groupBy("file").agg(F.coalesce(F.min(sure), F.max(maybe)).alias("header"))
    missing = F.raise_error(F.concat(F.lit("no header in "), F.col("file"))).cast("bigint")
    names = F.reverse(cells(F.col("names")))
    # Where each column stands, once a file; of columns of one name the last.
    place = lambda name: F.when(F.array_contains(names, name), F.size(names) - F.array_position(names, name)).cast("int").alias(f"at_{columns.index(name)}")
    heads = heads.select("file", F.coalesce("header", missing).alias("header"))
    found = lines.select("file", F.col("line").alias("header"), F.col("text").alias("names")).join(F.broadcast(heads), ["file", "header"])
    heads = F.broadcast(written(found.select("file", "header", *map(place, columns)), "heads"))
    # A line with a letter besides separators and quotes is no blank row; only others are cut to see.
    told = F.col("text").rlike(r'[^;\s"]') | ~F.array_join(cells(F.col("text")), "").rlike(r"^\s*$")
    rows = lines.join(heads, "file").filter("line > header").filter(told).withColumn("cells", cells(F.col("text")))
    value = lambda name: F.regexp_replace(F.coalesce(F.get("cells", F.col(f"at_{columns.index(name)}")), F.lit("")), r"^\s+|\s+$", "").alias(name)
    return rows.select("file", F.col("line").alias("row"), *map(value, columns))


def alarms(rows: DataFrame) -> DataFrame:
    """Alarms with typed order and location; rows whose order is no integer are dropped."""
    where = T.location(F.col("Location"))
    return rows.withColumn("order_id", T.order_id(F.col("Order"))).filter("order_id IS NOT NULL").withColumns({k: c for k, c in where.items() if k != "file"} | {"source": where["file"]})


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key, by file and row."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct("file", "row")).alias("last")).select(key, "last.*")


def accesses(rows: DataFrame) -> DataFrame:
    """Accesses with the line of their location (null: none) and the variable without its scope."""
    return rows.withColumns({"line": T.location(F.col("Location"))["line"], "bare": T.bare_name(F.col("Variable"))})


def calls(rows: DataFrame) -> DataFrame:
    """Calls with the line of their site (null: none)."""
    return rows.withColumn("line", T.location(F.col("Call site"))["line"])


def labels(rows: DataFrame) -> DataFrame:
    """(order_id, human): the last label of each order that isn't empty; orders may have separators but no blanks inside."""
    order = F.replace("Order", F.lit(","), F.lit("")).try_cast("bigint")
    return latest(rows.select(order.alias("order_id"), F.col("Classification").alias("human"), "file", "row").filter("order_id IS NOT NULL AND human <> ''"), "order_id").select("order_id", "human")


def export_files(rows: DataFrame, head: Sequence[str], label: str, line_break: str = "\n") -> str:
    """Write (part, place, text) to the shared folder: one text file a part, its lines by place below the lines of head; the folder."""
    path = shared_dir(rows.sparkSession, label)
    WRITTEN.append(path)
    if head:
        top = rows.select("part").distinct().select("part", F.posexplode(F.array(*map(F.lit, head))).alias("place", "text"))
        rows = rows.select("part", F.col("place").cast("bigint").alias("place"), "text").unionByName(top.withColumn("place", F.col("place").cast("bigint") - (1 << 40)))
    rows.repartition("part").sortWithinPartitions("part", "place").select("text", "part").write.partitionBy("part").option("lineSep", line_break).text(path)
    return path


def scrubbed(rows: DataFrame, message: str, blank: list[str]) -> DataFrame:
    """Labels and comments blanked; a message keeps what follows its first `: `, trimmed."""
    at = F.instr(F.col(message), ": ")
    short = F.trim(F.when(at > 0, F.col(message).substr(at + 2, F.length(message))).otherwise(F.col(message)))
    return rows.withColumns({message: short} | {c: F.lit("") for c in blank})
