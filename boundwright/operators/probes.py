"""What stands on the lines around a place: arguments of calls, assignments, and all writes of a symbol before an access.

Places and what they look for meet on a bucket of lines (and a name), never on a name alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundwright.functions import c_text as C
from boundwright.operators import joins as J
from boundwright.sources.shared import written

#: Lines before and after a call in which its arguments may stand; the lines around an assignment in the order in which they count; letters and names that are kept.
CALL_BAND, PROBED, CUT, NAMES = (-2, 10), (0, -1, 1, -2, 2), (240, 300), 12
#: Lines in a bucket of the two line probes.
NEAR = 64


def banded(asked: DataFrame, known: DataFrame, line: str, band: tuple[int, int], on: list[str] | None = None) -> DataFrame:
    """asked joined to the rows of known (`at`) whose line is at most so far before and behind its own; with `on`, of equal names too."""
    edge = lambda d: F.floor((F.col(line) + d) / NEAR)
    rows = asked.withColumn("bucket", F.explode(F.sequence(edge(band[0]), edge(band[1]))))
    return rows.join(known.withColumn("bucket", F.floor(F.col("at") / NEAR)), [*(on or []), "bucket"]).filter(F.col("at").between(F.col(line) + band[0], F.col(line) + band[1])).drop("bucket")


def call_arguments(asked: DataFrame, calls: DataFrame) -> DataFrame:
    """asked (order_id, callee, call_line, arg_index) with expression, names, at and call_text; nulls where no call has that argument.

    calls: (line, seq, target, args array<string>, call_text), target as it is written. The first call counts, by line and seq,
    in the band around the line that is the callee's (its last name equal, or the callee a part of the target), is indexed
    (`table[i]`), or has no target, and has enough arguments; else the first call on the line itself that has enough; of calls of one line and seq the least expression, then text.
    Copies of a question are asked once.
    """
    questions = asked.select("callee", "call_line", "arg_index").distinct().filter("callee <> '' AND arg_index >= 0 AND call_line IS NOT NULL")
    known = calls.filter("line >= 1").select(F.col("line").alias("at"), "seq", F.coalesce("target", F.lit("")).alias("target"), "args", "call_text")
    met = banded(questions, known, "call_line", CALL_BAND).filter(F.size("args") > F.col("arg_index"))
    name = C.last_member(F.col("target"))
    own = (name == F.col("callee")) | F.contains("target", "callee") | (name == "") | F.contains("target", F.lit("["))
    rank = F.when(own, 0).when(F.col("at") == F.col("call_line"), 1)
    expression = F.get("args", F.col("arg_index").cast("int"))
    found = met.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("callee", "call_line", "arg_index").agg(F.min(F.struct("rank", "at", "seq", expression.alias("e"), "call_text")).alias("f"))
    names = F.slice(F.filter(C.identifiers(F.col("f.e")), lambda x: x != F.col("callee")), 1, NAMES)
    found = found.select("callee", "call_line", "arg_index", F.substring("f.e", 1, CUT[0]).alias("expression"), names.alias("names"), "f.at", "f.call_text")
    return asked.join(found, ["callee", "call_line", "arg_index"], "left")


def assignment_texts(asked: DataFrame, source: DataFrame) -> DataFrame:
    """asked (name, line, ...) with `text`: of the lines around, nearest first and the earlier of two, the first that has the name and an assignment; else the line itself; empty where it isn't in the source (line, text)."""
    known = source.select(F.col("line").alias("at"), F.col("text").alias("own"))
    met = banded(asked.select("name", "line").distinct(), known, "line", (min(PROBED), max(PROBED)))
    writes = F.contains("own", F.lit("=")) | F.contains("own", F.concat("name", F.lit("++"))) | F.contains("own", F.concat("name", F.lit("--")))
    place = F.array_position(F.array(*map(F.lit, PROBED)), (F.col("at") - F.col("line")).cast("int"))
    rank = F.when(F.contains("own", "name") & writes, place).when(F.col("at") == F.col("line"), len(PROBED) + 1)
    # A line that isn't in the source has no text, whatever stands around it.
    best = met.withColumn("rank", rank).groupBy("name", "line").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "own"))).alias("f"), F.max(F.col("at") == F.col("line")).alias("known"))
    best = best.filter("known").select("name", "line", F.substring(F.trim("f.own"), 1, CUT[1]).alias("text"))
    return asked.join(best, ["name", "line"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def assigned_before(asked: DataFrame, assigned: DataFrame, width: int = J.SPAN) -> DataFrame:
    """(order_id, line, seq) of what is assigned (key, line, seq) to a name in the lines lo to hi of asked (order_id, key, lo, hi)."""
    rows = asked.filter("lo <= hi").select("order_id", "key", "lo", "hi").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return rows.join(assigned.withColumn("bucket", F.floor(F.col("line") / width)), ["key", "bucket"]).filter("line BETWEEN lo AND hi").select("order_id", "line", "seq")


def answerable(asked: DataFrame) -> DataFrame:
    """(order_id, fn, name, upto) of the accesses asked (order_id, name, fn, line) that can have writes before them, copies once."""
    return asked.filter("line IS NOT NULL AND fn IS NOT NULL AND name <> ''").select("order_id", "fn", "name", F.col("line").alias("upto")).distinct()


def write_lists(asked: DataFrame, writes: DataFrame, source: DataFrame, width: int = J.WIDTH) -> DataFrame:
    """(fn, name, line, seq, n, part): the writes that count for each function and name asked, by line and seq: n from 1, `part` the stretch of `width` writes.

    writes: (seq, bare, scope, function, line), the scope what follows the variable's `@`. A write counts if its function or its
    scope is fn and its name is the one asked, the name's last member, or what the member belongs to; the latter only if its source line
    (line, text) has the member as a token or behind `.` or `->`. The list is the same for all accesses of a name in a function, each of which takes its beginning.
    """
    tail, dotted = F.substring_index("name", ".", -1), F.contains("name", F.lit("."))
    parent = F.regexp_replace("name", r"\.[^.]*$", "")
    keys = F.array_compact(F.array(F.struct(F.col("name").alias("bare"), F.lit(False).alias("checked")), F.when(dotted, F.struct(tail.alias("bare"), F.lit(False).alias("checked"))), F.when(dotted, F.struct(parent.alias("bare"), F.lit(True).alias("checked")))))
    questions = answerable(asked).select("fn", "name").distinct().select("fn", "name", tail.alias("tail"), F.explode(F.array_distinct(keys)).alias("k")).select("fn", "name", "tail", "k.bare", "k.checked")
    texts = source.groupBy("line").agg(F.min("text").alias("text"))
    dealt = writes.filter("line IS NOT NULL").withColumn("fn", F.explode(F.array_distinct(F.array_compact(F.array("function", F.when(F.col("scope") != "", F.col("scope")))))))
    met = dealt.select("seq", "line", "bare", "fn").join(questions, ["bare", "fn"])
    plain = met.filter("NOT checked").select("fn", "name", "line", "seq")
    lines = met.filter("checked").select("fn", "name", "line", "seq", "tail").join(texts, "line")
    edge = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("tail"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    member = F.contains("text", F.concat(F.lit("."), "tail")) | F.contains("text", F.concat(F.lit("->"), "tail")) | F.regexp_like("text", edge)
    rows = plain.unionByName(lines.filter(member).select("fn", "name", "line", "seq")).distinct()
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("fn", "name").orderBy("line", "seq")).cast("bigint"))
    return rows.withColumn("part", F.floor((F.col("n") - 1) / width))


def beginnings(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """(order_id, line, seq, n): of each access the writes of its list on earlier lines. Accesses meet the parts of a list, so a long one is many keys."""
    starts = lists.groupBy("fn", "name", "part").agg(F.min("line").alias("start"))
    near = answerable(asked).join(starts, ["fn", "name"]).filter("start < upto")
    return near.join(lists, ["fn", "name", "part"]).filter("line < upto").select("order_id", "line", "seq", "n")


def prior_writes(asked: DataFrame, writes: DataFrame, source: DataFrame, width: int = J.WIDTH) -> DataFrame:
    """(order_id, line, seq) of all writes before the accesses asked (order_id, once each; name, fn, line), by the rules of write_lists()."""
    return beginnings(asked, write_lists(asked, writes, source, width)).drop("n")


def counted(sources: list[DataFrame], first: int = 0) -> DataFrame:
    """(order_id, class, line, seq): the writes of several sources (order_id, line, seq), classes from `first`. Of class 0 all count; of others, lines that no earlier source, and no earlier write of their own, has."""
    ranked = [rows.select("order_id", F.lit(i).cast("bigint").alias("class"), "line", "seq") for i, rows in enumerate(sources, first)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    of = Window.partitionBy("order_id", "line").orderBy("class", "seq")
    return rows.withColumn("n", F.row_number().over(of)).filter("class = 0 OR n = 1").drop("n")


def in_order(sources: list[DataFrame]) -> DataFrame:
    """(order_id, class, line, seq, pos): what counts of several sources, one source after the other, each by line and seq. The write that counts as last is that of the greatest pos,
    which may stand on an earlier line than others.
    """
    return counted(sources).withColumn("pos", F.row_number().over(Window.partitionBy("order_id").orderBy("class", "line", "seq")).cast("bigint"))


def writes_in_order(asked: DataFrame, lists: DataFrame, later: list[DataFrame]) -> DataFrame:
    """in_order() of the beginnings of lists (a table) and of later sources, for accesses (order_id, once each).

    The long part, the beginnings, is neither shuffled nor sorted: a write's place in its list is its place for every access. Only what later sources add is numbered, behind as many.
    """
    told = beginnings(asked, lists).select("order_id", F.lit(0).cast("bigint").alias("class"), "line", "seq", F.col("n").alias("pos"))
    known = lists.select("fn", "name", F.col("line").alias("at")).distinct()
    more = counted(later, 1).join(answerable(asked), "order_id", "left").alias("m")
    more = more.join(known.alias("k"), F.expr("m.fn = k.fn AND m.name = k.name AND m.line = k.at AND k.at < m.upto"), "left_anti")
    more = written(more.withColumn("n", F.row_number().over(Window.partitionBy("order_id").orderBy("class", "line", "seq")).cast("bigint")), "later")
    key = F.struct("fn", "name").alias("key")
    before = J.last_before(more.select("order_id", key, "class", F.col("line").alias("at"), "seq", "n", F.col("upto").alias("line")), lists.select(key, "line", "n"), "key", "line", F.col("n"))
    return told.unionByName(before.select("order_id", "class", F.col("at").alias("line"), "seq", (F.col("n") + F.coalesce("found", F.lit(0))).alias("pos")))
