"""Declarations by name: which of several counts, what a name stands for, and which object an index goes into.

declarations: seq (their order), name, size, noted (a note of the reader stands beside it), pointer. types: object, type.
fields: type, field, seq, size, pointer. A look-up takes several names in turn; they are exploded once with their ranks, meet the
declarations in one join, and the least rank is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.sources.shared import written

#: The seq of copied fields starts here, behind all declarations.
COPIES = 1 << 50
RECORD = ["seq", "size", "noted", "pointer"]


def best(declarations: DataFrame) -> DataFrame:
    """One row a name: seq, size, noted, pointer of the declaration that counts, and first_seq.

    A later one replaces the one at hand if that has no size or 0 and it has more, if that has none and it has one, or if
    that is noted and it, with a size, is not. So the first with a size above 0 and without a note stays for good. Where a name has none of these,
    those above 0 (noted) and those of 0 without a note replace each other whenever they alternate: what stays is
    the first after the last of the other kind. Where neither is there, it is the first noted 0, else the first. All of this are sums
    for each name, which combine before they are shuffled, and no list of a name's declarations is made.
    Declarations with one seq follow each other by size (none first), note and pointer, so that the order is total and none is lost.
    """
    size, noted = F.col("size"), F.col("noted")
    kind = F.when((size > 0) & ~noted, 0).when(size > 0, 1).when(size.isNotNull() & ~noted, 2).when(size.isNotNull(), 3).otherwise(4)
    rows = declarations.select("name", *RECORD, F.struct(*RECORD).alias("place"), kind.alias("kind"))
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("place")))
    behind = lambda k: F.col(f"last_{k}").isNull() | (F.col("place") > F.col(f"last_{k}"))
    ends = rows.groupBy("name").agg(last(1).alias("last_1"), last(2).alias("last_2"), F.min("seq").alias("first_seq"))
    met = rows.join(ends, "name")
    # The run that the last of both kinds belongs to; kinds 0, 3 and 4 have their first.
    after = F.when(F.col("kind") == 1, behind(2)).when(F.col("kind") == 2, behind(1)).otherwise(True)
    rank = F.when(F.col("kind") == 0, 0).when(F.col("kind").isin(1, 2), 1).when(F.col("kind") == 3, 2).otherwise(3)
    top = met.filter(after).groupBy("name", "first_seq").agg(F.min(F.struct(rank.alias("rank"), *RECORD)).alias("d"))
    return top.select("name", "first_seq", *(F.col(f"d.{c}") for c in RECORD))


def with_copies(declarations: DataFrame, types: DataFrame, fields: DataFrame) -> DataFrame:
    """The declarations and, behind them, the fields of each object's type as `object.field`, noted. One with a size above 0 keeps its place by the rule of best()."""
    copied = types.join(fields, "type").select((F.col("seq") + COPIES).alias("seq"), F.concat_ws(".", "object", "field").alias("name"), "size", F.lit(True).alias("noted"), "pointer")
    return declarations.select("seq", "name", "size", "noted", "pointer").unionByName(copied)


def before_dot(c: str) -> Column:
    return F.substring_index(c, ".", 1)


def after_dot(c: str) -> Column:
    """What follows the first dot; null without one."""
    return F.when(F.contains(F.col(c), F.lit(".")), F.expr(f"substring({c}, instr({c}, '.') + 1)"))


def members(counted: DataFrame, types: DataFrame, fields: DataFrame, used: DataFrame) -> DataFrame:
    """object, tail, rank, at, name, size, pointer of what can be indexed in each typed object.

    Its type's fields (rank 0) and its own sized members (1), one for each last part of a name; where an object has neither,
    its members without a size (2), then those that are only used (3; used: name), one for each path. `at` orders equal ranks.
    """
    shape = ["object", "member", "tail", "rank", "at", "name", "size", "pointer"]
    tail = F.substring_index("name", ".", -1).alias("tail")
    of_type = types.join(fields, "type").select("object", F.col("field").alias("member"), F.col("field").alias("tail"), F.lit(0).alias("rank"), F.col("seq").alias("at"), F.concat_ws(".", "type", "field").alias("name"), "size", "pointer")
    typed = types.select("object").distinct()
    dotted = counted.withColumns({"object": before_dot("name"), "member": after_dot("name")}).filter("member <> ''").join(typed, "object", "left_semi")
    own = dotted.select("object", "member", tail, F.when(F.col("size").isNotNull(), 1).otherwise(2).alias("rank"), F.col("first_seq").alias("at"), "name", "size", "pointer")
    flows = used.select("name").distinct().withColumns({"object": before_dot("name"), "member": after_dot("name")}).filter("member <> ''").join(typed, "object", "left_semi")
    flows = flows.select("object", "member", tail, F.lit(3).alias("rank"), F.lit(0).cast("long").alias("at"), "name", F.lit(None).cast("long").alias("size"), F.lit(False).alias("pointer"))
    first = lambda rows, key: rows.groupBy("object", key).agg(F.min(F.struct("rank", "at", "name", *(c for c in shape if c not in ("object", key, "rank", "at", "name")))).alias("m")).select("object", key, "m.*").select(*shape)
    sized = written(first(of_type.unionByName(own.filter("rank = 1")), "tail"), "sized")
    bare = own.filter("rank = 2").unionByName(flows).join(sized.select("object").distinct(), "object", "left_anti")
    return sized.unionByName(first(bare, "member")).drop("member")


def looked_up(keys: DataFrame, counted: DataFrame, types: DataFrame) -> DataFrame:
    """key, kind (array, object, other or null where nothing is found), name, size, pointer of each distinct key.

    A key is declared as it stands, else as `type.field` of its object's type, else as its field alone.
    """
    asked = keys.select("key").distinct().withColumns({"object": before_dot("key"), "field": after_dot("key")})
    asked = written(asked.join(types, "object", "left").join(types.toDF("key", "own_type"), "key", "left"), "keys")
    tried = enumerate((F.col("key"), F.concat(F.col("type"), F.lit("."), F.col("field")), F.col("field")))
    names = F.array(*(F.struct(F.lit(rank).alias("rank"), name.alias("name")) for rank, name in tried))
    each = asked.select("key", F.explode(F.filter(names, lambda n: n["name"].isNotNull())).alias("n")).select("key", "n.*")
    found = each.join(counted, "name").groupBy("key").agg(F.min(F.struct("rank", "name", "size", "pointer")).alias("d"))
    met = asked.join(found, "key", "left")
    kind = F.when(F.col("d.size").isNotNull(), "array").when(F.col("own_type").isNotNull(), "object").when(F.col("d").isNotNull(), "other")
    object_only = kind == "object"
    return met.select(
        "key", kind.alias("kind"), F.when(object_only, F.col("key")).otherwise(F.col("d.name")).alias("name"), F.when(~object_only, F.col("d.size")).alias("size"), F.when(object_only, False).otherwise(F.col("d.pointer")).alias("pointer")
    )


def nested(rows: DataFrame, inside: DataFrame) -> DataFrame:
    """rows (key, kind) with `nested`: the names of an object's members, in order; none for other kinds."""
    lists = inside.groupBy("object").agg(F.array_sort(F.collect_list(F.struct("rank", "at", "name"))).alias("m")).select(F.col("object").alias("key"), F.col("m.name").alias("nested"))
    out = rows.join(lists, "key", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("nested", F.when(F.col("kind") == "object", F.coalesce("nested", none)).otherwise(none))


def indexed_objects(keys: DataFrame, declarations: DataFrame, counted: DataFrame, types: DataFrame, inside: DataFrame) -> DataFrame:
    """key, via, name, kind, size of the object that each distinct key indexes, the first that there is of:

    deref (the key is empty or `*()`), own (sized itself), member (that of its root with its last part), tail (the last part alone, sized),
    any (any sized declaration of the last part), found (declared without a size), root (only its root is known), none.
    """
    asked = keys.select("key").distinct().withColumns({"root": before_dot("key"), "tail": F.when(F.contains("key", F.lit(".")), F.substring_index("key", ".", -1))})
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("asked")) for r in ("key", "root", "tail")))
    each = written(asked.select("key", F.explode(F.filter(roles, lambda r: r["asked"].isNotNull())).alias("r")).select("key", "r.*"), "each")
    answers = looked_up(each.select(F.col("asked").alias("key")), counted, types).withColumnRenamed("key", "asked")
    answer = F.struct("kind", "name", "size", "pointer")
    met = each.join(answers, "asked").groupBy("key").agg(*(F.max(F.when((F.col("role") == r) & F.col("kind").isNotNull(), answer)).alias(f"at_{r}") for r in ("key", "root", "tail")))
    one = inside.groupBy("object", "tail").agg(F.min(F.struct("rank", "at", "name", "size", "pointer")).alias("member"))
    any_size = declarations.filter("size IS NOT NULL").groupBy("name").agg(F.min_by("size", "seq").alias("any_size")).withColumnRenamed("name", "tail")
    rows = asked.join(met, "key", "left").join(one.withColumnRenamed("object", "root"), ["root", "tail"], "left").join(any_size, "tail", "left")
    dotted = F.col("tail").isNotNull()
    has_member = dotted & (F.col("at_root.kind") == "object") & F.col("member").isNotNull()
    via = (
        F.when(F.col("key").isin("", "*()"), "deref").when(F.col("at_key.size").isNotNull(), "own").when(has_member, "member").when(dotted & F.col("at_tail.size").isNotNull(), "tail")
        .when(dotted & F.col("any_size").isNotNull(), "any").when(F.col("at_key").isNotNull(), "found").when(dotted & F.col("at_root").isNotNull(), "root").otherwise("none")
    )
    rows = rows.withColumn("via", via)
    of = lambda **ways: F.coalesce(*(F.when(F.col("via") == k, v) for k, v in ways.items()))
    kind = of(
        deref=F.lit("unknown"), own=F.lit("array"), member=F.when(F.col("member.size").isNotNull(), "array").otherwise("field"), tail=F.lit("array"), any=F.lit("array"),
        found=F.when(F.col("at_key.kind") == "object", "struct").when(F.col("at_key.pointer"), "pointer").otherwise("variable"),
        root=F.when(F.col("at_root.pointer"), "pointer").when(F.col("at_root.kind") == "object", "struct").otherwise("unknown"), none=F.lit("unknown"),
    )
    size = of(own=F.col("at_key.size"), member=F.col("member.size"), tail=F.col("at_tail.size"), any=F.col("any_size"), root=F.col("at_root.size"))
    return rows.select("key", "via", F.coalesce(of(member=F.col("member.name")), F.col("key")).alias("name"), kind.alias("kind"), size.alias("size"))
