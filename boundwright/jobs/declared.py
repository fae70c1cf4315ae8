"""Queries over declarations: which one counts, what names stand for, what is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwright.jobs.catalogue import query
from boundwright.operators import declarations as D
from boundwright.sources.projections import view
from boundwright.sources.shared import written

#: The rule of replacement as a fold over each name's declarations in order.
COUNTED = f"""_all AS (SELECT seq, name, size, noted, pointer FROM declarations UNION ALL
      SELECT f.seq + {D.COPIES}, concat(o.object, '.', f.field), f.size, true, f.pointer FROM object_types o JOIN type_fields f ON o.type = f.type),
    _folded AS (SELECT name, min(seq) AS first_seq, list_reduce(list(struct_pack(q := seq, s := size, n := noted, p := pointer) ORDER BY seq),
      lambda e, w: CASE WHEN ((e.s IS NULL OR e.s = 0) AND w.s > 0) OR (e.s IS NULL AND w.s IS NOT NULL) OR (e.n AND NOT w.n AND w.s IS NOT NULL) THEN w ELSE e END) AS d FROM _all GROUP BY name),
    _best AS (SELECT name, first_seq, d.q AS seq, d.s AS size, d.n AS noted, d.p AS pointer FROM _folded)"""
INSIDE = f"""{COUNTED}, _dotted AS (SELECT o.object, substr(b.name, strpos(b.name, '.') + 1) AS member, b.* FROM _best b JOIN object_types o ON starts_with(b.name, concat(o.object, '.')) AND o.object = split_part(b.name, '.', 1)),
    _sized AS (SELECT DISTINCT ON (object, tail) * FROM (
        SELECT o.object, f.field AS tail, 0 AS rank, f.seq AS pos, concat(f.type, '.', f.field) AS name, f.size, f.pointer FROM object_types o JOIN type_fields f ON o.type = f.type
        UNION ALL SELECT object, split_part(name, '.', -1), 1, first_seq, name, size, pointer FROM _dotted WHERE size IS NOT NULL) ORDER BY object, tail, rank, pos, name),
    _bare AS (SELECT DISTINCT ON (object, member) * FROM (
        SELECT object, member, split_part(name, '.', -1) AS tail, 2 AS rank, first_seq AS pos, name, size, pointer FROM _dotted WHERE size IS NULL
        UNION ALL SELECT o.object, substr(u.name, strpos(u.name, '.') + 1), split_part(u.name, '.', -1), 3, 0, u.name, NULL, false FROM (SELECT DISTINCT name FROM object_uses) u JOIN object_types o ON o.object = split_part(u.name, '.', 1) WHERE contains(u.name, '.'))
      WHERE object NOT IN (SELECT object FROM _sized) ORDER BY object, member, rank, pos, name),
    _inside AS (SELECT object, tail, rank, pos, name, size, pointer FROM _sized UNION ALL SELECT object, tail, rank, pos, name, size, pointer FROM _bare)"""


def found_sql(keys: str) -> str:
    """The look-up of the names of `keys` by three joins."""
    return f"""_found AS (SELECT k.key, own.type IS NOT NULL AS is_object, CASE WHEN a.name IS NOT NULL THEN a WHEN b.name IS NOT NULL THEN b ELSE c END AS d
      FROM (SELECT DISTINCT key FROM {keys}) k LEFT JOIN object_types own ON own.object = k.key LEFT JOIN object_types o ON o.object = split_part(k.key, '.', 1)
      LEFT JOIN _best a ON a.name = k.key LEFT JOIN _best b ON contains(k.key, '.') AND b.name = concat(o.type, '.', substr(k.key, strpos(k.key, '.') + 1))
      LEFT JOIN _best c ON contains(k.key, '.') AND c.name = substr(k.key, strpos(k.key, '.') + 1)),
    _answer AS (SELECT key, CASE WHEN d.size IS NOT NULL THEN 'array' WHEN is_object THEN 'object' WHEN d.name IS NOT NULL THEN 'other' END AS kind,
      CASE WHEN d.size IS NULL AND is_object THEN key ELSE d.name END AS name, d.size AS size, CASE WHEN d.size IS NULL AND is_object THEN false ELSE d.pointer END AS pointer FROM _found)"""


TABLES = ("declarations", "object_types", "type_fields")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """declarations, what counts of them and of copied fields, types, fields."""
    declarations, types, fields = (view(spark, sf_dir, name) for name in TABLES)
    return declarations, written(D.best(D.with_copies(declarations, types, fields)), "declared"), types, fields


@query(f"{COUNTED} SELECT name, first_seq, seq, size, noted, pointer FROM _best", *TABLES)
def best_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declaration that counts of each name, copied fields of typed objects included."""
    return tables(spark, sf_dir)[1]


@query(
    f"""{INSIDE}, {found_sql("asked_objects")}, _lists AS (SELECT object, string_agg(name, ',' ORDER BY rank, pos, name) AS names FROM _inside GROUP BY object)
    SELECT q.order_id, q.key, a.kind, a.name, a.size, a.pointer, CASE WHEN a.kind = 'object' THEN coalesce(l.names, '') ELSE '' END AS nested
    FROM asked_objects q JOIN _answer a ON a.key = q.key LEFT JOIN _lists l ON l.object = q.key""",
    *TABLES,
    "object_uses",
    "asked_objects",
)
def declaration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each asked name is declared as, with the members of an object."""
    _, counted, types, fields = tables(spark, sf_dir)
    asked = view(spark, sf_dir, "asked_objects")
    inside = D.members(counted, types, fields, view(spark, sf_dir, "object_uses"))
    answers = D.nested(D.looked_up(asked, counted, types), inside)
    return asked.join(answers, "key").withColumn("nested", F.array_join("nested", ","))


@query(
    f"""{INSIDE}, _k AS (SELECT DISTINCT key, split_part(key, '.', 1) AS root, CASE WHEN contains(key, '.') THEN split_part(key, '.', -1) END AS tail FROM asked_objects),
    _names AS (SELECT key FROM _k UNION SELECT root FROM _k UNION SELECT tail FROM _k WHERE tail IS NOT NULL), {found_sql("_names")},
    _m AS (SELECT DISTINCT ON (object, tail) * FROM _inside ORDER BY object, tail, rank, pos, name), _any AS (SELECT name, arg_min(size, seq) AS size FROM declarations WHERE size IS NOT NULL GROUP BY name),
    _met AS (SELECT k.*, a AS own, r AS up, t AS last, m, y.size AS any_size FROM _k k LEFT JOIN _answer a ON a.key = k.key LEFT JOIN _answer r ON r.key = k.root LEFT JOIN _answer t ON t.key = k.tail
      LEFT JOIN _m m ON m.object = k.root AND m.tail = k.tail LEFT JOIN _any y ON y.name = k.tail),
    _via AS (SELECT *, CASE WHEN key IN ('', '*()') THEN 'deref' WHEN own.size IS NOT NULL THEN 'own' WHEN tail IS NOT NULL AND up.kind = 'object' AND m.name IS NOT NULL THEN 'member' WHEN tail IS NOT NULL AND last.size IS NOT NULL THEN 'tail'
      WHEN tail IS NOT NULL AND any_size IS NOT NULL THEN 'any' WHEN own.kind IS NOT NULL THEN 'found' WHEN tail IS NOT NULL AND up.kind IS NOT NULL THEN 'root' ELSE 'none' END AS via FROM _met)
    SELECT q.order_id, v.key, v.via, CASE WHEN via = 'member' THEN m.name ELSE v.key END AS name, CASE via WHEN 'deref' THEN 'unknown' WHEN 'own' THEN 'array' WHEN 'member' THEN CASE WHEN m.size IS NULL THEN 'field' ELSE 'array' END
      WHEN 'tail' THEN 'array' WHEN 'any' THEN 'array' WHEN 'found' THEN CASE WHEN own.kind = 'object' THEN 'struct' WHEN own.pointer THEN 'pointer' ELSE 'variable' END
      WHEN 'root' THEN CASE WHEN up.pointer THEN 'pointer' WHEN up.kind = 'object' THEN 'struct' ELSE 'unknown' END ELSE 'unknown' END AS kind,
      CASE via WHEN 'own' THEN own.size WHEN 'member' THEN m.size WHEN 'tail' THEN last.size WHEN 'any' THEN any_size WHEN 'root' THEN up.size END AS size
    FROM asked_objects q JOIN _via v ON v.key = q.key""",
    *TABLES,
    "object_uses",
    "asked_objects",
)
def indexed_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object that each asked name indexes, and by which step of the cascade it was found."""
    declarations, counted, types, fields = tables(spark, sf_dir)
    asked = view(spark, sf_dir, "asked_objects")
    inside = D.members(counted, types, fields, view(spark, sf_dir, "object_uses"))
    return asked.join(D.indexed_objects(asked, declarations, counted, types, inside), "key")
