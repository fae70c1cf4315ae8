"""The rule of replacement against a fold, and each step of the look-ups on small tables."""

import random

from boundwright.operators import declarations as D

ROWS = "seq long, name string, size long, noted boolean, pointer boolean"


def fold(rows):
    best = {}
    for row in sorted(rows):
        _, name, size, noted, _ = row
        old = best.get(name)
        if old is None:
            best[name] = row
        elif (not old[2] and size is not None and size > 0) or (old[2] is None and size is not None) or (old[3] and not noted and size is not None):
            best[name] = row
    return best


def test_best_is_the_fold(spark):
    rng = random.Random(7)
    rows = [(i, f"n{rng.randrange(400)}", rng.choice([None, 0, 0, 5, 9]), rng.random() < 0.8, False) for i in range(2000)]
    rows += [(5000 + i, "hot", (0, 7)[i % 2], i % 2 == 1, False) for i in range(501)]
    got = {r.name: (r.seq, r.name, r.size, r.noted, r.pointer) for r in D.best(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == fold(rows)


def test_best_with_ties_is_the_fold(spark):
    rng = random.Random(8)
    rows = [(1, "two", 0, False, False), (1, "two", 5, True, False)]
    rows += [(rng.randrange(4), f"n{rng.randrange(300)}", rng.choice([None, 0, 0, 5, 9]), rng.random() < 0.8, rng.random() < 0.5) for _ in range(2000)]
    placed = sorted(rows, key=lambda r: (r[0], -1 if r[2] is None else r[2], *r[3:]))
    got = {r.name: (r.seq, r.name, r.size, r.noted, r.pointer) for r in D.best(spark.createDataFrame(rows, ROWS)).collect()}
    want = fold([(i, *r[1:]) for i, r in enumerate(placed)])
    assert got == {k: (placed[v[0]][0], *v[1:]) for k, v in want.items()}


def test_steps(spark):
    declared = [(1, "a", 4, False, False), (2, "o.m", None, False, True), (3, "T.x", None, True, False), (4, "x", 6, False, False), (5, "p", None, False, True), (6, "v", None, False, False), (7, "deep", 3, False, False), (8, "w", 8, False, False)]
    declarations = spark.createDataFrame(declared, ROWS)
    types = spark.createDataFrame([("s", "T"), ("o", "U"), ("e", "U"), ("w", "U")], "object string, type string")
    fields = spark.createDataFrame([("T", "y", 1, 12, False), ("T", "z", 2, None, False)], "type string, field string, seq long, size long, pointer boolean")
    used = spark.createDataFrame([("e.q.r",), ("e.q.r",), ("o.m",), ("o.n",), ("s.k",)], "name string")
    counted = D.best(D.with_copies(declarations, types, fields))
    inside = D.members(counted, types, fields, used)
    keys = spark.createDataFrame([(k,) for k in ("a", "s.y", "s.x", "s.z", "s", "o.m", "e.q.r", "e", "p", "v", "v.t", "u.deep", "w.t", "nil", "nil.t", "", "*()")], "key string")
    looked = {r.key: (r.kind, r.name, r["size"], list(r.nested)) for r in D.nested(D.looked_up(keys, counted, types), inside).collect()}
    assert looked["s"] == ("object", "s", None, ["T.y", "T.z"])
    assert looked["s.y"] == ("array", "s.y", 12, [])
    assert looked["s.x"] == ("other", "T.x", None, [])
    assert looked["e"][3] == ["e.q.r"]
    assert looked["nil"] == (None, None, None, [])
    got = {r.key: (r.via, r.name, r.kind, r["size"]) for r in D.indexed_objects(keys, declarations, counted, types, inside).collect()}
    assert got == {
        "": ("deref", "", "unknown", None), "*()": ("deref", "*()", "unknown", None), "a": ("own", "a", "array", 4), "s.y": ("own", "s.y", "array", 12), "s.z": ("member", "T.z", "field", None),
        "s.x": ("tail", "s.x", "array", 6), "s": ("found", "s", "struct", None), "o.m": ("member", "o.m", "field", None), "e.q.r": ("member", "e.q.r", "field", None), "e": ("found", "e", "struct", None),
        "p": ("found", "p", "pointer", None), "v": ("found", "v", "variable", None), "v.t": ("root", "v.t", "unknown", None), "u.deep": ("own", "u.deep", "array", 3), "w.t": ("root", "w.t", "unknown", 8), "nil": ("none", "nil", "unknown", None), "nil.t": ("none", "nil.t", "unknown", None),
    }
