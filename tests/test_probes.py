"""Line probes and the order of writes against loops over all rows."""

import random
import re
import time

from pyspark.sql import functions as F

from boundwright.functions import c_text as C
from boundwright.operators import probes as P


def test_arguments(spark):
    texts = {"f(a, b[i, j], g(x, (y)), {1, 2})": ["a", "b[i, j]", "g(x, (y))", "{1, 2}"], "f()": [], "f( )": [], "f(a": ["a"], "f(a,": ["a", ""], 'f("a,)\\"(", \',\', b); g(1, 2)': ['"a,)\\"("', "','", "b"], "f": [], "": [], "f(a)(b, c)": ["a"]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.a for r in rows.select("t", C.arguments(rows.t, F.instr("t", "(")).alias("a")).collect() if "(" in r.t}
    assert got == {t: a for t, a in texts.items() if "(" in t}


def test_patterns_cut_arguments_as_the_fold_does(spark):
    rng = random.Random(8)
    texts = ["(" + "".join(rng.choice("(((()))))[]{},,ab \"'\\") for _ in range(rng.randrange(24))) for _ in range(1500)] + ["(" * d + "a,b" + ")" * d + "; c" for d in range(1, 9)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(C.arguments(F.col("t"), F.lit(1)).alias("a"), C.folded_arguments(F.col("t")).alias("b")).collect()
    assert all(r.a == ([] if r.b == [""] else r.b) for r in rows) and sum(len(r.a) > 1 for r in rows) > 50
    # Before, every letter of a call was folded, a dozen times over, with the cuts copied at each: this one took minutes.
    long = spark.createDataFrame([("f(" + 'g(a, "x,"), ' * 20000 + "b); h(1, 2)",)], "t string")
    began = time.time()
    assert long.select(F.size(C.arguments(F.col("t"), F.lit(2)))).first()[0] == 20001
    assert time.time() - began < 20


def one_call(callee, at, index, calls):
    for line in range(max(1, at - 2), at + 11):
        for _, _, target, args, _ in sorted(c for c in calls if c[0] == line):
            name = target.replace("->", ".").split(".")[-1]
            if (name == callee or callee in target or not name or "[" in target) and index < len(args):
                return args[index], line
    return next(((args[index], at) for line, _, _, args, _ in sorted(calls) if line == at and index < len(args)), None)


def test_call_arguments(spark):
    rng = random.Random(5)
    calls = [(rng.randrange(0, 300), i, rng.choice(["f", "s->f", "g", "tab[f]", "t[2]", "", "ff", "h"]), [f"a{i}_{k}" for k in range(rng.randrange(4))], f"c{i}") for i in range(220)]
    asked = [(i, rng.choice(["f", "g", "h", "zz", ""]), rng.choice([None, *range(1, 300)]), rng.choice([0, 1, 2, -1])) for i in range(300)]
    asked += asked[:5]
    found = P.call_arguments(spark.createDataFrame(asked, "order_id long, callee string, call_line long, arg_index long"), spark.createDataFrame(calls, "line long, seq long, target string, args array<string>, call_text string"))
    got = sorted((r.order_id, r.expression, r["at"]) for r in found.collect())
    want = [(i, *((one_call(c, at, n, calls) if c and n >= 0 and at else None) or (None, None))) for i, c, at, n in asked]
    assert got == sorted(want) or sorted(map(str, got)) == sorted(map(str, want))
    assert sum(e is not None for _, e, _ in got) > 100


def test_assignment_texts(spark):
    rng = random.Random(6)
    source = [(i, rng.choice([" a = 1; ", "a++;", "b--;", "if (a)", "", "x = b" + "z" * 400])) for i in range(1, 120) if i != 60]
    texts = dict(source)
    asked = [(rng.choice("abc"), rng.randrange(-3, 125)) for _ in range(300)]

    def one(name, line):
        if line not in texts:
            return ""
        for d in (0, -1, 1, -2, 2):
            t = texts.get(line + d, "").strip()
            if name in t and ("=" in t or name + "++" in t or name + "--" in t):
                return t[:300]
        return texts[line].strip()[:300]

    got = P.assignment_texts(spark.createDataFrame(asked, "name string, line long"), spark.createDataFrame(source, "line long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((n, i, one(n, i)) for n, i in asked)


def test_prior_writes_and_their_order(spark):
    rng = random.Random(7)
    names = ["a", "a.b", "b", "a.b.c", "c", "d"]
    writes = [(i, rng.choice(names), rng.choice(["", "f", "g"]), rng.choice(["f", "g", "h"]), rng.choice([None, *range(1, 90)])) for i in range(300)]
    source = [(i, rng.choice(["a.b = 1", "p->c++", "bb = cc", "c", "x"])) for i in range(1, 90) if i % 10]
    texts = dict(source)
    asked = [(i, rng.choice([*names, "", None]), rng.choice(["f", "g", "h", None]), rng.choice([None, *range(1, 100)])) for i in range(150)]

    def one(name, fn, upto):
        tail, parent = name.split(".")[-1], name.rsplit(".", 1)[0] if "." in name else None
        for seq, bare, scope, function, line in writes:
            if line is None or line >= upto or fn not in (function, scope):
                continue
            t = texts.get(line, "")
            if bare in (name, tail) or bare == parent and (f".{tail}" in t or f"->{tail}" in t or re.search(rf"(?<!\w){tail}(?!\w)", t)):
                yield line, seq

    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((asked, "order_id long, name string, fn string, line long"), (writes, "seq long, bare string, scope string, function string, line long"), (source, "line long, text string"))]
    want = sorted((i, line, seq) for i, name, fn, upto in asked if name and fn and upto for line, seq in one(name, fn, upto))
    for width in (8, 4096):
        got = P.prior_writes(*frames, width=width)
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 500

    one_, two, three = ([(rng.randrange(5), rng.randrange(20), 100 * k + i) for i in range(40)] for k in range(3))
    expected = []
    for order in range(5):
        rows = [(0, line, seq) for line, seq in sorted((b, c) for a, b, c in one_ if a == order)]
        seen = {line for _, line, _ in rows}
        for k, more in ((1, two), (2, three)):
            for line, seq in sorted((b, c) for a, b, c in more if a == order):
                if line not in seen:
                    seen.add(line)
                    rows.append((k, line, seq))
        expected += [(order, *row, i + 1) for i, row in enumerate(rows)]
    sources = [spark.createDataFrame(rows, "order_id long, line long, seq long") for rows in (one_, two, three)]
    assert sorted(map(tuple, P.in_order(sources).select("order_id", "class", "line", "seq", "pos").collect())) == sorted(expected)

    # The beginnings of lists and later sources give the order of in_order() without sorting each access's writes; before, nothing did.
    frames[0] = frames[0].dropDuplicates(["order_id"])
    later = [spark.createDataFrame([(rng.randrange(150), rng.randrange(1, 95), 1000 * k + i) for i in range(400)], "order_id long, line long, seq long") for k in (1, 2)]
    whole = P.in_order([P.prior_writes(*frames), *later])
    for width in (3, 4096):
        short = P.writes_in_order(frames[0], P.write_lists(*frames, width=width), later)
        assert sorted(map(tuple, short.collect())) == sorted(map(tuple, whole.select(*short.columns).collect()))
