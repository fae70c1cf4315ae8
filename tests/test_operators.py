from pyspark.sql import functions as F

from boundwright.functions import text as T
from boundwright.operators import evaluation as E
from boundwright.operators import graph as G
from boundwright.operators import joins as J
from boundwright.sources.exports import alarms, semicolon_csv
from boundwright.sources.projections import view


def test_locations_and_literals(spark):
    rows = [("C:a.c:12.3-9",), ("a.c:12.3",), ("a.c:12.3-14.5",), ("nothing",), (None,)]
    where = T.location(F.col("x"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(*(where[k] for k in ("file", "line", "col_start", "end_line", "col_end"))).collect()]
    assert got == [("C:a.c", 12, 3, 12, 9), ("a.c", 12, 3, 12, 3), ("a.c", 12, 3, 14, 5), (None,) * 5, (None,) * 5]
    texts = [("0x1Fu", 31), ("12UL", 12), ("-3", None), ("010", 10), ("", None), ("1,112", None)]
    assert [r[0] for r in spark.createDataFrame(texts, "x string, y long").select(T.int_literal(F.col("x"))).collect()] == [y for _, y in texts]
    assert [r[0] for r in spark.createDataFrame([("1,112",), (" 7 ",), ("x",)], "x string").select(T.order_id(F.col("x"))).collect()] == [1112, 7, None]


def test_enclosing_takes_the_innermost_and_keeps_points_without(spark):
    spans = spark.createDataFrame([(1, "outer", 1, 10_000), (2, "inner", 40, 60), (3, "twin", 40, 60)], "fn_id long, name string, start_line long, end_line long")
    points = spark.createDataFrame([(0, 50), (1, 39), (2, 10_001), (3, None), (4, 50)], "id long, line long")
    for width in (7, 4096):
        assert {r.id: r.name for r in J.enclosing(points, spans, width=width).collect()} == {0: "twin", 1: "outer", 2: None, 3: None, 4: "twin"}


def test_last_before_at_any_bucket_width(spark):
    left = spark.createDataFrame([(i % 3, i * 5 % 97) for i in range(200)], "k long, line long")
    right = spark.createDataFrame([(i % 3, i * 7 % 101, i) for i in range(60)], "k long, line long, v long")
    rights = [tuple(r) for r in right.collect()]
    for width in (3, 50, 4096):
        for r in J.last_before(left, right, "k", "line", F.col("v"), width).collect():
            want = max(((line, v) for k, line, v in rights if k == r.k and line < r.line), default=(None, None))[1]
            assert r.found == want


def test_nearest_and_rows_without_a_line(spark):
    left = spark.createDataFrame([(i % 3, i * 5 % 97 if i % 10 else None) for i in range(100)] + [(None, 5), (7, 5)], "k long, line long")
    right = spark.createDataFrame([(i % 3, i * 7 % 101 if i % 9 else None) for i in range(40)] + [(None, 4)], "k long, line long")
    rights = [tuple(r) for r in right.collect()]
    for width in (3, 4096):
        rows = J.nearest(left, right, "k", "line", width).collect()
        assert sorted(map(str, ((r.k, r.line) for r in rows))) == sorted(map(str, map(tuple, left.collect())))
        for r in rows:
            near = [(abs(line - r.line), line) for k, line in rights if None not in (k, line, r.line) and k == r.k]
            assert r.found == min(near, default=(None, None))[1]
    # Before, a right row without a line was carried to every later bucket.
    found = J.last_before(spark.createDataFrame([(1, 9)], "k long, line long"), spark.createDataFrame([(1, None)], "k long, line long"), "k", "line", F.lit(1))
    assert found.first().found is None
    # Before, each table was shuffled several times.
    plan = J.nearest(left, right, "k", "line")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2


def test_components_of_a_long_chain(spark):
    pairs = spark.range(40).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("src"), F.concat(F.lit("n"), F.lpad((F.col("id") + 1).cast("string"), 3, "0")).alias("dst"))
    assert {r.component for r in G.components(pairs.union(spark.createDataFrame([("z1", "z2")], "src string, dst string"))).collect()} == {"n000", "z1"}


def test_samples(spark):
    rows = spark.createDataFrame([(i, "true" if i % 50 == 0 else "false") for i in range(300)], "order_id long, human string")
    got = E.sampled(rows, 40, 1).collect()
    assert len(got) == 40 and sum(r.human == "true" for r in got) == 6
    assert E.sampled(rows, 3, 1).count() == 6


def test_export_reader(spark, tmp_path):
    path = tmp_path / "alarms.csv"
    path.write_text('sep=;\nOrder;Type;Location\n1,112;a;"f.c:3.4-9"\n;;\nbad;b;f.c:1.1\n')
    got = alarms(semicolon_csv(spark, f"file://{path}", ["Order", "Type", "Location"])).collect()
    assert [(r.order_id, r.line, r.col_end) for r in got] == [(1112, 3, 9)]


def test_call_edges_take_every_row(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert view(spark, sf_dir, "control_flow").count() == lines.count() > lines.filter("l_linenumber <= 2").count()
