import base64
import gzip
import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from boundwright.llm import warc as w


def brute(rows):
    """rows: (page_id, html); the contract's columns, sorted."""
    groups = defaultdict(list)
    for i, x in rows:
        groups[(x or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        head = max(ids, key=lambda i: (i is not None, i or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(i, len(payload), digest, "response" if i == head else "revisit", None if i == head else head) for i in ids]
    return sorted(out, key=str)


def test_query(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{at}/pages.parquet").collect()]
    assert sorted(map(tuple, w.op1_capture_index(spark, at).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "http://A.b.org/x", "same é"), (2, None, "same é"), (3, "no scheme", None), (4, "http://a.b.org", ""), (4, "http://a.b.org", ""), (-5, "x://q\r\nWARC-Type: y", "z" * 300_000), (None, "x://n", "one"), (None, "x://n", "same é"), (8, "http://a.b.org/x\t1", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = sorted(map(tuple, w.captures(pages).collect()), key=str)
    assert got == brute([(i, x) for i, _, x in rows])
    assert w.captures(pages.limit(0)).collect() == []


def test_keys(spark):
    rows = [("http://WWW.Example.org/A?b#c",), ("x://h",), ("plain",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "url string").select(w.url_key("url")).collect()]
    assert got == ["org,example,www)/A?b#c", "h)", "plain", ""]
    ids = spark.createDataFrame([(x,) for x in (None, -3, -1, 0, 9, 10, 1 << 40)], "i long").select(w.capture_key(F.lit("u"), "i").alias("k"))
    keys = [r.k for r in ids.collect()]
    assert keys == sorted(keys) and len(set(keys)) == 7


def test_lookup_finds_all_lines_of_keys_across_blocks(spark, tmp_path):
    rows = [(f"f{i % 3}", i, 10, f"key{i % 9:03}" if i < 200 else "hot", i) for i in range(500)]
    index = w.index(spark.createDataFrame(rows, w.RECORDS), f"file://{tmp_path}", block=7)
    asked = spark.createDataFrame([("key003",), ("hot",), ("nothing",), ("",), ("zzz",), ("hot",)], "key string")
    got = sorted((r.key, r.file, r.offset, r.page_id) for r in w.lookup(asked, index).collect())
    assert got == sorted((k, f, o, p) for f, o, _, k, p in rows if k in ("key003", "hot"))


def test_archives_are_plain_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://a/", "x")], "page_id long, url string, html string")
    for r in w.write(pages, f"file://{tmp_path}").collect():
        fields, payload = w.parse(gzip.decompress(open(r.file, "rb").read()[r.offset : r.offset + r.length]))
        assert fields["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and payload == (b"x" if r.page_id == 2 else b"")


def test_sql_gives_the_same():
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    rows = con.execute("SELECT page_id, html FROM pages").fetchall()
    assert sorted(con.execute(w.ORACLE_SQL["op1_capture_index"]).fetchall(), key=str) == brute(rows)
