import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

from boundwright.llm import decontaminate as d

DRAW = random.Random(4)
COMMON = ["the", "of", "and", "to", "in"]
RARE = ["".join(DRAW.choice("abcdefghij") for _ in range(3)) for _ in range(160)]


def sentence(n):
    return " ".join(DRAW.choice(COMMON if DRAW.random() < 0.5 else RARE) for _ in range(n))


ITEMS = [(i, sentence(DRAW.randrange(12, 70)) + ". " + sentence(8) + ".") for i in range(40)]


def rows_of(items):
    cut = [(i, k, Counter(part)) for i, text in items for k, part in enumerate(d.in_pieces(d.words(text)))]
    df = Counter(t for *_, c in cut for t in c)
    rows = pd.DataFrame([(i, k, t, n, df[t]) for i, k, c in cut for t, n in c.items()], columns=["place", "piece", "term", "tf", "df"])
    return rows, [SimpleNamespace(place=i, item_id=i, text=text) for i, text in items], len(cut), sum(sum(c.values()) for *_, c in cut) / len(cut)


@pytest.fixture(scope="module")
def index():
    return d.Index(*rows_of(ITEMS))


def all_scores(index, terms):
    total = Counter()
    for t in terms:
        for p, v in zip(index.pieces[t], index.impacts[t], strict=True):
            total[p] += v
    return total


def test_search_finds_every_piece_at_any_threshold(index):
    for _ in range(200):
        terms = DRAW.sample(range(len(index.terms)), DRAW.randrange(1, 60))
        want = all_scores(index, terms)
        for least in (0.1, 0.35, 0.6):
            got = dict(index.search(terms, least))
            assert set(got) == {p for p, v in want.items() if v >= least - 1e-9}
            assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_bounds_leave_every_hit_open(index):
    docs = [sentence(DRAW.randrange(0, 200)) + " " + DRAW.choice(ITEMS)[1] + " " + sentence(DRAW.randrange(0, 90)) for _ in range(30)] + ["", "the"]
    ids = [np.array([index.terms.get(w, len(index.terms)) for w in d.words(x)], dtype=np.int64) for x in docs]
    for x, open_ in zip(ids, index.open_windows(ids), strict=True):
        for k in range(-(-len(x) // d.HALF)):
            terms = [t for t in set(x[k * d.HALF : k * d.HALF + d.PASSAGE].tolist()) if t < len(index.terms)]
            if any(v >= d.THRESHOLD for v in all_scores(index, terms).values()):
                assert k in open_


def test_runs_of_passages_agree(index, monkeypatch):
    docs = [sentence(DRAW.randrange(0, 200)) + " " + DRAW.choice(ITEMS)[1] + " " + sentence(DRAW.randrange(0, 90)) for _ in range(30)] + ["", "the"]
    ids = [np.array([index.terms.get(w, len(index.terms)) for w in d.words(x)], dtype=np.int64) for x in docs]
    whole = [x.tolist() for x in index.open_windows(ids)]
    for most in (1, 40, 1000):
        monkeypatch.setattr(d, "EXPANDED", most)
        assert [x.tolist() for x in index.open_windows(ids)] == whole and any(whole)


def test_memory_of_a_large_benchmark_is_bounded():
    draw = np.random.default_rng(5)
    names = [f"w{i}" for i in range(30_000)]
    spoken = lambda n: " ".join(names[i] for i in np.minimum(draw.zipf(1.15, n) - 1, len(names) - 1).tolist())
    large = d.Index(*rows_of([(i, spoken(45)) for i in range(20_000)]))
    ids = [np.array([large.terms.get(w, len(large.terms)) for w in d.words(spoken(n))], dtype=np.int64) for n in (30_000, 10, 0, 9_000)]
    postings = sum(len(large.pieces[t]) for x in ids for t in x.tolist() if large.rare[t])
    tracemalloc.start()
    large.open_windows(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert postings > 3 * d.EXPANDED and peak < 300 << 20


def test_planted_items_are_found_and_others_left(spark):
    items = spark.createDataFrame([*ITEMS, (900, None), (901, ""), (902, "Was it?\nyes")], "item_id long, text string")
    held = {100 + i: sentence(90) + "\n" + text.upper() + " " + sentence(50) for i, text in ITEMS}
    half = {300 + i: sentence(90) + " " + " ".join(text.split()[: len(text.split()) // 2]) for i, text in ITEMS}
    rows = [*held.items(), *half.items(), (1, None), (2, ""), (3, sentence(20_000)), (100, held[100]), (None, held[101])]
    docs = spark.createDataFrame([(i, x, "e") for i, x in rows], "doc_id long, text string, item_id string")
    got = Counter((r.doc_id, r.item_id) for r in d.leaked(docs, items).collect())
    want = Counter((100 + i, i) for i, _ in ITEMS) + Counter({(100, 0): 1, (None, 1): 1})
    assert got == want
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([*half, 1, 2, 3])
    assert d.leaked(docs, items.limit(0)).collect() == [] and d.clean(docs.limit(0), items).count() == 0


def test_shards_of_the_index_agree(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    parts = list(d.indexes(items, shard=1500))
    assert len(parts) > 2
    texts = [sentence(40) + " " + text for _, text in ITEMS]
    whole = next(d.indexes(items)).leaks(texts)
    split = [sorted(sum(some, [])) for some in zip(*(p.leaks(texts) for p in parts), strict=True)]
    assert [[x[0] for x in sorted(some)] for some in whole] == [[x[0] for x in some] for some in split]
    assert all(abs(a[1] - b[1]) < 1e-9 for x, y in zip(whole, split, strict=True) for a, b in zip(sorted(x), y, strict=True))


def test_query_against_containment(spark):
    at = "/root/testdata/sf0.01"
    plain = lambda x: " " + " ".join(d.words(x)) + " "
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{at}/documents.parquet").collect() for i, t in items if t in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in d.op2_benchmark_leaks(spark, at).collect()} == want and want


def test_query_against_sql(spark):
    at = "/root/testdata/sf0.01"
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}.parquet')")
        want = con.sql(d.ORACLE_SQL["op2_benchmark_leaks"])
        names = want.columns
        want = sorted(want.fetchall())
    assert sorted(map(tuple, d.op2_benchmark_leaks(spark, at).select(names).collect())) == want and want


def test_changed_words(index):
    """The share of items found again with single words replaced."""
    draw = random.Random(8)
    found = {}
    for percent in (0, 5, 10):
        texts = [" ".join("zzz" if draw.random() < percent / 100 else w for w in text.split()) for _, text in ITEMS]
        around = [sentence(60) + " " + x + " " + sentence(60) for x in texts]
        found[percent] = sum(any(leak[0] == i for leak in got) for (i, _), got in zip(ITEMS, index.leaks(around), strict=True)) / len(ITEMS)
    assert found[0] == 1 and found[5] >= 0.9 and found[10] >= 0.6


def test_a_long_item_and_repeats(spark):
    long = " ".join("".join(DRAW.choices("abcdefghij", k=6)) for _ in range(30_000))
    items = spark.createDataFrame([(1, long), (1, long), (2, "one two three four five six seven eight. nine ten.")], "item_id long, text string")
    parts = list(d.indexes(items, shard=1 << 16))
    assert sum(len(x.items) for x in parts) == 2 and sum(len(x.place_of) for x in parts) == -(-30_000 // d.PIECE) + 1
    docs = spark.createDataFrame([(7, long[:100_000] + " " + long[100_000:]), (8, "One two three four five six seven eight. Nine ten.")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.leaked(docs, items).collect()) == [(7, 1), (8, 2)]
    assert [r.item_id for r in d.leaked(docs.selectExpr("doc_id", f"'{long}' AS text").limit(1), items).collect()] == [1]
