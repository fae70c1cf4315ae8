import random
import re

import xxhash
from pyspark.sql import functions as F

from boundwright.llm import simhash as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """From id to component, prints: list of (id, fingerprint)."""
    of = {}
    for i, fp in prints:
        of.setdefault(fp, []).append(i)
    left = set(of)
    label = {}
    while left:
        todo = [left.pop()]
        group = []
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in left if (x ^ y).bit_count() <= 2]
            left.difference_update(near)
            todo += near
        least = min(i for x in group for i in of[x])
        label |= dict.fromkeys(group, least)
    return {i: label[fp] for i, fp in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_and_components_against_brute_force(spark):
    draw = random.Random(9)
    seeds = [draw.getrandbits(64) for _ in range(40)]
    prints = [0, 1, 3, 7, (1 << 64) - 1, 1 << 63]
    for x in seeds:
        for _ in range(12):
            for b in draw.sample(range(64), draw.randrange(5)):
                x ^= 1 << b
            prints.append(x)
    near = sorted({(min(a, b), max(a, b)) for a in map(signed, prints) for b in map(signed, prints) if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2})
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    assert sorted(map(tuple, s.links(frame).collect())) == near
    rows = list(enumerate(prints)) + [(1000 + i, x) for i, x in enumerate(prints[:9])]
    want = brute_components(rows)
    found = spark.createDataFrame([(i, signed(x)) for i, x in rows], "id long, fp long")
    got = found.join(s.components(found), "fp").collect()
    assert {r.id: r.component for r in got} == want


def test_no_signature_is_broadcast(spark):
    """However few bytes Spark takes the rows made of fingerprints for."""
    draw = random.Random(10)
    frame = spark.createDataFrame([(draw.getrandbits(63),) for _ in range(2000)], "fp long")
    assert "Broadcast" not in s.links(frame)._jdf.queryExecution().executedPlan().toString()


def test_no_candidates_are_broadcast(spark, monkeypatch):
    plans, keep = {}, s.written
    monkeypatch.setattr(s, "written", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or keep(df, label))
    docs = spark.createDataFrame([(i, f"a b c d e {i // 2}") for i in range(40)], "doc_id long, text string")
    assert s.survivors(docs).count() == 20
    assert "LeftSemi" in plans["sets"] and "LeftSemi, BuildRight" not in plans["sets"]


def test_a_long_path(spark):
    pairs = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in s.connected(pairs).collect()} == {(i, 0) for i in range(1, 61)}
    assert s.connected(pairs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_components(docs)
    got = s.op3_deletion_variants(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", want[i]) for i, x in docs}


def test_survivors_and_odd_rows(spark):
    long = "lorem ipsum dolor " * 20_000
    rows = [(5, "a b c d", "x"), (3, "A b c d", "y"), (3, "A b c d", "y"), (7, None, "x"), (6, "", "x"), (None, " ", "x"), (None, "only null ids", "x"), (None, "only null ids", "x"), (9, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = sorted((str(r.doc_id), (r.text or "")[:4]) for r in s.survivors(docs).collect())
    assert kept == [("3", "A b "), ("6", ""), ("9", "lore"), ("None", "only")]
    assert s.survivors(docs).columns == docs.columns and s.survivors(docs.limit(0)).count() == 0


def near_copies(seed, alone, groups, size, changes):
    """Texts by id: some alone, then groups of a text and copies of it with some words changed."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    texts = [[word() for _ in range(150)] for _ in range(alone)]
    for _ in range(groups):
        first = [word() for _ in range(150)]
        texts.append(first)
        for _ in range(size - 1):
            copy = list(first)
            for _ in range(draw.randrange(changes + 1)):
                copy[draw.randrange(150)] = word()
            texts.append(copy)
    return [" ".join(x) for x in texts]


def jaccard_components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split() for x in texts)]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(k) for k in range(len(texts))}


def test_survivors_against_brute_force_jaccard(spark):
    texts = near_copies(4, 30, 30, 4, 6) + near_copies(5, 0, 1, 60, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = jaccard_components(texts)
    assert {r.doc_id for r in s.survivors(docs).collect()} == want
    assert len(want) < len(texts) - 80


def test_large_groups_lose_no_link(spark):
    """A passage in many texts, and copies that drift from one another: groups larger than PAIRED, with links that no centre gives."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    passage = [word() for _ in range(120)]
    texts = [passage + [word() for _ in range(25)] for _ in range(40)]
    drift = [word() for _ in range(150)]
    for _ in range(60):
        texts.append(list(drift))
        for _ in range(2):
            drift[draw.randrange(150)] = word()
    texts = [" ".join(x) for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in s.survivors(docs).collect()} == jaccard_components(texts)


def test_prefixes_find_every_link_between_components(spark):
    draw = random.Random(3)
    sets = [sorted(draw.sample(range(60), draw.randrange(48, 59))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(sets)), "fp long, hashes array<long>")
    met = frame.selectExpr("7L AS key", "fp", "60L AS n", "0L AS centre")
    want = {(a, b) for b in range(60) for a in range(b) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    none = frame.selectExpr("fp AS node", "fp AS root").limit(0)
    got = {tuple(r) for r in s.verified(s.apart(met, none, frame), frame, "test").collect()}
    assert got == want and want
    joined = frame.selectExpr("fp AS node", "fp DIV 30 AS root")
    got = {tuple(r) for r in s.verified(s.apart(met, joined, frame), frame, "test").collect()}
    assert got == {(a, b) for a, b in want if a // 30 != b // 30}
    assert s.apart(met, frame.selectExpr("fp AS node", "0L AS root"), frame).count() == 0


def test_candidates_grow_with_the_rows(spark):
    keys = spark.range(400).selectExpr("id AS fp", "explode(array(1L, 2L, 1000 + id DIV 4)) AS key")
    met = s.meetings(keys)
    got = {tuple(r) for r in s.candidates(met).collect()}
    assert len(got) <= 2 * 399 + 100 * 6 and all((4 * i + a, 4 * i + b) in got for i in range(100) for a in range(4) for b in range(a + 1, 4))


def test_null_and_repeated_ids_in_the_query(spark, tmp_path):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, None), (2, ""), (9, "w " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = s.op3_deletion_variants(spark, str(tmp_path)).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.component_id) for r in got} == {(4, 4), (None, 4), (None, 2), (2, 2), (9, 9)}
    assert {r.fingerprint for r in got if r.component_id == 2} == {"0" * 16}
