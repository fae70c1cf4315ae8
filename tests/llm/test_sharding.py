import random
import zlib
from collections import Counter

import pytest

from boundwright.llm import sharding as s


def brute(sizes, shards):
    """The ends of the shards of the smallest capacity, tried from the least."""
    capacity = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        ends, at, room = [], 0, capacity
        for x in sizes:
            if x > room:
                ends.append(at)
                room = capacity
            at, room = at + x, room - x
        ends.append(at)
        if len(ends) <= shards:
            return ends + [at] * (shards - len(ends))
        capacity += 1


@pytest.mark.parametrize("buckets", [3, 64, 1 << 14])
@pytest.mark.parametrize("seed", range(4))
def test_minimax_against_trying_every_capacity(spark, seed, buckets):
    draw = random.Random(seed)
    sizes = [draw.choice([1, draw.randrange(1, 40), draw.randrange(1, 900)]) for _ in range(draw.choice([3, 40, 250]))]
    at, rows = 0, []
    for x in sizes:
        at += x
        rows.append((at, x))
    groups = spark.createDataFrame(rows, "end long, size long").coalesce(2).cache()
    for shards in (1, 2, 8):
        assert s.minimax(groups, shards, buckets) == brute(sizes, shards)


def check(rows, docs, shards):
    """The whole contract; docs: list of (doc_id, text)."""
    texts = {}
    for i, x in docs:
        texts.setdefault(x or "", []).append(s.LAST if i is None else i)
    groups = sorted((min(ids), x) for x, ids in texts.items())
    sizes = [len(texts[x]) * (len(x.encode()) + 1) for _, x in groups]
    ends = brute(sizes, shards)
    want, at = {}, 0
    for (_, x), size in zip(groups, sizes, strict=True):
        at += size
        want[x] = next(k for k, e in enumerate(ends) if at <= e)
    of = dict(docs)
    for r in rows:
        x = of[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.shard) == (len(x.encode()) + 1, zlib.crc32(x.encode()), want[x])
    assert len(rows) == len(docs)
    for k, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n))


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = s.op5_minimax_shards(spark, sf_dir).collect()
    check(rows, docs, 8)
    assert {r.law for r in rows} == {"bytes"}


def test_hot_group_nulls_and_few_groups(spark):
    docs = [(i, "same é" if i % 3 else f"text {i}" * (i % 7)) for i in range(120)] + [(500, None), (501, ""), (None, "last"), (502, "z" * 50_000)]
    frame = spark.createDataFrame([(i, x, 1) for i, x in docs], "doc_id long, text string, size int")
    check(s.sharded(frame).collect(), docs, 8)
    few = [(1, "a"), (2, "b"), (2, "b")]
    rows = s.sharded(spark.createDataFrame(few, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == [(1, 0, 0), (2, 1, 0), (2, 1, 1)]
    assert s.sharded(frame.limit(0)).collect() == []
