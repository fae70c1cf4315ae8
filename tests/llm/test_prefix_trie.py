import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from boundwright.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node of the trie by its turns, from all conversations at once."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn, role or "", text or ""))
    md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    own = {c: [r[1:] for r in sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r)))] for c, x in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * words
        leaves[node] = leaves.get(node, 0) or 1
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children.get(n, 0), leaves[n], saved[n], sha(n)) for n, m in members.items())


def found(df):
    rows = [tuple(r) for r in df.select(*P.COLUMNS).collect()]
    return sorted(r[:2] + (-1 if r[2] is None else r[2],) + r[3:] for r in rows)


def run(spark, tmp_path, rows, extra=()):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("?") for c in extra}).write.parquet(str(tmp_path / "conversations.parquet"))
    return found(P.op12_prefix_trie(spark, str(tmp_path)))


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(P.op12_prefix_trie(spark, sf_dir)) == brute(rows)


#: Equal conversations, prefixes of each other, deep ones, ties, nulls and repeated rows.
ODD = [(None, 0, "user", "lost")] + [(c, t, "user", f"t{t} of {c % 3 if t > 2 else 0}") for c in range(100, 140) for t in range(c % 7)]
ODD += [(c, t, "user", "same words") for c in range(200, 260) for t in range(2)] + [(300, t, None, None) for t in range(80)] + [(301, t, None, None) for t in range(75)]
ODD += [(320, None, "user", "first"), (320, 0, "user", "b"), (320, 0, "user", "a"), (320, 0, "assistant", "z")] + [(340, 0, "user", "twice")] * 3
ODD += [(360, 0, "user", "long " * 30_000), (361, 0, "user", "long " * 30_000), (362, 5, "", ""), (381, 1, "user", "no base")]


def test_odd_rows(spark, tmp_path):
    assert run(spark, tmp_path, ODD, ("ids", "shard", "side", "words")) == brute(ODD)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_recombine(spark, tmp_path, monkeypatch, shards):
    monkeypatch.setattr(P, "SHARD", len(ODD) // shards)
    assert run(spark, tmp_path, ODD) == brute(ODD)


@pytest.mark.parametrize(("strip", "piece"), [(1, 1), (3, 2), (32, 5)])
def test_strips_and_pieces(spark, tmp_path, monkeypatch, strip, piece):
    """One shard, in this process: conversations wider than a strip, ids in several pieces."""
    monkeypatch.setattr(P, "STRIP", strip)
    monkeypatch.setattr(P, "PIECE", piece)
    own = P.rebuilt(P.sequences(spark.createDataFrame(ODD, SCHEMA))).withColumns({"shard": F.lit(0), "side": F.lit(0)})
    assert sorted(tuple(-1 if x is None else x for x in r) for r in P.shard_nodes(own.toPandas())[P.COLUMNS].itertuples(index=False)) == brute(ODD)


def test_empty_and_turnless(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    turnless = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "x") for c in turnless]
    assert run(spark, tmp_path / "b", rows) == brute(rows)
    assert len(brute(rows)) == 1
