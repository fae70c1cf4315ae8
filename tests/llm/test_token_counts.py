import base64
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from boundwright.llm import token_counts as t

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(exact, text, sections, rule):
    """Section to tokens, one character at a time."""
    of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
    of_char = {}
    for k, (a, b) in enumerate(sections):
        for c in range(a, b):
            of_char[c] = k
    total, cross, at = Counter(), Counter(), 0
    for token in exact.encode_ordinary(text):
        n = len(exact.decode_single_token_bytes(token))
        chars = sorted(set(of_byte[at : at + n]))
        at += n
        parts = [of_char.get(c, -1) for c in chars]
        if len(set(parts)) > 1:
            cross.update(set(parts))
        if rule == "share":
            for p in parts:
                total[p] += 1 / len(parts)
        else:
            best = max(Counter(parts).values())
            total[{"first": parts[0], "last": parts[-1], "most": next(p for p in parts if parts.count(p) == best)}[rule]] += 1
    return total, cross


@pytest.mark.parametrize("rule", t.RULES)
def test_rules_against_brute_force(spark, exact, rule):
    draw, rows = random.Random(6), []
    for i in range(60):
        text = "".join(draw.choice(["the ", "\n", "\n\n", "ciónñ", "語", "🙂", " a", ".", "tion", "  "]) for _ in range(draw.randrange(40)))
        cuts = sorted(draw.sample(range(len(text) + 1), min(len(text), draw.randrange(7))))
        rows.append((i, text, [(a, b) for a, b in zip(cuts, cuts[1:]) if draw.random() < 0.8]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start: int, end: int>>")
    got = {i: {} for i, *_ in rows}
    for r in docs.select("doc_id", F.explode(t.counts("text", PATH, P.PATTERN, "parts", rule)).alias("c")).select("doc_id", "c.*").collect():
        got[r.doc_id][r.section] = r
    for i, text, parts in rows:
        total, cross = brute(exact, text, parts, rule)
        assert set(got[i]) >= set(range(len(parts)))
        for k in {*got[i], *total}:
            assert abs(got[i][k].n_tokens - total[k]) < 1e-9 and got[i][k].n_crossing == cross[k]


def test_lines():
    assert t.lines("") == [(0, 0)] and t.lines("a\n\nb\n") == [(0, 2), (2, 3), (3, 5)] and t.lines("a\nb") == [(0, 2), (2, 3)]


def test_query(spark, sf_dir, exact):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in t.op4_line_tokens(spark, sf_dir).collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    assert set(got) == set(docs)
    for i, x in docs.items():
        total, _ = brute(exact, x, t.lines(x), "first")
        assert {k: r.n_tokens for k, r in got[i].items() if r.n_tokens} == dict(total)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", [(0, 0)]), (3, "a b", [None, (5, 9), (2, 1), (None, 1)]), (3, "a b", [None, (5, 9), (2, 1), (None, 1)]), (None, "x" * 100_000, [(0, 100_000)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section array<struct<start: int, end: int>>")
    got = docs.select("doc_id", F.explode_outer(t.counts("text", PATH, P.PATTERN, "section")).alias("c")).select("doc_id", "c.*").collect()
    assert sum(r.section == -1 and r.n_tokens == 2 for r in got if r.doc_id == 3) == 2
    assert [r.n_tokens for r in got if r.doc_id == 2] == [0.0] and len(got) == 1 + 1 + 10 + 1
    assert docs.limit(0).select(t.counts("text", PATH, P.PATTERN)).collect() == []
