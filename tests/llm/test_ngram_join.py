import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from boundwright.llm import ngram_join as N

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    """All pairs of documents."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    shown = [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted(shown, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def run(spark, tmp_path, rows, extra=()):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("?") for c in extra}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return found(N.op13_ngram_join(spark, str(tmp_path)))


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(N.op13_ngram_join(spark, sf_dir)) == brute(rows)


def edited(rng, words, k, kinds):
    """A text with k random words replaced by one of so many others, or with words added at its end."""
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"e{rng.randrange(kinds)}"
    return " ".join(out + [f"x{rng.randrange(4)}" for _ in range(rng.randrange(3))])


def test_near_copies_and_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None, "A null id has  words"), (3, "a NULL id\thas words"), (None, "alone here now"), (4, None), (5, ""), (6, " \n"), (7, "one"), (8, "ONE"), (9, "one two"), (9, "one two"), (10, "Ä b c")]
    rows += [(11, "ä b c"), (12, "w " * 9000), (13, " ".join(f"w{i}" for i in range(20_000))), (14, " ".join(f"w{i}" for i in range(19_000)))]
    for g in range(12):
        base = [f"b{g}w{i}" for i in range(rng.choice([4, 9, 12, 30, 60, 120, 300]))]
        rows += [(100 * (g + 1) + i, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5]), 5)) for i in range(40)]
    assert run(spark, tmp_path, rows, ("key", "fp", "n", "at", "lead")) == brute(rows)


@pytest.mark.parametrize("seed", [3, 40])
def test_large_groups_of_near_copies(spark, tmp_path, seed):
    """All sets share most tokens, so that the index has classes of pairs and threes; several components remain."""
    rng = random.Random(seed)
    rows = []
    for g, n in enumerate((45, 80, 200)):
        base = [f"b{g}w{i}" for i in range(n)]
        rows += [(1000 * (g + 1) + i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6]), 300)) for i in range(150)]
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rarest_first", [True, False])
def test_keys_meet(monkeypatch, rarest_first):
    """Linked sets share a key that lets them pass, whatever the order and the counts of their tokens, and within the extended prefix."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(N, "RARE", 2)
    monkeypatch.setattr(N, "OFTEN", 6)
    many = {t: int(rng.integers(2, 12)) for t in range(3000)}

    def keys(s, twin):
        order = sorted(s, key=lambda t: (many[t], t) if rarest_first else t)
        tokens = [(i, many[t], t) for i, t in enumerate(order) if t in twin or many[t] > 2]
        return N.keys_of(tokens[: N.reach(len(s))] if len(tokens) == len(s) else tokens, len(s))

    linked = 0
    for _ in range(3000):
        size = int(rng.choice([2, 3, 9, 10, 11, 20, 33, 100, 400]))
        x = set(rng.choice(3000, size, replace=False).tolist())
        y = set(x)
        for t in rng.choice(sorted(x), min(size, int(rng.integers(0, size // 9 + 2))), replace=False).tolist():
            y.discard(t)
        y |= set(rng.choice(3000, int(rng.integers(0, size // 9 + 2))).tolist())
        if y and 100 * len(x & y) >= 90 * len(x | y):
            linked += x != y
            a, b = keys(x, y), keys(y, x)
            need = 90 * (len(x) + len(y))
            assert x == y or any(190 * min(a[k], b[k]) >= need for k in a.keys() & b.keys())
    assert linked > 500


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(200):
        x = set(rng.integers(-(1 << 63), 1 << 63, int(rng.integers(1, 300))).tolist())
        y = set(list(x)[: int(rng.integers(0, len(x) + 1))]) | set(rng.integers(-(1 << 63), 1 << 63, 20).tolist())
        a, b = N.parities([np.array(sorted(s), dtype="<i8") for s in (x, y)]).to_numpy().view("<u8")
        assert sum(int(v).bit_count() for v in a ^ b) <= len(x ^ y)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
