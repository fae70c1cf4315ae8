import os
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers as P
import pytest

from boundwright.llm import attention as a

TOKENS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def model():
    own = a.subwords(*TOKENS)
    counts = np.zeros(own.end + 1)
    draw = np.random.default_rng(2)
    counts[draw.choice(own.end, 3000, replace=False)] = draw.integers(1, 500, 3000)
    counts[own.end] = 40
    pairs = lambda row, slot: draw.integers(0, 3, (a.ROWS + 1, a.HEAD + 2)).astype(float)
    return a.Model.fresh(counts, own.end, pairs)


def test_windows_score_each_id_once():
    for n in (1, 2, a.STRIDE, a.STRIDE + 1, 100):
        ids = np.arange(n, dtype=np.int32)
        lines = a.windows(ids, 7777)
        targets = lines[:, a.CONTEXT + 1 :].ravel()
        assert targets[targets != a.PAD].tolist() == ids.tolist()
        for k, line in enumerate(lines):
            whole = [7777, *ids.tolist()]
            lo = max(0, k * a.STRIDE - a.CONTEXT)
            assert line[line != a.PAD].tolist() == whole[lo : k * a.STRIDE + a.STRIDE + 1]


def test_next_ids_sum_to_one(model):
    every = np.arange(model.end + 1, dtype=np.int32)
    ids = np.array([15, 300, 40_000, 7], dtype=np.int32)
    line = a.windows(ids, model.end)[0]
    for place in range(3):
        lines = np.repeat(line[None], len(every), axis=0)
        lines[:, a.CONTEXT + 1 + place] = every
        assert abs(np.exp(model.log_probabilities(lines)[:, place]).sum() - 1) < 1e-4


def test_batches_do_not_matter_and_nothing_looks_ahead(model):
    draw = np.random.default_rng(1)
    docs = [draw.integers(0, model.end, n).astype(np.int32) for n in (1, 5, 24, 25, 200, 3)]
    whole = model.score(docs)
    assert np.allclose(whole, [model.score([x])[0] for x in docs], rtol=1e-5)
    line = a.windows(docs[4], model.end)
    changed = line.copy()
    changed[:, a.CONTEXT + 12 :] = 5
    assert np.allclose(model.log_probabilities(line)[:, :11], model.log_probabilities(changed)[:, :11], rtol=1e-5)
    assert len(model.score([])) == 0


def test_gradient(model):
    lines = a.windows(np.random.default_rng(3).integers(0, 50_000, 60).astype(np.int32), model.end)
    was = model.w
    model.w = {k: v.astype(np.float64) for k, v in was.items()}
    n = (lines[:, a.CONTEXT + 1 :] != a.PAD).sum()
    loss = lambda: -model.log_probabilities(lines).sum() / n
    got = model.slopes(lines)
    for k, g in got.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = model.w[k][at]
        model.w[k][at] = before + 1e-4
        up = loss()
        model.w[k][at] = before - 1e-4
        down = loss()
        model.w[k][at] = before
        assert abs((up - down) / 2e-4 - g[at]) < 1e-3 + 0.02 * abs(g[at]), k
    model.w = was


def brute(docs):
    """doc_id to (held_out, n_tokens, n_known, N, base)."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    low = {i: (x or "").encode().lower().split() + [None] for i, x in docs}
    c = Counter(w for i, ws in low.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in low.items()}


def test_query_against_brute_force_and_base(spark):
    at = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    want = brute(docs)
    got = a.op6_attention(spark, at).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * abs(w[4])
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new) and all(r.score < 0 for r in got)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "A a b"), (4, "z " * 40_000), (12, "a new")]
    frame = spark.createDataFrame([(i, x, 0.5, "w") for i, x in docs] + [(3, "A a b", 0.5, "w")], "doc_id long, text string, score double, word string")
    got = a.scored(frame, TOKENS).collect()
    assert len(got) == 6 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert len({(r.base_score, round(r.score, 4)) for r in got if r.doc_id == 3}) == 1
    assert a.scored(frame.limit(0), TOKENS).collect() == []
    none = a.scored(frame.filter("doc_id = 12").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text"), TOKENS).collect()
    assert len(none) == 1 and none[0].n_known == 1


def test_ids_of_words():
    own = a.subwords(*TOKENS)
    words = [b"the", b"it's", b"x!!", "ciónñ".encode(), "a\u3000b".encode(), "\u00a0".encode(), b"\x1c", b"'", "é!".encode(), b"of,", b"a" * 300]
    for some in (words, words[:3], words[4:5], words[6:8], []):
        ids, sizes = own.flat(some)
        want = [own.encode(" " + w.decode()) for w in some]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert [x.tolist() for x in own.ids([words, []])] == [sum((own.encode(" " + w.decode()) for w in words), []) + [own.end], [own.end]]


def written_ids(spark, rows, parts):
    own = a.subwords(*TOKENS)
    ids = own.ids([a.split(x) for _, x in rows])
    packed = [(i, x.astype(a.packing(own.end)).tobytes()) for (i, _), x in zip(rows, ids)]
    return spark.createDataFrame(packed, "number long, ids binary").repartition(parts), sum(len(a.windows(x, own.end)) for x in ids)


def test_every_window_is_learned_from_and_counts_the_same(spark, model):
    docs, want = written_ids(spark, [(i, " ".join(f"w{(i * k) % 97}" for k in range(40))) for i in range(1100)], 1)
    assert sum(r.n for k in range(a.ROUNDS) for r in a.taught(docs, model, k).select("n").collect()) == want > 2048
    both = [(p, n, a.pickle.dumps({"x": np.array([v], dtype=np.float32)})) for p, n, v in ((0, 1, 0.0), (5, 3, 4.0))]
    one = a.averaged(spark.createDataFrame(both, "part int, n long, w binary")).collect()
    assert len(one) == 1 and one[0].n == 4 and a.pickle.loads(one[0].w)["x"].tolist() == [3.0]


def test_blocks_hold_every_window_once(spark, model):
    rows = [(i, "w" + " a" * n) for i, n in enumerate((0, 1, 22, 23, 24, 190, 191, 192, 193, 5_000))]
    docs = written_ids(spark, rows, 3)[0]
    kind = a.packing(model.end)
    got = Counter(tuple(x) for k in range(a.ROUNDS) for r in a.blocks(docs, model.end, k).collect() for x in a.opened([bytes(r.block)], kind).tolist())
    ids = [a.unpacked([bytes(r.ids)], kind) for r in docs.collect()]
    assert got == Counter(tuple(x) for own in ids for x in a.windows(own, model.end).tolist())
    assert a.opened([], kind).shape == (0, a.SPAN + 1)


def test_layout_does_not_matter(spark, model):
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(60 + 20 * (i % 5)))) for i in range(300)]
    learned = []
    for parts in (1, 7):
        got = {r.part: (r.n, a.pickle.loads(r.w)) for r in a.taught(written_ids(spark, rows, parts)[0], model, 0, 3).collect()}
        assert sorted(got) == [0, 1, 2]
        learned.append(got)
    for part, (n, w) in learned[0].items():
        m, v = learned[1][part]
        assert n == m and w.keys() == v.keys() and all(np.array_equal(w[k], v[k]) for k in w)


def naive(model, ids):
    """The score of a document, id by id, in plain loops over the definition."""
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    whole, total = [model.end, *ids.tolist()], 0.0
    softmax = lambda z: z - np.log(np.exp(z - z.max()).sum()) - z.max()
    for t in range(1, len(whole)):
        begin = (t - 1) // a.STRIDE * a.STRIDE
        now, seen = model.row[whole[t - 1]], range(max(0, begin - a.CONTEXT), t)
        z = np.array([w["query"][now] @ w["key"][model.row[whole[j]]] * model.scale + w["distance"][t - 1 - j] for j in seen])
        mixed = sum(x * w["value"][model.row[whole[j]]] for x, j in zip(np.exp(softmax(z)), seen))
        state = np.maximum(mixed + w["residual"][now], 0)
        slot = int(model.slot[whole[t]])
        group = min(slot // a.CLASS, a.CLASSES - 1)
        total += softmax(state @ w["class"] + w["class_bias"] + model.after[now])[group]
        if slot < a.HEAD:
            total += softmax(state @ w["member"][group] + w["member_bias"][group] + model.within[group, now])[slot % a.CLASS]
        else:
            c = (slot - a.HEAD) // a.TAIL
            total += softmax(state @ w["tail"] + w["tail_bias"] + model.tail)[c]
            total += softmax(state @ w[f"tail-{c}"][:-1] + w[f"tail-{c}"][-1] + model.tails[c])[(slot - a.HEAD) % a.TAIL]
    return total


def test_against_naive_attention(model):
    draw = np.random.default_rng(4)
    for name, v in model.w.items():
        model.w[name] = v + draw.normal(0, 0.1, v.shape).astype(np.float32)
    for n in (1, 23, 24, 25, 90):
        ids = np.r_[draw.integers(0, model.end, n), model.end].astype(np.int32)
        assert abs(model.score([ids])[0] - naive(model, ids)) < 1e-4 * n + 1e-3


def test_commonest_words(spark):
    words = spark.createDataFrame([(b"a", 9), (b"b", 9), (b"c", 2), (b"d", 1), (b"e", 1)], "word binary, n long")
    for most, want in ((5, 5), (4, 3), (3, 3), (2, 2), (1, 0)):
        assert a.commonest(words, most).count() == want


def test_logits_far_below_zero_stay_finite():
    z = np.array([[-200.0, -201.0, -300.0], [100.0, 0.0, 99.0]], dtype=np.float32)
    got = a.softmax_at(z, np.array([1, 2]))
    assert np.allclose(got, np.log(1 / (1 + np.e)), atol=1e-4)


def test_known_words_cost_their_share_at_most(model):
    own = a.subwords(*TOKENS)
    words = [b"zymurgy", b"the", b"qq!!xx", b"antidisestablishmentarianism"]
    both = a.replace(model, words=a.Words.of(own, words, [-1.0, -2.0, -1.5, -0.7], -1.2))
    docs = own.ids([words, [], [b"the", b"unseen-word"]])
    got, alone = both.score(docs), model.score(docs)
    assert got[0] > np.log(10) * -6.4 + 5 * np.log(a.WORD_WEIGHT) > alone[0]
    assert got[1] > np.log(10) * -1.2 + np.log(a.WORD_WEIGHT)
    assert np.isfinite(got).all() and got[2] > alone[2] + 3 * np.log(1 - a.WORD_WEIGHT)


def test_little_to_learn_from(spark, sf_dir):
    new = [r for r in a.op6_attention(spark, sf_dir).collect() if r.held_out]
    assert new and sum(r.score for r in new) > 1.07 * sum(r.base_score for r in new)


def test_sums_at_are_those_of_a_loop():
    draw = np.random.default_rng(4)
    at, slope = draw.integers(0, a.ROWS, (7, 5)).astype(np.int32), draw.normal(0, 1, (7, 5, 3)).astype(np.float32)
    want = np.zeros((a.ROWS, 3), dtype=np.float32)
    np.add.at(want, at.ravel(), slope.reshape(-1, 3))
    one, other = a.sums_at(at, a.ROWS, slope, 2 * slope)
    assert np.allclose(one, want, atol=1e-5) and np.allclose(other, 2 * want, atol=1e-5)


def test_rows_of_ordinary_logits_are_not_searched_for_their_greatest():
    class Counted(np.ndarray):
        by_rows = 0

        def max(self, axis=None, **more):
            Counted.by_rows += axis is not None
            return np.asarray(self).max(axis=axis, **more)

    z = np.random.default_rng(5).normal(0, 9, (40, 33)).astype(np.float32)
    want = np.exp(z)
    assert np.array_equal(np.asarray(a.exponentials(z.copy().view(Counted))), want) and Counted.by_rows == 0
    far = (z - np.float32(200)).view(Counted)
    assert np.isfinite(np.log(a.exponentials(far))).all() and Counted.by_rows == 1


def test_models_are_averaged_in_pieces(spark, monkeypatch):
    names = [("w", f"tail-{c}") for c in range(200)]
    draw = np.random.default_rng(6)
    rows = [(p, p % 3 + 1, {x: draw.normal(0, 1, 500).astype(np.float32) for x in names[p % 2 :]}) for p in range(40)]
    want = {x: sum(n * w[x].astype(np.float64) for _, n, w in rows if x in w) / sum(n for _, n, _ in rows) for x in names}
    kept = []
    monkeypatch.setattr(a, "written", lambda df, label, own=a.written: kept.append(own(df, label)) or kept[-1])
    one = a.averaged(spark.createDataFrame([(p, n, a.pickle.dumps(w)) for p, n, w in rows], "part int, n long, w binary")).collect()
    got = a.pickle.loads(one[0].w)
    assert len(one) == 1 and one[0].n == sum(n for _, n, _ in rows) and got.keys() == want.keys()
    assert all(np.allclose(got[x], want[x], atol=1e-5) for x in names)
    largest = max(r.m for df in kept for r in df.selectExpr("max(octet_length(w)) AS m").collect())
    assert len(kept) == 2 and largest < len(one[0].w) / 8


def test_broadcasts_end_with_the_query(spark, sf_dir, monkeypatch):
    made, own = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(own(self, value)) or made[-1])
    got = a.op6_attention(spark, sf_dir)
    assert len(made) == a.ROUNDS + 3 and all(b._path is None or not os.path.exists(b._path) for b in made)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
