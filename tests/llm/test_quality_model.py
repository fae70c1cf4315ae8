import zlib

import numpy as np

from boundwright.llm import quality_model as q


def test_chunks_cover_every_place():
    for n in (0, 1, 7, 8, 9, 511, 512, 513, 517, 518, 519, 1018, 1019, 2000):
        text = bytes(i % 251 for i in range(n))
        rows, first = q.cut([b"zz", text])
        own = rows[first[1] : first[2]]
        seen = {k * q.HOP + p * q.STEP for k in range(len(own)) for p in range(q.PLACES)}
        assert all(at in seen for at in range(0, max(1, n - q.WIDTH + 1), q.STEP))
        for k, row in enumerate(own):
            part = text[k * q.HOP : k * q.HOP + q.CHUNK]
            assert row[: len(part)].tolist() == list(part) and (row[len(part) :] == q.PAD).all()


def test_gradient():
    net = q.Network(0.1, 3)
    net.learning = True
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    texts, wanted = [b"hello world " * 70, b"#### ab"], np.array([1.0, 0.0])  # an empty text stands at a kink
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * wanted - 1) * np.log((p := net.scores(texts)) / (1 - p))))))
    got = net.slopes(texts, wanted)
    for k, at in (("out", 3), ("bias", 0), ("shift", 5), ("filters", (10, 4)), ("embed", (ord("o"), 2))):
        was = net.w[k][at]
        net.w[k][at] = was + 1e-3
        up = loss()
        net.w[k][at] = was - 1e-3
        down = loss()
        net.w[k][at] = was
        assert abs((up - down) / 2e-3 - got[k][at]) < 2e-3


def test_query_on_held_out_rows(spark):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.op8_byte_network(spark, at).collect()}
    assert len(got) == spark.read.parquet(f"{at}/documents.parquet").count()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{at}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    right = np.mean([got[i].predicted == y for i, y in labels])
    assert right > max(np.mean([y for _, y in labels]), 0.9)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "x", 0.1), (2, "", 0.2), (2, "", 0.2), (3, "y" * 100_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = q.learned(docs, none)
    got = docs.select("doc_id", q.score("text", net).alias("p")).collect()
    assert len(got) == 5 and all(abs(r.p - 0.5) < 1e-6 for r in got)
    odd = spark.createDataFrame([(2, None), (3, 7), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    assert q.accepted(docs, q.learned(docs, odd)).columns == docs.columns
    assert q.accepted(docs.limit(0), net).count() == 0


def naive_score(net, text):
    """The score of a text by plain loops over chunks, places and filters."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    chunks = range(0, max(1, -(-(len(text) - (q.WIDTH - q.STEP)) // q.HOP)) * q.HOP, q.HOP)
    seen = []
    for at in chunks:
        codes = [text[at + i] if at + i < len(text) else q.PAD for i in range(q.CHUNK)]
        places = [np.concatenate([w["embed"][c] for c in codes[p : p + q.WIDTH]]) @ w["filters"] for p in range(0, q.CHUNK - q.WIDTH + 1, q.STEP)]
        seen.append(np.maximum(np.max(places, axis=0) + w["shift"], 0))
    pooled = np.concatenate([np.max(seen, axis=0), np.mean(seen, axis=0)])
    return 1 / (1 + np.exp(-(pooled @ w["out"] + w["bias"][0])))


def test_against_naive_convolution():
    net = q.Network(0.3, 7)
    net.w["shift"] = np.linspace(-0.2, 0.2, q.FILTERS).astype(np.float32)
    texts = [b"", b"a", b"some words " * 5, bytes(range(256)) * 3, b"x" * (q.HOP + q.WIDTH - q.STEP), b"yz" * 900]
    assert np.allclose(net.scores(texts), [naive_score(net, x) for x in texts], atol=1e-5)


def test_long_texts_are_learned_from_whole_within_a_budget(spark, monkeypatch):
    long = "".join(f"{i:07d} " for i in range(2_500))
    docs = spark.createDataFrame([(i, long + str(i) if i % 2 else f"short {i}") for i in range(40)] + [(3, "a least text"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert q.learned(docs.limit(0), labels).scores([b"a"])[0] == 0.5
    net = q.learned(docs, labels)
    assert net.scores([long.encode()])[0] > net.scores([b"short 2"])[0]
    met = []
    monkeypatch.setattr(q, "fit", lambda texts, marks: met.append(dict(zip(texts, marks.tolist(), strict=True))))
    q.learned(docs, labels)
    taught = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    text = lambda i: "short " + str(i) if i % 2 == 0 else min(long + str(i), "a least text") if i == 3 else long + str(i)
    assert met[0] == {text(i).encode(): i % 2 for i in taught}
    q.learned(docs, labels, size=30_000)  # two long texts reach it
    assert set(met[1]) < set(met[0]) and sum(map(len, met[1])) >= 30_000 > sum(map(len, met[1])) - max(map(len, met[1]))
    q.learned(docs, labels, rows=5)
    assert len(met[2]) == 5 and set(met[2]) < set(met[0])
