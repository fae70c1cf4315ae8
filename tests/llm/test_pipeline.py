"""The pipeline against its stages taken one document at a time."""

import zstandard

import corpus_pipeline as p
from boundwright.llm import quality_model, quality_rules
from boundwright.llm.decontaminate import words


def test_against_brute_force(spark):
    at = "/root/testdata/sf0.01"
    read = lambda t: spark.read.parquet(f"{at}/{t}.parquet")
    got = {r.doc_id: r for r in p.run(spark, at).collect()}
    left = {r.doc_id: r.text for r in read("documents").collect()}
    net = quality_model.learned(read("documents"), read("labels"))
    left = {i: x for (i, x), s in zip(left.items(), net.scores([x.encode() for x in left.values()]), strict=True) if s >= 0.5}
    squeeze = zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress
    left = {i: x for i, x in left.items() if quality_rules.judge(x, squeeze)[-1]}
    order = sorted(left)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((left[i] or "").encode().lower().split() for i in order)]
    root = list(range(len(order)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    left = {i: left[i] for k, i in enumerate(order) if find(k) == k}
    plain = lambda x: " " + " ".join(words(x)) + " "
    items = [plain(r.text) for r in read("benchmark").collect()]
    left = {i: x for i, x in left.items() if not any(t in plain(x) for t in items)}
    assert set(got) == set(left) and len(left) > 300


def test_odd_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, 1), (None, "", "en", "s", 0, 1), (2, "plain words " * 300, "en", "s", 0, 1)], "doc_id long, text string, lang string, source string, n_chars long, fp long")
    for frame in (docs, docs.limit(0)):
        kept = frame
        for _, stage in p.STAGES[:-1]:
            kept = stage(spark, kept, "/root/testdata/sf0.001")
            assert kept.columns == docs.columns
        assert p.STAGES[-1][1](spark, kept, "").count() == kept.count()
