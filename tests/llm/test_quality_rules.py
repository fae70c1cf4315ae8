import os
import random
import re

from boundwright.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    marked = set()
    for i in range(len(words) - 2):
        if sum(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2)) > 1:
            marked |= {i, i + 1, i + 2}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_counts_against_brute_force(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a ", "b ", "é ", "\n", "c\n", "#", "|x ", " ", "\x1f", "\t"]) for _ in range(draw.randrange(120))) for _ in range(150)] + [None, "", " \n", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", q.verdict("text").alias("v")).select("doc_id", "v.*").collect()
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(n))


def test_bands(spark):
    plain = words(3000, 1)
    spoilt = plain + " " + ("lorem ipsum " * 400) + words(3000, 2)
    docs = spark.createDataFrame([(1, plain, "v"), (2, spoilt, "v"), (3, "word " * 60, "v"), (4, None, "v"), (5, plain, "v")], "doc_id long, text string, v string")
    assert sorted(r.doc_id for r in q.kept(docs).collect()) == [1, 5]
    assert q.kept(docs).columns == docs.columns and q.kept(docs.limit(0)).count() == 0


def test_incompressible_is_out_of_band():
    import base64

    text = " ".join(base64.b85encode(os.urandom(30)).decode() for _ in range(300))
    import zstandard

    *_, failed, ratio, low, high, kept = q.judge(text, zstandard.ZstdCompressor(level=q.LEVEL).compress)
    assert not failed and not kept and ratio < 1.4


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = q.op7_compression_bands(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got[:60]:
        if len(docs[r.doc_id]) < 3000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id])


def brute_bands(text):
    """Ratios and the bands' verdict, piece by piece from the definition."""
    import zstandard

    data = (text or "").encode()
    if not data:
        return 0.0, 0.0, 0.0, True
    ratio = lambda x: len(x) / len(zstandard.compress(x, q.LEVEL))
    pieces = [data[i * q.CHUNK : (i + 1) * q.CHUNK] for i in range(-(-len(data) // q.CHUNK))]
    ratios = [ratio(x) for x in pieces] if len(pieces) > 1 else [ratio(data)]
    fits = True
    for x, r in [(data, ratio(data)), *zip(pieces, ratios)]:
        band = [b for b in q.BANDS if len(x) <= b[0]][0]
        fits = fits and band[1] <= r <= band[2]
    return ratio(data), min(ratios), max(ratios), fits


def test_bands_against_brute_force(spark):
    """Every document's ratios and verdict, with long, repeated and null rows."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(9001, words(400_000, 3)), (9001, words(400_000, 3)), (9002, None), (None, words(80, 4)), (9003, "x" * 3_000_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = frame.select("doc_id", q.verdict("text").alias("v")).select("doc_id", "v.*").collect()
    want = sorted((str(i), *brute_bands(x)[:3]) for i, x in docs)
    assert sorted((str(r.doc_id), r.ratio, r.low_chunk, r.high_chunk) for r in got) == want
    fits = {(str(i), brute_bands(x)[0]): brute_bands(x)[3] for i, x in docs}
    assert all(r.kept == (fits[str(r.doc_id), r.ratio] and not r.base_failed) for r in got) and any(r.kept for r in got)
