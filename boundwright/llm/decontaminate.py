"""Benchmark decontamination: a BM25 index of the test items, searched with every passage of the corpus.

Items are cut into even pieces of at most PIECE words; an impact is a term's BM25 weight in a piece as a share of what
the whole piece would score, so one threshold holds for all. A document's passages are windows of
PASSAGE words, half a passage apart: any PIECE words in a row lie whole in one of them.

Every passage is a query. A batch of them is bounded first, as block-max WAND bounds a document, by the greatest that
pieces can get: the commonest terms are set apart as long as no piece has more than COMMON of its score in them, and a piece
whose other terms in a passage leave it below the threshold even with all its common terms is out. A
passage without any other piece has no piece at the threshold, exactly. The others go through block-max WAND over
all posting lists, which returns every piece at or above the threshold.

The items found are then verified against the passages around the hits: at least QUESTION of the five-word
shingles of the item's question and ANSWER of those of its answer (of three words or one, for short parts) must
be there. A changed word breaks five shingles, so half of them are left where one word in eight was changed. The answer
is what follows the last line break, else the last sentence; an item of one sentence is all question.

A batch's words are expanded to postings in runs of passages with at most EXPANDED postings (or one passage), so what
a worker holds grows neither with the text of a batch times the benchmark nor with one long document.

The index goes to the executors by broadcast, in shards of about SHARD bytes of item text or one longer item; a larger
benchmark is searched shard by shard, with the document frequencies of the whole. The driver gets a shard's postings
with numbers for pieces, and each text once. Documents are dealt out as they lie and never shuffled.

Defined results: null and empty texts, in items and documents, match nothing; an item given twice with the same id and
text counts once, with another id or text each counts; repeated documents each get their rows; pieces of equal scores are
all returned; a text of any length is searched whole; with no items or an empty table nothing is found; columns other
than doc_id and text (`leaked`), or all (`clean`), are left as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table

PIECE, PASSAGE = 32, 64
#: Words in a shingle, and the words that a part has at least to be cut into such: a changed word breaks half of them at most.
WIDTHS = ((5, 10), (3, 3), (1, 0))
HALF = PASSAGE // 2
THRESHOLD, QUESTION, ANSWER = 0.6, 0.5, 0.5
K1, B = 1.2, 0.75
COMMON, BLOCK = 0.35, 16
#: Postings of rarer words that are looked at side by side.
EXPANDED = 1 << 20
SHARD = 8 << 20
WORD = re.compile(r"\w+")
LEAKS = "array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double>>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def in_pieces(some: list[str]) -> list[list[str]]:
    """The words cut into the fewest pieces of at most PIECE, as long as one another to a word."""
    n = -(-len(some) // PIECE)
    return [some[len(some) * i // n : len(some) * (i + 1) // n] for i in range(n)]


def halves(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    text = (text or "").strip()
    question, _, answer = text.rpartition("\n")
    if not words(question):
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text)]
        question, answer = (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")
    return words(question), words(answer)


def width(n: int) -> int:
    """Words in a shingle of a part of n words."""
    return max(w for w, least in WIDTHS if n >= least)


def shingles(some: list[str], widths: tuple[int, ...]) -> np.ndarray:
    """Hashes of the shingles of words of all these widths, sorted."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(" ".join(some[i : i + w])) for w in widths for i in range(len(some) - w + 1)], dtype=np.uint64))


class Index:
    """Posting lists of pieces with impacts.

    postings: columns place (of an item), piece, term, tf, df of one shard; texts: (place, item_id, text) of its items.
    """

    def __init__(self, postings: pd.DataFrame, texts: list, pieces: int, mean: float):
        order = np.lexsort((postings["piece"], postings["place"]))
        postings = postings.iloc[order]
        place, number = postings["place"].to_numpy(), postings["piece"].to_numpy()
        new = np.r_[True, (place[1:] != place[:-1]) | (number[1:] != number[:-1])]
        piece = np.cumsum(new) - 1
        tf, df = postings["tf"].to_numpy(np.float64), postings["df"].to_numpy(np.float64)
        length = np.bincount(piece, tf)[piece]
        weight = np.log(1 + (pieces - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        impact = weight / np.bincount(piece, weight)[piece]
        term, names = pd.factorize(postings["term"], sort=True)
        self.terms = {t: i for i, t in enumerate(names)}
        order = np.argsort(term, kind="stable")  # within a term, pieces ascend
        cuts = np.searchsorted(term[order], np.arange(len(names) + 1))
        piece, impact = piece[order], impact[order]
        lists = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
        self.pieces = [piece[a:b].tolist() for a, b in lists]
        self.impacts = [impact[a:b].tolist() for a, b in lists]
        self.most = [max(x) for x in self.impacts]
        self.block_most = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.block_last = [[x[min(i + BLOCK, len(x)) - 1] for i in range(0, len(x), BLOCK)] for x in self.pieces]
        common = np.zeros(int(new.sum()))
        rare = np.ones(len(lists) + 1, dtype=bool)  # the last entry stands for words that no item has
        rare[-1] = False
        for t in sorted(range(len(lists)), key=lambda t: -len(self.pieces[t])):
            own, value = piece[slice(*lists[t])], impact[slice(*lists[t])]
            if (common[own] + value <= COMMON).all():
                common[own] += value
                rare[t] = False
        self.rare = rare
        #: What a piece needs from its rare terms.
        self.need = THRESHOLD - common - 1e-6
        use = np.repeat(rare[:-1], np.diff(cuts))
        self.begin = np.cumsum(np.r_[0, np.where(rare[:-1], np.diff(cuts), 0), 0])
        self.flat_piece, self.flat_impact = piece[use], impact[use]
        self.place_of = place[new].tolist()
        self.items = {r.place: r.item_id for r in texts}
        self.parts = {r.place: tuple(shingles(x, (width(len(x)),)) for x in halves(r.text)) for r in texts}

    def search(self, terms: list[int], least: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every piece whose impacts over these distinct terms sum to `least` or more, by block-max WAND."""
        end = len(self.place_of)
        cursors = [[self.pieces[t][0], t, 0] for t in terms]
        found = []
        least -= 1e-9
        while True:
            cursors.sort()
            total, pivot = 0.0, None
            for i, (at, t, _) in enumerate(cursors):
                if at >= end:
                    break
                total += self.most[t]
                if total >= least:
                    pivot = i
                    break
            if pivot is None:
                return found
            piece = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == piece:
                pivot += 1
            bound, stop = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for _, t, _ in cursors[: pivot + 1]:
                block = bisect_left(self.block_last[t], piece)
                if block < len(self.block_last[t]):
                    bound += self.block_most[t][block]
                    stop = min(stop, self.block_last[t][block] + 1)
            if bound >= least and cursors[0][0] == piece:
                score = sum(self.impacts[t][k] for at, t, k in cursors[: pivot + 1])
                if score >= least:
                    found.append((piece, score))
                to = piece + 1
            elif bound >= least:
                to = piece
            else:
                to = max(stop, piece + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    c[2] = bisect_left(self.pieces[c[1]], to, c[2])
                    c[0] = self.pieces[c[1]][c[2]] if c[2] < len(self.pieces[c[1]]) else end

    def open_windows(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """For each document's term ids, the windows where some piece gets what it needs from its rare terms, repeats counted."""
        sizes = np.array([-(-len(x) // HALF) for x in ids], dtype=np.int64)
        at = np.cumsum(np.r_[0, sizes])
        term = np.concatenate([np.empty(0, dtype=np.int64), *ids])
        half = np.concatenate([np.empty(0, dtype=np.int64), *(np.arange(len(x)) // HALF + a for x, a in zip(ids, at.tolist(), strict=False))])
        use = self.rare[term]
        term, half = term[use], half[use]
        load = np.cumsum(np.r_[0, np.bincount(half, self.begin[term + 1] - self.begin[term], at[-1])])
        hot, a = [np.empty(0, dtype=np.int64)], 0
        while a < at[-1]:
            b = max(a + 1, int(np.searchsorted(load, load[a] + EXPANDED, "right")) - 1)
            some = slice(*np.searchsorted(half, (a, b + 1)))
            hot.append(self.open_between(term[some], half[some], at, a, b))
            a = b
        hot = np.concatenate(hot)
        cuts = np.searchsorted(hot, at)
        return [hot[a:b] - s for a, b, s in zip(cuts, cuts[1:], at.tolist(), strict=False)]

    def open_between(self, term: np.ndarray, half: np.ndarray, at: np.ndarray, a: int, b: int) -> np.ndarray:
        """The open windows from a to before b, ascending; term, half: the rare terms of halves a to b; at: first halves of documents."""
        many = self.begin[term + 1] - self.begin[term]
        posting = np.repeat(self.begin[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        piece, impact, half = self.flat_piece[posting], self.flat_impact[posting], np.repeat(half, many)
        own, inner = half < b, (half > a) & ~np.isin(half, at)  # a document's first half ends no window
        key = np.r_[half[own], half[inner] - 1] * len(self.need) + np.r_[piece[own], piece[inner]]
        if not len(key):
            return key
        order = np.argsort(key)
        key, impact = key[order], np.r_[impact[own], impact[inner]][order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        window, piece = np.divmod(key[starts], len(self.need))
        return np.unique(window[np.add.reduceat(impact, starts) >= self.need[piece]])

    def leaks(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text, (item_id, score, question_overlap, answer_overlap) of every verified item; score: of its best piece."""
        split = [words(x) for x in texts]
        none = len(self.terms)
        ids = [np.fromiter(map(self.terms.get, w, repeat(none)), dtype=np.int64, count=len(w)) for w in split]
        return [self.verified(w, x, open_) for w, x, open_ in zip(split, ids, self.open_windows(ids), strict=True)]

    def verified(self, doc: list[str], ids: np.ndarray, open_: np.ndarray) -> list[tuple]:
        best, near = {}, {}
        for k in open_.tolist():
            terms = np.unique(ids[k * HALF : k * HALF + PASSAGE])
            for piece, score in self.search([t for t in terms.tolist() if t < len(self.terms)]):
                place = self.place_of[piece]
                best[place] = max(best.get(place, 0.0), score)
                near.setdefault(place, set()).add(k)
        out = []
        for place in sorted(best):
            parts = self.parts[place]
            ranges = [(max(0, (k - 1) * HALF), (k + 1) * HALF + PASSAGE) for k in near[place]]
            seen = np.unique(np.concatenate([shingles(doc[a:b], tuple(w for w, _ in WIDTHS)) for a, b in ranges]))
            question, answer = (np.isin(part, seen).sum() / len(part) if len(part) else 1.0 for part in parts)
            if question >= QUESTION and answer >= ANSWER:
                out.append((self.items[place], best[place], float(question), float(answer)))
        return out


def indexes(items: DataFrame, shard: int = SHARD):
    """The shards' indexes of items (item_id, text), one at a time."""

    @F.pandas_udf("array<array<string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([in_pieces(words(x)) for x in texts], dtype=object)

    named = items.select("item_id", "text").filter("text IS NOT NULL").distinct().withColumn("place", F.xxhash64("item_id", "text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard))
    cut = named.select("place", F.posexplode(pieces("text")).alias("piece", "words"))
    stats = cut.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    tf = cut.select("place", "piece", F.explode("words").alias("term")).groupBy("place", "piece", "term").agg(F.count("*").alias("tf"))
    postings = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term")
    for k in range(shards):
        own = F.pmod("place", F.lit(shards)) == k
        found = postings.filter(own).select("place", "piece", "term", "tf", "df").toPandas()
        if len(found):
            yield Index(found, named.filter(own).collect(), stats.n, stats.mean)


def leaks(text: str | Column, index) -> Column:
    """The verified items of a text; index: a broadcast Index."""

    @F.pandas_udf(LEAKS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), x, strict=True)) for x in some] for some in index.value.leaks(texts.tolist())], dtype=object)

    return found(text)


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document and item found in it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = []
    for index in indexes(items):
        own = spark.sparkContext.broadcast(index)
        found.append(docs.select("doc_id", F.explode(leaks("text", own)).alias("leak")).select("doc_id", "leak.*"))
    if not found:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "CAST(NULL AS BIGINT) AS item_id", "0D AS score", "0D AS question_overlap", "0D AS answer_overlap")
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any verified item, with the columns they had."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for index in indexes(items):
        docs = docs.filter(F.size(leaks("text", spark.sparkContext.broadcast(index))) == 0)
    return docs


def op2_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item; scores to six digits."""
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})


QUERIES = {"op2_benchmark_leaks": op2_benchmark_leaks}


def oracle() -> str:
    """The same in DuckDB's SQL: all scores of all passages as sums, without an index."""
    words = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"
    cut = lambda x, w: f"CASE WHEN len({x}) >= {w} THEN list_transform(range(1, len({x}) - {w - 2}), lambda i: array_to_string({x}[i:i + {w - 1}], ' ')) ELSE [] END"
    grams = lambda x: "list_distinct(CASE " + " ".join(f"WHEN len({x}) >= {least} THEN {cut(x, w)}" for w, least in WIDTHS) + " END)"
    shared = lambda x: f"CASE WHEN len({x}) = 0 THEN 1.0 ELSE len(list_intersect({x}, seen)) / len({x}) END"
    return f"""WITH item AS (SELECT row_number() OVER () AS place, * FROM (SELECT DISTINCT item_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare FROM benchmark WHERE text IS NOT NULL)),
    line AS (SELECT *, regexp_extract(bare, '(?s)^(.*)\\n', 1) AS q, regexp_extract(bare, '(?s)^.*\\n(.*)$', 1) AS a FROM item),
    part AS (SELECT place, item_id, text, CASE WHEN len({words('q')}) > 0 THEN q WHEN regexp_matches(bare, '(?s)[.!?]\\s') THEN regexp_extract(bare, '(?s)^(.*[.!?])\\s', 1) ELSE bare END AS q,
      CASE WHEN len({words('q')}) > 0 THEN a WHEN regexp_matches(bare, '(?s)[.!?]\\s') THEN regexp_extract(bare, '(?s)^.*[.!?](\\s.*)$', 1) ELSE '' END AS a FROM line),
    told AS (SELECT place, item_id, {grams('qw')} AS qs, {grams('aw')} AS az FROM (SELECT *, {words('q')} AS qw, {words('a')} AS aw FROM part)),
    spelt AS (SELECT place, {words('text')} AS ws FROM item),
    piece AS (SELECT place, i AS piece, ws[len(ws) * i // n + 1:len(ws) * (i + 1) // n] AS ws FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, CAST(ceil(len(ws) / {PIECE}) AS BIGINT) AS n FROM spelt))),
    tf AS (SELECT place, piece, any_value(size) AS size, term, count(*) AS tf FROM (SELECT place, piece, len(ws) AS size, unnest(ws) AS term FROM piece) GROUP BY place, piece, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM piece),
    weight AS (SELECT place, piece, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * size / mean)) AS w FROM tf JOIN df ON df.term = tf.term, stats),
    impact AS (SELECT place, piece, term, w / sum(w) OVER (PARTITION BY place, piece) AS v FROM weight),
    doc AS (SELECT row_number() OVER () AS nr, doc_id, {words('text')} AS ws FROM documents),
    word AS (SELECT nr, unnest(ws) AS term, unnest(range(len(ws))) AS i FROM doc),
    passage AS (SELECT DISTINCT nr, term, i // {HALF} - d AS k FROM word, (VALUES (0), (1)) t(d) WHERE i // {HALF} >= d),
    score AS (SELECT nr, k, place, piece, sum(v) AS score FROM passage p JOIN impact m ON m.term = p.term GROUP BY ALL HAVING sum(v) >= {THRESHOLD - 1e-9}),
    hit AS (SELECT nr, k, place, max(score) AS score FROM score GROUP BY ALL),
    around AS (SELECT h.nr, h.place, h.score, ws[greatest(0, (k - 1) * {HALF}) + 1:(k + 1) * {HALF} + {PASSAGE}] AS ws FROM hit h JOIN doc ON doc.nr = h.nr),
    gram AS (SELECT nr, place, score, flatten([{', '.join(cut('ws', w) for w, _ in WIDTHS)}]) AS gs FROM around),
    seen AS (SELECT nr, place, max(score) AS score, list_distinct(flatten(list(gs))) AS seen FROM gram GROUP BY nr, place),
    found AS (SELECT nr, item_id, score, {shared('qs')} AS question_overlap, {shared('az')} AS answer_overlap FROM seen JOIN told ON told.place = seen.place)
    SELECT doc_id, item_id, round(score, 6) AS score, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap FROM found JOIN doc ON doc.nr = found.nr WHERE question_overlap >= {QUESTION} AND answer_overlap >= {ANSWER}"""


ORACLE_SQL = {"op2_benchmark_leaks": oracle()}
