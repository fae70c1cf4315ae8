"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, one per majority over the hashes of a text's 3-word shingles. Two
fingerprints link at MAX_BITS or fewer differing bits. Cut into SEGMENTS segments, one segment of a
linked pair differs by at most one bit, so the pair meets in that segment's signature with the bit in
question deleted:

* differing by one bit: one side has a 0 and the other a 1 at the deleted place, so 0s join 1s by equality;
* equal segments: the rest of the bits differ by at most MAX_BITS, and the same cut is made once more,
  within the rest, together with the equal segment.

Every candidate is verified, and only links are kept. Signatures are made for distinct fingerprints, so
copies cost one row, and all keys hold at least 47 of the 64 bits: a key's bucket holds only
fingerprints of that one neighbourhood.

`survivors`, a stage of the corpus pipeline, asks for more than that: texts link at a Jaccard similarity of
SIMILAR or more of their sets of WIDTH-word shingles. The deletion variants of fingerprints over those shingles give
a part of the candidates. Fingerprints of texts at SIMILAR lie up to 14 bits apart and more, for which keys of
deletion variants would hold 8 bits, so bands of minimum hashes give the others (a pair at SIMILAR
misses all of them once in 60,000 times). Every candidate is verified on both whole sets:

* equal sets count as one, however many texts have them;
* sets that share a band's key are all paired if they are PAIRED or fewer. Of more, each is first paired with one
  of them, drawn anew for each key. Where that leaves a key's sets in several components, all links between those are
  found by prefixes: with the shingles of each set from the rarest to the commonest, two similar sets share one
  of their first few, early enough in both. For a shingle that many of them hold, only sets outside of
  its largest component are paired with others. So no link is lost, and pairs do not grow with the square of a group
  of copies.

Defined results: null and empty texts have no words, thus the fingerprint zero and one and the same empty set; equal
texts are one group; a null doc_id is greater than all others, so it never names a group that has another; repeated rows
stand for one; texts of any length are hashed SLICE shingles at a time; an empty table gives an empty one;
`survivors` returns the columns it was given, whatever their names, and the query reads doc_id and text alone.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table, written

SHINGLE, SEED, MAX_BITS, SEGMENTS = 3, 42, 2, 2
#: What links texts in the stage, and how its candidates are found.
WIDTH, SIMILAR, BANDS, BAND_ROWS, PAIRED = 5, 0.8, 28, 5, 8
#: Shingles whose bits are counted at a time.
SLICE = 1 << 14
LAST = (1 << 63) - 1


def shingles(text: str | None, width: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The lower-cased words of a text, and where its shingles start and end in them; fewer words than width are one shingle."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(x + 1 for x in ends[:-1])]
    return joined, list(zip(starts, ends[width - 1 :], strict=False)) or [(0, len(joined))]


def majority(text: str | None) -> int:
    """The fingerprint of a text as a signed 64-bit integer; no words: zero."""
    joined, spans = shingles(text, SHINGLE)
    if not joined:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority_of(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(spans)))


def majority_of(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed integer."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        some = np.ascontiguousarray(hashes[at : at + SLICE])
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | Column) -> Column:
    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(x) for x in texts], dtype="int64")

    return bits(text)


def signatures(prints: DataFrame) -> DataFrame:
    """(key, side, fp): side is the deleted bit, 2 in a key without one. Keys are a kind in 16 bits and a value of up to 48."""
    parts = prints.selectExpr("fp", "fp & 4294967295 AS low", "shiftrightunsigned(fp, 32) AS high").selectExpr(
        "fp", "explode(array(named_struct('s', 0, 'own', low, 'other', high), named_struct('s', 1, 'own', high, 'other', low))) AS p"
    ).select("fp", "p.*")
    deleted = (
        "transform(sequence(0, 31), i -> named_struct("
        "'key', shiftleft(CAST(32 * s + i AS BIGINT), 48) | (own & ~shiftleft(1L, i)),"
        "'side', CAST(shiftrightunsigned(own, i) & 1 AS INT)))"
    )
    halves = "transform(sequence(0, 33), x -> named_struct('h', CAST(x DIV 17 AS INT), 'i', CAST(x % 17 AS INT))) AS halves"
    equal = (
        "transform(halves, x -> CASE WHEN x.i = 16"
        " THEN named_struct('key', shiftleft(CAST(128 + 2 * s + x.h AS BIGINT), 48) | shiftleft(own, 16) | part[x.h], 'side', 2)"
        " ELSE named_struct('key', shiftleft(CAST(64 + 32 * s + 16 * x.h + x.i AS BIGINT), 48) | shiftleft(own, 16) | (part[x.h] & ~shiftleft(1L, x.i)),"
        " 'side', CAST(shiftrightunsigned(part[x.h], x.i) & 1 AS INT)) END)"
    )
    ready = parts.selectExpr("fp", "s", "own", "array(other & 65535, shiftrightunsigned(other, 16)) AS part", halves)
    return ready.selectExpr("fp", f"inline(concat({deleted}, {equal}))")


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: the distinct pairs of distinct fingerprints (column fp) that differ by at most MAX_BITS bits."""
    # Each row becomes 132, so the few bytes of all fingerprints are dealt to many tasks, round about: a partitioning
    # by fp would be that of distinct(), which is merged into few tasks.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = signatures(prints.select("fp").distinct().repartition(parts))
    zeros = rows.filter("side != 1").selectExpr("key", "fp AS x")
    ones = rows.filter("side != 0").selectExpr("key", "fp AS y")
    # Spark sizes what is made of a row as one row, and would broadcast 66 times what it takes for small.
    near = zeros.hint("merge").join(ones.hint("merge"), "key").filter(f"bit_count(x ^ y) BETWEEN 1 AND {MAX_BITS}")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the pairs (a, b); root: the least node reachable.

    Large and small stars in turn: each node's neighbours are hung on the least of them, until the stars
    stay as they are. Rounds grow with the logarithm of the longest path; each ends in a written table.
    """
    edges = written(pairs.select("a", "b"), "edges")
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).filter("a != b").distinct()
        edges = written(small.select("a", "b"), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def components(rows: DataFrame, pairs=links) -> DataFrame:
    """(fp, component) of each distinct fingerprint of rows (id, fp); component: the least id of the fingerprints reachable by pairs."""
    own = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "own")
    roots = connected(pairs(own)).select(F.col("node").alias("fp"), "root")
    rooted = written(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    linked = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return written(rooted.join(written(linked, "least"), "root").select("fp", "component"), "components")


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's WIDTH-word shingles, each once and in order."""
    joined, spans = shingles(text, WIDTH)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(spans)))


DRAW = np.random.default_rng(SEED)
FLIPS, FACTORS, MIX = (DRAW.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1) for n in (BANDS * BAND_ROWS, BANDS * BAND_ROWS, BAND_ROWS))
STARTS = DRAW.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: its BAND_ROWS minimum hashes in one number."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), SLICE >> 4):
        some = hashes[at : at + (SLICE >> 4)] ^ FLIPS[:, None]
        some *= FACTORS[:, None]
        np.minimum(least, some.min(1), out=least)
    return ((least.reshape(BANDS, BAND_ROWS) * MIX).sum(1, dtype=np.uint64) + STARTS).view("<i8")


def banded(texts: pd.Series) -> pd.DataFrame:
    """fp: a hash of the whole set, so that equal sets are one; print: its fingerprint; keys: of its bands."""
    sets = [shingle_set(x) for x in texts]
    own = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype="<u8").view("<i8")
    return pd.DataFrame({"fp": own, "print": [majority_of(x) for x in sets], "keys": [band_keys(x) for x in sets]})


def hashed(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(x).view("<i8") for x in texts])


def similar(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two sets of hashes have a Jaccard similarity of SIMILAR or more."""
    shared = [np.intersect1d(x, y, assume_unique=True).size for x, y in zip(left, right, strict=True)]
    return pd.Series([n / (len(x) + len(y) - n) >= SIMILAR for n, x, y in zip(shared, left, right, strict=True)], dtype=bool)


def meetings(keys: DataFrame) -> DataFrame:
    """(key, fp, n, centre) of the rows (fp, key) whose key n > 1 of them have; centre: one of those, drawn anew for each key."""
    drawn = F.min(F.struct(F.xxhash64("fp", "key").alias("order"), "fp")).getField("fp").alias("centre")
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n"), drawn).filter("n > 1"), "shared")
    return written(keys.join(shared, "key"), "met")


def candidates(met: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of small groups, and each member of a large one with its centre."""
    few = met.filter(F.col("n") <= PAIRED).select("key", "fp")
    paired = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b").select("a", "b")
    starred = met.filter((F.col("n") > PAIRED) & (F.col("fp") != F.col("centre"))).select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    return paired.union(starred).distinct()


def variant_candidates(own: DataFrame) -> DataFrame:
    """(a, b), a < b: of sets (fp, print), those with equal fingerprints, each with the least of them, and the least of linked fingerprints."""
    least = written(own.groupBy("print").agg(F.min("fp").alias("centre")), "prints")
    equal = own.join(least, "print").filter("fp != centre").select(F.col("centre").alias("a"), F.col("fp").alias("b"))
    pairs = links(least.select(F.col("print").alias("fp")))
    one, two = (least.select(F.col("print").alias(k), F.col("centre").alias(f"of_{k}")) for k in "ab")
    near = pairs.join(one, "a").join(two, "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return equal.union(near)


def apart(met: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates for all links within large groups between nodes that roots (node, root) do not join. sets: (fp, hashes).

    Of two sets with a Jaccard similarity of SIMILAR or more, sorted alike, the first shingle that they share lies
    among the first `reach` of each, and what follows it in both is enough for what they must share.
    """
    many = met.filter(F.col("n") > PAIRED).select("key", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    many = written(many, "many")
    unsettled = many.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    members = written(many.join(unsettled, "key", "left_semi").select("fp", "root").distinct(), "members")
    shingle = written(sets.join(members, "fp").select("fp", "root", F.explode("hashes").alias("shingle")), "shingles")
    common = shingle.groupBy("shingle").agg(F.count("*").alias("many"))
    rarest = shingle.join(common, "shingle").groupBy("fp", "root").agg(F.sort_array(F.collect_list(F.struct("many", "shingle"))).alias("all"))
    size = F.size("all")
    reach = size - F.ceil(F.lit(SIMILAR) * size - F.lit(1e-9)) + 1
    prefix = rarest.select("fp", "root", size.alias("size"), F.posexplode(F.slice("all", F.lit(1), reach.cast("int"))).alias("place", "s"))
    prefix = written(prefix.filter("s.many > 1").select("fp", "root", "size", "place", F.col("s.shingle").alias("shingle")), "prefixes")
    # A table, so that the join below is dealt out anew and a frequent shingle can be split.
    largest = prefix.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "root")).getField("root").alias("largest"))
    largest = written(largest, "largest")
    outside = written(prefix.join(largest, "shingle").filter("root != largest").drop("largest"), "outside")
    other = prefix.select("shingle", *(F.col(c).alias(f"other_{c}") for c in ("fp", "root", "size", "place")))
    left = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    needed = F.lit(SIMILAR / (1 + SIMILAR)) * (F.col("size") + F.col("other_size")) - F.lit(1e-9)
    near = outside.join(other, "shingle").filter((F.col("root") != F.col("other_root")) & (left >= needed))
    return near.select(F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The candidates (a, b) whose sets (fp, hashes) are similar."""
    left, right = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    sizes = F.least(F.size("x"), F.size("y")) >= F.lit(SIMILAR) * F.greatest(F.size("x"), F.size("y"))
    both = pairs.join(left, "a").join(right, "b").filter(sizes)
    return written(both.filter(F.pandas_udf(similar, "boolean")("x", "y")).select("a", "b"), f"links-{label}")


def similar_links(own: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), a < b: links between sets (fp, print, keys, at). texts: (at, text)."""
    met = meetings(written(own.select("fp", F.explode("keys").alias("key")), "bands"))
    pairs = written(candidates(met).union(variant_candidates(own.select("fp", "print"))).distinct(), "candidates")
    # Whoever is in a candidate or a large group is in one of these pairs, so each text is hashed again once at most.
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    chosen = own.select("fp", "at").join(nodes.hint("merge"), "fp", "left_semi")
    sets = written(texts.join(chosen, "at").select("fp", F.pandas_udf(hashed, "array<long>")("text").alias("hashes")), "sets")
    first = verified(pairs, sets, "near")
    return first.union(verified(apart(met, connected(first), sets), sets, "apart"))


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each component of similar texts, that of the least doc_id (a null one counts as greater than all), with the columns docs had.

    Of several rows with that id one stays: of the least set, then of the first place in the table as it was written.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    marked = docs.select(F.struct(*names).alias("row"), F.pandas_udf(banded, "fp long, print long, keys array<long>")("text").alias("b"), F.coalesce("doc_id", F.lit(LAST)).alias("id"))
    marked = written(marked.select("row", "id", "b.*", F.monotonically_increasing_id().alias("at")), "shingled")
    own = written(marked.select("fp", "print", "keys", "at").dropDuplicates(["fp"]), "own")
    kept = components(marked.select("id", "fp"), lambda _: similar_links(own, marked.select("at", "row.text")))
    # The winners are chosen without their texts, which then meet one semi join.
    winners = marked.select("id", "fp", "at").join(kept, "fp").groupBy("component").agg(F.min(F.struct("id", "fp", "at")).alias("w"))
    return marked.join(winners.select("w.at"), "at", "left_semi").select("row.*")


def op3_deletion_variants(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null ids have no say in a component's id."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    prints = written(docs.select(F.col("doc_id").alias("id"), fingerprint("text").alias("fp")), "fingerprints")
    named = prints.join(components(prints), "fp")
    return named.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op3_deletion_variants": op3_deletion_variants}
