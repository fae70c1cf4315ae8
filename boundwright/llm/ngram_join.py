"""Jaccard join of whole documents on their 3-word shingles, by prefixes of tokens and of token combinations.

A document's set are the hashes of its distinct shingles. Two sets link when 100 times their intersection is at least
SHARE times their union. In a set of n tokens at most n // 10 are missing from a linked one, so two linked sets in
one order of all tokens share a token among the first n // 10 + 1 of each.

1. Equal sets are one, however many documents have them.
2. Tokens are taken in order of their hashes, which needs no count of all tokens, and counted where they are among the first of
   a set. Tokens that up to RARE sets have are indexed alone. Commoner ones are dealt to classes, for which combinations of
   k = 2 tokens are indexed, or of 3 beyond OFTEN. A class with m tokens in the prefix counts m - k + 1 of them, as
   k - 1 may be shared without a combination to meet at, and the prefix is extended until n // 10 + 1 are counted. The number of
   classes follows the size of a set; sets of two neighbouring ranges of sizes meet in the classes of the lower.
3. Up to PAIRED sets of a key are paired; of more, each is paired with one of them, the least in a random order of all sets.
4. The sets of large keys that do not all lie in one component by then are indexed anew in the same way, with their
   tokens from the rarest to the commonest of these sets. One drawn for each key meets the others; then, of a key, sets outside of its largest component are paired with those of others,
   unless the parities of their tokens differ in more bits than linked sets may differ in tokens.
5. A candidate is dropped where the first tokens show too many that the other lacks; the rest are verified on whole sets.

So no link between different sets of different components is lost, and pairs do not grow with the square of a group of near copies.

Defined results: a null or empty text or one without words has an empty set, linked with nothing; fewer words than three are
one shingle; equal texts are one component; a null doc_id never names a component that another id is in; repeated rows each get their row; texts are
taken whole; an empty table gives an empty one; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table, written
from boundwright.llm.simhash import PAIRED, SEED, components, connected, shingles

#: Words of a shingle, and hundredths of the union that linked sets share at least.
WIDTH, SHARE = 3, 90
#: Sets of an index that have a token: up to RARE it stands alone, up to OFTEN in pairs, beyond in threes.
RARE, OFTEN = 8, 64


def spare(n: int) -> int:
    """Tokens of a set of n that a linked set may lack."""
    return n - -(-SHARE * n // 100)


#: Longs of a set's parities.
PARITIES = 8


#: The least sizes of ranges such that the larger of two linked sets lies in the range of the smaller or in the next.
LOWS = [1]
while LOWS[-1] < 1 << 40:
    LOWS.append(LOWS[-1] * 100 // SHARE + 1)


def classes(low: int) -> dict[int, int]:
    """Classes of tokens in pairs and in threes, for sets of `low` tokens or more. They may leave k - 1 tokens each uncounted: fewer than such a set has."""
    return {2: max(1, (spare(low) + 1) // 3), 3: max(1, (spare(low) + 1) // 6)}


def reach(n: int) -> int:
    """Tokens at most in an extended prefix of a set of n tokens."""
    deal = classes(LOWS[bisect_right(LOWS, n) - 1])
    return spare(n) + 1 + deal[2] + 2 * deal[3]


def token_set(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, each once and in order."""
    joined, spans = shingles(text, WIDTH)
    if not joined:
        return np.empty(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(spans)))


def leads(texts: pd.Series) -> pd.DataFrame:
    """n: tokens of each set; key: equal for equal sets; lead: the tokens of its extended prefix."""
    sets = [token_set(x) for x in texts]
    return pd.DataFrame({"n": [len(x) for x in sets], "key": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "lead": [x[: reach(max(len(x), 1))].view("<i8") for x in sets]})


def hashed(texts: pd.Series) -> pd.Series:
    return pd.Series([token_set(x).view("<i8") for x in texts])


def fits(n: Column, m: Column, shared: Column) -> Column:
    """Whether sets of n and m tokens link if they have `shared` in common."""
    return (100 + SHARE) * shared >= SHARE * (n + m)


def lacking(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Of each pair of leads, the least hashes of two sets: how many tokens of the first the second lacks, and the other way round."""

    def one(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        x, y = (np.asarray(v).view("<u8") for v in (x, y))
        upto = min(x[-1], y[-1])
        x, y = x[x <= upto], y[y <= upto]
        shared = np.intersect1d(x, y, assume_unique=True).size
        return len(x) - shared, len(y) - shared

    return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=["a", "b"], dtype="int64")


def pruned(pairs: DataFrame, own: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) that sizes and leads allow."""
    sizes = own.select("fp", "n", "lead")
    both = pairs.join(sizes.toDF("a", "n", "x"), "a").join(sizes.toDF("b", "m", "y"), "b").filter(fits(F.col("n"), F.col("m"), F.least("n", "m")))
    both = both.withColumn("lacking", F.pandas_udf(lacking, "a long, b long")("x", "y"))
    most = F.least(F.col("n") - F.col("lacking.a"), F.col("m") - F.col("lacking.b"))
    return written(both.filter(fits(F.col("n"), F.col("m"), most)).select("a", "b"), label)


def verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) whose sets (fp, tokens) link."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.filter(fits(F.size("x"), F.size("y"), shared)).select("a", "b"), label)


def keys_of(tokens: list[tuple[int, int, int]], size: int) -> dict[int, int]:
    """Index keys of a set of `size` tokens, each with how many may be shared by sets that need that key to meet.

    tokens: (place, sets that have it, token), in order of places; what stands at other places no other set has. A set that
    lacks e of this one's tokens meets it before e + 1 tokens are counted, so a key made after c were counted is needed by those
    that share `size` - c at most.
    """
    out, own = {}, bisect_right(LOWS, size) - 1
    for level in {own, max(own - 1, 0)}:
        deal = classes(LOWS[level])
        held, counted, last = defaultdict(list), 0, -1
        for place, many, token in tokens:
            counted, last = counted + place - last - 1, place
            if counted > spare(size):
                break
            if many <= RARE:
                if many > 1:
                    out[token] = max(out.get(token, 0), size - counted)
                counted += 1
                continue
            k = 2 if many <= OFTEN or LOWS[level] < 10 else 3
            members = held[k, token % deal[k]]
            for others in combinations(members, k - 1):
                key = xxhash.xxh64_intdigest(np.array([level, *others, token], dtype="<i8").tobytes(), SEED) - (1 << 63)
                out[key] = max(out.get(key, 0), size - counted)
            members.append(token)
            counted += len(members) >= k
    return out


def index_keys(sets: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([[{"key": k, "left": n} for k, n in keys_of([(t["place"], t["many"], t["token"]) for t in s], size).items()] for s, size in zip(sets, sizes, strict=True)])


def parities(sets: pd.Series) -> pd.DataFrame:
    """64 * PARITIES bits of each set, in longs: whether an odd number of its tokens falls there. Two sets differ in as many tokens as in bits at least."""
    bits = [np.bincount(np.asarray(x).view("<u8") % np.uint64(64 * PARITIES), minlength=64 * PARITIES) & 1 for x in sets]
    longs = np.array([np.packbits(b, bitorder="little").view("<i8") for b in bits]).reshape(-1, PARITIES)
    return pd.DataFrame(longs, columns=[f"b{i}" for i in range(PARITIES)])


def indexed(sets: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, key and left of each set (size, tokens: place, many, token in order)."""
    keys = F.pandas_udf(index_keys, "array<struct<key: long, left: int>>")("tokens", "size")
    return sets.select(*columns, "size", F.explode(keys).alias("k")).select(*columns, "size", "k.*")


def meetings(own: DataFrame) -> DataFrame:
    """(key, fp, size, left, n, centre) of the sets (fp, n, lead) whose key n > 1 of them have; centre (fp, size, left): the first of those in an order of all sets."""
    tokens = own.select("fp", F.col("n").alias("size"), F.posexplode("lead").alias("place", "token"))
    counts = written(tokens.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1"), "counts")
    met = tokens.join(counts, "token").groupBy("fp", "size").agg(F.sort_array(F.collect_list(F.struct("place", "many", "token"))).alias("tokens"))
    index = written(indexed(met, ["fp"]), "keys")
    first = F.min(F.struct(F.xxhash64("fp").alias("order"), "fp", "size", "left")).alias("centre")
    shared = written(index.groupBy("key").agg(F.count("*").alias("n"), first).filter("n > 1"), "shared")
    return written(index.join(shared, "key"), "met")


def candidates(met: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of small keys, and each set of a large one with its centre, that may link as far as their keys tell."""
    few = met.filter(F.col("n") <= PAIRED).select("key", "fp", "size", "left")
    other = few.select("key", *(F.col(c).alias(f"other_{c}") for c in ("fp", "size", "left")))
    pairs = few.join(other, "key").filter("fp < other_fp").drop("key")
    many = met.filter((F.col("n") > PAIRED) & (F.col("fp") != F.col("centre.fp"))).select("fp", "size", "left", *(F.col(f"centre.{c}").alias(f"other_{c}") for c in ("fp", "size", "left")))
    near = pairs.unionByName(many).filter(fits(F.col("size"), F.col("other_size"), F.least("left", "other_left")))
    return near.select(F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b")).distinct()


def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (fp) with the root of the component that the links found put each set in."""
    return rows.join(connected(found).toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def alike(bits: list[str]) -> Column:
    """Whether a pair of index rows (size, left, parities; the second's as other_...) may link."""
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in bits), F.lit(0))
    near = (100 + SHARE) * differ <= (100 - SHARE) * (F.col("size") + F.col("other_size"))
    return (F.col("root") != F.col("other_root")) & fits(F.col("size"), F.col("other_size"), F.least("left", "other_left")) & near


def apart(met: DataFrame, near: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and candidates for all further links, between sets (fp, tokens) of large keys that the links in near do not join.

    In the new index each set of a key first meets one of them, drawn anew for each key, and what that links joins
    components: a true pair would meet at every key that it shares.
    """
    many = written(rooted(met.filter(F.col("n") > PAIRED).select("key", "fp"), near), "many")
    unsettled = many.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    members = written(many.join(unsettled, "key", "left_semi").select("fp", "root").distinct(), "members")
    bits = [f"b{i}" for i in range(PARITIES)]
    odd = F.pandas_udf(parities, ", ".join(f"{b} long" for b in bits))("tokens").alias("p")
    parity = written(sets.join(members, "fp").select("fp", odd).select("fp", "p.*"), "parities")
    token = written(sets.join(members, "fp").select("fp", "root", F.explode("tokens").alias("token")), "tokens")
    counts = written(token.groupBy("token").agg(F.count("*").alias("many")), "counts")
    ordered = token.join(counts, "token").groupBy("fp", "root").agg(F.sort_array(F.collect_list(F.struct("many", "token"))).alias("all"))
    placed = F.transform("all", lambda t, i: F.struct(i.alias("place"), t["many"].alias("many"), t["token"].alias("token")))
    ordered = ordered.select("fp", "root", F.size("all").alias("size"), F.filter(placed, lambda t: t["many"] > 1).alias("tokens"))
    index = written(indexed(ordered, ["fp", "root"]).join(parity, "fp"), "index")
    own = ("fp", "root", "size", "left", *bits)
    drawn = F.min(F.struct(F.xxhash64("fp", "key").alias("order"), *own)).alias("c")
    centre = written(index.groupBy("key").agg(drawn, F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key", *(F.col(f"c.{c}").alias(f"other_{c}") for c in own)), "centres")
    pair = (F.least("fp", "other_fp").alias("a"), F.greatest("fp", "other_fp").alias("b"))
    starred = verified(index.join(centre, "key").filter(alike(bits)).select(*pair).distinct(), sets, "links-centre")
    index = written(rooted(index.drop("root"), near.union(starred)), "rerooted")
    largest = index.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).getField("root").alias("largest"), F.count("*").alias("roots"))
    largest = written(largest.filter("roots > 1").drop("roots"), "largest")
    outside = written(index.join(largest, "key").filter("root != largest").drop("largest"), "outside")
    other = index.select("key", *(F.col(c).alias(f"other_{c}") for c in own))
    return starred, outside.join(other, "key").filter(alike(bits)).select(*pair).distinct()


def links(own: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), a < b: links between the sets (fp, n, lead), enough to join all that are linked. texts: (fp, text)."""
    met = meetings(own.filter("n > 1"))
    pairs = pruned(candidates(met), own, "candidates")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).union(met.filter(F.col("n") > PAIRED).select("fp")).distinct()
    sets = written(texts.join(nodes, "fp").select("fp", F.pandas_udf(hashed, "array<long>")("text").alias("tokens")), "sets")
    near = verified(pairs, sets, "links-near")
    starred, rest = apart(met, near, sets)
    return near.union(starred).union(verified(pruned(rest, own, "candidates"), sets, "links-apart"))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    # A row's place names its text; the place of a set's first text names the set.
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at"))
    marked = written(placed.select("doc_id", "at", F.pandas_udf(leads, "n long, key binary, lead array<long>")("text").alias("s")).select("doc_id", "at", "s.*"), "leads")
    own = marked.filter("n > 0").groupBy("key").agg(F.min("at").alias("fp"), F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("lead").alias("lead"))
    own = written(own, "own")
    found = components(own.select("fp", "id"), lambda _: links(own, placed.select(F.col("at").alias("fp"), "text")))
    named = written(own.join(found, "fp").select("key", "component"), "named")
    out = marked.select("doc_id", "n", "key").join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op13_ngram_join": op13_ngram_join}
