"""Byte-level BPE encoding and decoding.

The merges of each pre-token run over a segment tree: its leaves are the byte positions, a leaf holds
the rank of the pair that starts there together with the position, and a node holds the least of its
children, so the root is the leftmost pair of the lowest rank. A merge joins two live neighbours and
changes at most three leaves (the merged pair, the pair that begins at its right half, the pair before),
each a point update of logarithmic cost. Pre-tokens of one size class are merged together, one row of an
array each; longer ones take the same tree one at a time.

Spark deals out the documents; nothing is shuffled. A worker keeps the ids of the chunks it met, in a
dictionary of bounded size. Texts are cut into chunks where no match of the pattern CUTTABLE spans the cut; with any other
pattern a whole text is one chunk.

Defined results: a null text has no ids (as an empty one); decoding a null or empty list gives no bytes;
ids outside the vocabulary make decoding fail with a KeyError; texts of any length are encoded whole, and long
chunks are not remembered; repeated rows each get their row; an empty table gives an empty one; `encoded` refuses
to overwrite columns, whose names are parameters; `digests` reads doc_id and text alone.
"""

from __future__ import annotations

import base64
import re
import sys
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table

#: Chunks and pre-tokens whose ids a worker remembers; when more come, it forgets all but the CACHE // 2 it met first.
CACHE = 700_000
#: Texts that are cut into chunks at a time.
HELD = 200
#: Pre-tokens up to this many bytes are merged many at a time.
WIDEST = 64
#: The pattern that `chunks` is made for.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 62


class Vocabulary:
    """Ranks of a public byte-level vocabulary; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern, self.cuttable = regex.compile(pattern), pattern == CUTTABLE
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.cache: dict[str, bytes] = {}
        pairs = {}
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                left, right = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where the pair is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids of words of at most `width` bytes (a power of two), merged side by side, as the bytes of 32-bit integers."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        place = np.arange(width, dtype=np.int64)
        live = place < length[:, None]
        ids = np.where(live, self.single[raw], -1)
        after = np.where(place + 1 < length[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        rank[~live[:, 1:]] = NONE
        tree[:, width : 2 * width - 1] = np.where(rank == NONE, NONE, rank * width + place[:-1])
        for level in range(width.bit_length() - 2, -1, -1):
            low = 1 << level
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while rows.size:
            best = tree[rows, 1]
            at, merged = best % width, best // width
            right = after[rows, at]
            beyond = after[rows, right]
            ids[rows, at], ids[rows, right] = merged, -1
            after[rows, at] = beyond
            inner = beyond < width
            before[rows[inner], beyond[inner]] = at[inner]
            leaf = np.full((rows.size, 3), NONE, dtype=np.int64)
            where = np.stack((at, right, np.maximum(before[rows, at], 0)), axis=1)
            got = self.pair_rank(merged[inner], ids[rows[inner], beyond[inner]])
            leaf[inner, 0] = np.where(got == NONE, NONE, got * width + at[inner])
            first = before[rows, at] >= 0
            back = where[first, 2]
            got = self.pair_rank(ids[rows[first], back], merged[first])
            leaf[first, 2] = np.where(got == NONE, NONE, got * width + back)
            where[~first, 2], leaf[~first, 2] = at[~first], leaf[~first, 0]
            node, row = where + width, rows[:, None]
            tree[row, node] = leaf
            while node[0, 0] > 1:
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            rows = rows[tree[rows, 1] != NONE]
        kept = ids >= 0
        flat = ids[kept].astype(np.int32).tobytes()
        ends = np.cumsum(4 * kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one long pre-token, by the same tree."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, pairs = int(NONE), self.pairs
        rank = lambda a, b: none if (r := pairs.get(ids[a] << 32 | ids[b])) is None else r * width + a
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = rank(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] != none:
            merged, at = divmod(tree[1], width)
            right = after[at]
            beyond = after[right]
            ids[at], ids[right], after[at] = merged, -1, beyond
            put(right, none)
            if beyond < n:
                before[beyond] = at
            put(at, rank(at, beyond) if beyond < n else none)
            if before[at] >= 0:
                put(before[at], rank(before[at], at))
        return [x for x in ids if x >= 0]

    def merge(self, words: set[str]) -> None:
        """Put the ids of each pre-token into the cache, as the bytes of 32-bit integers."""
        cache, ranks = self.cache, self.ranks
        classes: dict[int, tuple[list[str], list[bytes]]] = {}
        for text in words:
            word = text.encode()
            if (whole := ranks.get(word)) is not None:
                cache[text] = whole.to_bytes(4, sys.byteorder)
            elif len(word) > WIDEST:
                cache[text] = np.array(self.merge_long(word), dtype=np.int32).tobytes()
            else:
                some = classes.setdefault(1 << (len(word) - 1).bit_length(), ([], []))
                some[0].append(text)
                some[1].append(word)
        for width, (names, some) in classes.items():
            for at in range(0, len(some), 20_000):
                cache.update(zip(names[at : at + 20_000], self.merge_rows(some[at : at + 20_000], width), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers; the chunks of HELD texts are held at once."""
        return [ids for at in range(0, len(texts), HELD) for ids in self.encode_some(texts[at : at + HELD])]

    def encode_some(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE:
            for key in list(islice(cache, CACHE // 2, None)):
                del cache[key]
        chunked = [chunks(x) if self.cuttable else [x] if x else [] for x in texts]
        new = set(chain.from_iterable(chunked)).difference(cache)
        words = {c for c in new if self.cuttable and c[0] == " " and c[1:].isalpha()}  # one match each, without a search
        split = {c: self.pattern.findall(c) for c in new.difference(words)}
        self.merge(words.union(chain.from_iterable(split.values())).difference(cache))
        cache.update((c, b"".join([cache[x] for x in some])) for c, some in split.items() if len(some) > 1)
        ids = [b"".join(map(cache.__getitem__, some)) for some in chunked]
        for c in [x for x in new if len(x) > WIDEST]:  # so that what CACHE of them take is bounded
            for x in (c, *split.get(c, ())):
                if len(x) > WIDEST:
                    cache.pop(x, None)
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


#: A space before more white space, where cutting would change what the pattern matches.
RUN = re.compile(r" \s")
#: A full stop or comma before a space that follows no letter or digit, and so may belong to a longer match.
JOINED = re.compile(r"(?<![^\W_])[.,] ")


def chunks(text: str) -> list[str]:
    """The text cut where no match of the pattern spans the cut: before single spaces, and around most full stops and commas."""
    if not text:
        return []
    if RUN.search(text):
        return runs(text)
    if "\0" in text or JOINED.search(text):
        some = text.replace(" ", "\0 ").split("\0") if "\0" not in text else runs(text)
    else:
        some = text.replace(" ", "\0 ").replace(".\0", "\0.\0").replace(",\0", "\0,\0").split("\0")
    return some if some[0] else some[1:]


def runs(text: str) -> list[str]:
    """The text cut before each space that stands between two other characters than white space."""
    return re.split(r"(?<=\S)(?= \S)", text)


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(text: str | Column, path: str, pattern: str) -> Column:
    """The ids of a text, array<int>; null: none."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = vocabulary(path, pattern)
        return pd.Series([np.frombuffer(x, dtype=np.int32) for x in own.encode(texts.fillna("").tolist())], dtype=object)

    return ids(text)


def decode(ids: str | Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for; null: none."""

    @F.pandas_udf("binary")
    def whole(lists: pd.Series) -> pd.Series:
        own = vocabulary(path, pattern)
        return pd.Series([b"" if x is None else own.decode(x) for x in lists], dtype=object)

    return whole(ids)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The documents with their ids (array<int>) and the bytes those decode to, in two new columns."""
    if clash := {ids.lower(), decoded.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has columns named {', '.join(sorted(clash))}; name others")
    bounded_batches(docs.sparkSession)
    with_ids = docs.withColumn(ids, encode(text, path, pattern))
    return with_ids.withColumn(decoded, decode(ids, path, pattern))


def public() -> tuple[str, str]:
    """The vocabulary and pattern of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = encoded(docs.select("doc_id", "text"), *public())
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Every document encoded by the public ranks and decoded again."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe_round_trip": op10_bpe_round_trip}
