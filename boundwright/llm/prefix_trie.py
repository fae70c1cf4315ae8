"""A trie of conversations by their turns, from sorted matrices of turn ids, shard by shard.

A turn's id is the 128-bit digest of its role and text. Conversations are arrays of ids, dealt to shards by ranges of (ids,
conversation), so that neither a common first turn nor a thousand equal conversations are one task, and the members of
every node lie in one shard or in shards that follow each other. In a shard, turns become the rows of padded matrices of
STRIP columns: a lexsort orders them, masks of changed columns, accumulated by OR, mark where nodes start, and reduceat sums
up each depth's nodes. Rows that go on meet in the next strip, so a long conversation widens no matrix.

A shard also sees the last row before it and the first one after it. Thus it knows which of its nodes are shared with
another shard: only nodes on the path of its first or its last row. For those it gives partial sums that add
up (a node counts where it starts, a leaf where its last member lies); they are recombined by their digest, and
their children take the parent's id from there. All other nodes are complete in their shard.

Defined results: rows without conv_id belong to no conversation and are left out; rows of one turn are ordered by
role, then by the MD5 of role and text; a null turn comes first; a null role or text is empty; repeated rows are turns of their own; equal
conversations share all nodes; an empty table gives no nodes; texts of any length are read whole; columns besides the
four are not read, whatever their names. The ids of a conversation (16 bytes a turn and 8 for its words) are one row, which Spark holds to 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table, written

#: Columns of a matrix, turns of a shard, and conversation ids that are handed on at a time.
STRIP, SHARD, PIECE = 32, 400_000, 1 << 12
EMPTY = hashlib.sha256().hexdigest()
#: In shard_nodes: complete (its parent too), complete below a shared node, shared, and a piece of a shared node's ids.
WHOLE, BELOW, SHARED, ENDS = range(4)
NODES = "kind int, shard int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, node binary, parent binary, piece int, ends string"


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids, words: each conversation's turns in order."""
    filled = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    turn = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", turn.alias("id"), words_in(F.col("text")).alias("words"))
    return filled.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("r")).select("conv_id", F.col("r.id").alias("ids"), F.col("r.words").alias("words"))


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first crc32(conv_id) % most turns are those of the first conversation of their group of ids."""
    head = F.crc32(F.col("conv_id").cast("string")) % most
    first = lambda c: F.slice(c, 1, most - 1)
    bases = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), first("ids").alias("base_ids"), first("words").alias("base_words"))
    met = own.join(bases, F.col("conv_id") - F.col("conv_id") % group == F.col("base"), "left").withColumn("h", head.cast("int"))

    def joined(c: str) -> Column:
        none = F.array().cast(own.schema[c].dataType)
        after = F.when(F.size(c) > F.col("h"), F.slice(c, F.col("h") + 1, F.size(c))).otherwise(none)
        return F.concat(F.slice(F.coalesce(f"base_{c}", none), F.lit(1), F.col("h")), after)

    return met.select("conv_id", joined("ids").alias("ids"), joined("words").alias("words"))


def shards(rows: DataFrame) -> DataFrame:
    """The conversations (conv_id, ids, words) in shards, each with the last row before it (side -1) and the first after it (side 1)."""
    turns = rows.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // SHARD + 1)
    dealt = written(rows.repartitionByRange(parts, "ids", "conv_id").select("*", F.spark_partition_id().alias("shard"), F.lit(0).alias("side")), "shards")
    row = F.struct("ids", "conv_id", "words")
    ends = dealt.groupBy("shard").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    there = sorted(r.shard for r in dealt.select("shard").distinct().collect())  # as many numbers as there are shards
    if len(there) < 2:
        return dealt
    after = F.create_map(*(F.lit(x) for pair in zip(there, there[1:], strict=False) for x in pair))
    before = F.create_map(*(F.lit(x) for pair in zip(there[1:], there, strict=False) for x in pair))
    seen = lambda way, at, side: ends.select(way[F.col("shard")].alias("shard"), F.lit(side).alias("side"), f"{at}.*").filter("shard IS NOT NULL")
    return dealt.unionByName(seen(after, "last", -1)).unionByName(seen(before, "first", 1))


def common(a: list[bytes], b: list[bytes]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class Trie:
    """The nodes of one shard's conversations, in order of depth: parent (a node), row (a member), words, n, least, ends (a node of each row)."""

    def __init__(self, convs: np.ndarray, ids: list[np.ndarray], words: list[np.ndarray]):
        lengths = np.array([len(x) for x in ids])
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([np.asarray(x, dtype=object) for x in ids]) if lengths.sum() else np.empty(0, dtype=object)
        turn = np.frombuffer(b"".join(flat), dtype=">u8").reshape(-1, 2)
        # Ids by number, in the order of their bytes.
        order = np.lexsort((turn[:, 1], turn[:, 0]))
        new = np.r_[False, (turn[order][1:] != turn[order][:-1]).any(1)] if len(order) else np.empty(0, bool)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new)
        count = np.concatenate([np.asarray(x, dtype=np.int64) for x in words]) if len(order) else np.empty(0, np.int64)

        self.parent, self.row, self.words, self.n, self.least, self.depth = ([x] for x in (np.array([-1]), np.array([0]), np.array([0]), np.array([len(convs)]), np.array([convs.min()]), np.array([0])))
        self.ends = np.zeros(len(convs), dtype=np.int64)
        made, rows = 1, np.flatnonzero(lengths > 0)
        for base in range(0, int(lengths.max(initial=0)), STRIP):
            rows = rows[lengths[rows] > base]
            width = np.minimum(lengths[rows] - base, STRIP)
            at = starts[rows, None] + base + np.arange(STRIP)
            inside = np.arange(STRIP) < width[:, None]
            matrix = np.where(inside, number[np.minimum(at, len(number) - 1)], -1)
            order = np.lexsort((convs[rows], *matrix.T[::-1], self.ends[rows]))
            rows, matrix = rows[order], matrix[order]
            group = self.ends[rows]
            changed = np.ones((len(rows), STRIP + 1), dtype=bool)
            changed[1:, 0] = group[1:] != group[:-1]
            changed[1:, 1:] = matrix[1:] != matrix[:-1]
            np.logical_or.accumulate(changed, axis=1, out=changed)
            for j in range(STRIP):
                runs = np.flatnonzero(changed[:, j + 1])
                real = matrix[runs, j] >= 0
                if not real.any():
                    break
                first = rows[runs[real]]
                self.parent.append(self.ends[first])
                self.row.append(first)
                self.words.append(count[starts[first] + base + j])
                self.n.append(np.diff(np.r_[runs, len(rows)])[real])
                self.least.append(np.minimum.reduceat(convs[rows], runs)[real])
                self.depth.append(np.full(len(first), base + j + 1))
                own = np.where(real, made - 1 + np.cumsum(real), -1)
                member = matrix[:, j] >= 0
                self.ends[rows[member]] = np.repeat(own, np.diff(np.r_[runs, len(rows)]))[member]
                made += len(first)
        self.levels = np.cumsum([0, *map(len, self.parent)])
        for name in ("parent", "row", "words", "n", "least", "depth"):
            setattr(self, name, np.concatenate(getattr(self, name)).astype(np.int64))

    def path(self, row: int) -> list[int]:
        """The nodes from the root to a row's last."""
        out = [int(self.ends[row])]
        while out[-1]:
            out.append(int(self.parent[out[-1]]))
        return out[::-1]

    def below(self, own: np.ndarray) -> np.ndarray:
        """Sums of a number of each node over its subtree."""
        total = own.astype(np.int64)
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(total, self.parent[a:b], total[a:b])
        return total


def digests(ids: list[bytes], depth: int) -> list[bytes]:
    """What tells the nodes of depth 0 to depth apart in other shards."""
    chain, out = hashlib.md5(), []
    for d in range(depth + 1):
        out.append(chain.digest())
        if d < depth:
            chain.update(ids[d])
    return out


def pieces(convs: np.ndarray) -> Iterator[str]:
    """The ids, ascending and joined by commas, in pieces."""
    ordered = np.sort(convs)
    for at in range(0, len(ordered), PIECE):
        yield ",".join(map(str, ordered[at : at + PIECE].tolist()))


def shard_nodes(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard and its neighbours' nearest rows, as NODES has it."""
    sides = frame["side"].to_numpy()
    rows = frame[sides == 0].reset_index(drop=True)
    convs, ids = rows["conv_id"].to_numpy(dtype=np.int64), [list(x) for x in rows["ids"]]
    trie = Trie(convs, ids, rows["words"].tolist())
    size, shard = len(trie.parent), int(frame["shard"].iloc[0])
    in_order = lambda i: (ids[i], convs[i])
    first, last = min(range(len(ids)), key=in_order), max(range(len(ids)), key=in_order)
    neighbour = {side: list(frame["ids"].iloc[int(np.flatnonzero(sides == side)[0])]) if (sides == side).any() else None for side in (-1, 1)}
    before = common(neighbour[-1], ids[first]) if neighbour[-1] is not None else -1
    after = common(ids[last], neighbour[1]) if neighbour[1] is not None else -1

    begun, goes_on = trie.path(first)[: before + 1], trie.path(last)[: after + 1]
    key = dict(zip(begun, digests(ids[first], before), strict=True)) | dict(zip(goes_on, digests(ids[last], after), strict=True))
    begins, shared = np.ones(size, dtype=bool), np.zeros(size, dtype=bool)
    begins[begun] = False
    shared[list(key)] = True

    children = np.bincount(trie.parent[1:], weights=begins[1:], minlength=size).astype(np.int64)
    leaf = np.bincount(trie.parent[1:], minlength=size) == 0
    if after == len(ids[last]):
        leaf[trie.ends[last]] = False  # its last member, or a child, is in a later shard
    saved = trie.below((trie.n - begins) * trie.words)
    kind = np.where(shared, SHARED, np.where(shared[trie.parent] & (np.arange(size) > 0), BELOW, WHOLE))

    out = pd.DataFrame({"kind": kind, "shard": shard, "depth": trie.depth, "conv_id": trie.least, "n_convs": trie.n, "n_children": children, "n_leaves": trie.below(leaf), "saved_tokens": saved, "words": trie.words})
    out["parent_conv_id"] = pd.array(np.where(trie.parent < 0, 0, trie.least[trie.parent]), dtype="Int64")
    out.loc[kind != WHOLE, "parent_conv_id"] = pd.NA
    out.loc[0, "parent_conv_id"] = pd.NA
    out["node"] = [key.get(i) for i in range(size)]
    out["parent"] = [key.get(p) if p >= 0 else None for p in trie.parent.tolist()]

    ends, more = [EMPTY] * size, []
    order = np.argsort(trie.ends, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(trie.ends[order])) + 1):
        node = int(trie.ends[members[0]])
        if shared[node]:
            more += [{"kind": ENDS, "shard": shard, "depth": int(trie.depth[node]), "node": key[node], "piece": i, "ends": x} for i, x in enumerate(pieces(convs[members]))]
        else:
            whole = hashlib.sha256()
            for i, x in enumerate(pieces(convs[members])):
                whole.update(("," * (i > 0) + x).encode())
            ends[node] = whole.hexdigest()
    out["ends_sha256"] = ends
    if more:
        out = pd.concat([out, pd.DataFrame(more)], ignore_index=True)
    out = out.reindex(columns=[x.split()[0] for x in NODES.split(", ")])
    longs = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "piece"]
    return out.astype(dict.fromkeys(longs, "Int64")).astype({c: object for c in ("node", "parent", "ends", "ends_sha256")}).replace({np.nan: None})


def hashed_ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, ends_sha256 of pieces, sorted by node, shard and piece."""
    node, whole = None, hashlib.sha256()
    for frame in frames:
        out = []
        for key, ends in zip(frame["node"], frame["ends"], strict=True):
            if key == node:
                whole.update(b",")
            else:
                if node is not None:
                    out.append((node, whole.hexdigest()))
                node, whole = key, hashlib.sha256()
            whole.update(ends.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, whole.hexdigest())], columns=["node", "ends_sha256"])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(conversations: DataFrame) -> DataFrame:
    """COLUMNS of every node of the trie of conversations (conv_id, ids, words)."""
    made = written(shards(conversations).groupBy("shard").applyInPandas(shard_nodes, NODES), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = made.filter(F.col("kind") == SHARED)
    joined = shared.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    ends = made.filter(F.col("kind") == ENDS).select("node", "shard", "piece", "ends").repartition("node").sortWithinPartitions("node", "shard", "piece")
    ends = ends.mapInPandas(hashed_ends, "node binary, ends_sha256 string")
    joined = written(joined.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "shared")
    above = joined.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    recombined = joined.join(above, "parent", "left").select(*COLUMNS)
    # A shard's own copy of the parents' ids: by shard, none of them is a hot key.
    named = shared.select("node", "shard").join(joined.select("node", F.col("conv_id").alias("parent_conv_id")), "node").withColumnRenamed("node", "parent")
    below = made.filter(F.col("kind") == BELOW).drop("parent_conv_id").join(named, ["shard", "parent"]).select(*COLUMNS)
    return made.filter(F.col("kind") == WHOLE).select(*COLUMNS).union(below).union(recombined)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    bounded_batches(spark)
    own = written(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "sequences")
    return nodes(rebuilt(own))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
