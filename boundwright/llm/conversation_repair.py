"""Repair of conversations: the cheapest edits that give legal turns, by a suffix-shared automaton.

A conversation's rows, by turn, are legal where they are not blank, not repeated and their roles' initials read
`(s?(ua)+)?`. Keep costs 0, Rerole to user or assistant 1, Delete 2 (required for blank and repeated rows), Insert of an empty
turn 5; a truncated row that stays adds 5. Of equally cheap edits the ASCII-least string of initials is taken.

Each row is one symbol: the class of its role's initial, in capitals if truncated, or `x` where it has to go. The
symbols of up to BLOCK rows are a signature. Distinct signatures, whatever conversations have them, are sorted from
their ends, so that signatures with a common suffix lie side by side: the path from the end to the first symbol is a stack,
of which the next signature keeps what it shares. A node of the automaton is a suffix; its cost-to-go and its first
edit in each of the four grammar states are found when it is pushed, once in its shard (a path over a shard's border
is found in both shards). In a state no two edits have one initial, so the initial settles ties, and an audit is read by
following the nodes.

A longer conversation is several blocks. The automaton then gives an audit for each pair of states at a block's ends,
with no insertion at the end of a block that another follows, and those are folded from the last block to the first.

Only initials, digests and counts are shuffled for that. Texts are shuffled once, by conversation, and go in order through a
SHA-256, which reads a conversation in one task by its nature, but holds no more of it than a batch.

Defined results: rows of one turn are ordered by the MD5 of role and text; a null conv_id is a conversation like any
other; a null turn comes first; a null role or text is one space, so such a text is blank; of equal rows
the first stays; an empty table gives an empty one; texts of any length are taken whole; columns besides the
four are not read, whatever their names. A conversation's audit is one string, so it can't exceed 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table, written

#: Rows of a conversation that one signature holds at most.
BLOCK = 512
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The states of the grammar and where an initial leads: the start, after a system turn, after a user's, after an assistant's.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role besides system that each state allows.
WANTED = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
STATES = range(4)
NEVER = 1 << 60


@cache
def node(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """Of a row's symbol and the costs after it in each state: costs, edits (insertions, then the row's own) and the states they lead to."""
    best = []
    for q in STATES:
        ways = [(DELETE + after[q], "D", q)]
        if symbol != "x":
            stay = TRUNCATED if symbol.isupper() else 0
            if symbol.lower() in STEPS[q]:
                to = STEPS[q][symbol.lower()]
                ways.append((stay + after[to], "K", to))
            to = STEPS[q][WANTED[q]]
            ways.append((REROLE + stay + after[to], "R", to))
        best.append(min(ways))
    inserted = lambda q: min(best[q], (INSERT + best[to := STEPS[q][WANTED[q]]][0], "I" + best[to][1], best[to][2]), key=lambda w: (w[0], w[1][0]))
    # Two states lead into each other; an insertion in both would come back at a higher cost.
    best[2], best[3] = inserted(2), inserted(3)
    best[0], best[1] = inserted(0), inserted(1)
    return tuple(zip(*((min(c, NEVER), edits, to) for c, edits, to in best), strict=True))


#: Costs and edits at the end: of the last block, and of others in each of the states that may follow.
ACCEPTED = ((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""))
ENDS = tuple((tuple(0 if q == end else NEVER for q in STATES), ("",) * 4) for end in STATES)


class Suffixes:
    """The automaton's nodes along one signature, from its end."""

    def __init__(self, costs: tuple[int, ...], tails: tuple[str, ...]):
        self.signature, self.tails = "", tails
        self.path = [(0, costs, None, None)]

    def take(self, backwards: str) -> None:
        """Go to a signature, given from its end: what it shares with the one before stays."""
        shared = next((i for i, (a, b) in enumerate(zip(self.signature, backwards, strict=False)) if a != b), min(len(self.signature), len(backwards)))
        del self.path[shared + 1 :]
        for symbol in backwards[shared:]:
            base, costs = self.path[-1][:2]
            least = min(costs)
            costs, edits, to = node(symbol, tuple(min(c - least, NEVER) for c in costs))
            self.path.append((base + least, costs, edits, to))
        self.signature = backwards

    def audit(self, state: int) -> tuple[int, str] | None:
        """(cost, edits of each row and of the end, by commas), or None where no edits lead to the end."""
        base, costs = self.path[-1][:2]
        if costs[state] >= NEVER // 2:
            return None
        total, out = base + costs[state], []
        for _, _, edits, to in reversed(self.path[1:]):
            out.append(edits[state])
            state = to[state]
        return total, ",".join([*out, self.tails[state]])


MOVES = "array<struct<start: int, end: int, cost: long, audit: string>>"


def audits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(signature, first, last, moves) of the rows (signature, first, last, backwards), sorted by last and backwards."""
    accepted, inner = Suffixes(*ACCEPTED), [Suffixes(*e) for e in ENDS]
    for frame in frames:
        found = []
        for backwards, first, last in zip(frame["backwards"], frame["first"], frame["last"], strict=True):
            moves = []
            for end, suffixes in [(0, accepted)] if last else enumerate(inner):
                suffixes.take(backwards)
                for start in (0,) if first else STATES:
                    if way := suffixes.audit(start):
                        moves.append({"start": start, "end": end, "cost": way[0], "audit": way[1]})
            found.append(moves)
        yield frame[["signature", "first", "last"]].assign(moves=found)


def folded(blocks: list[list[dict]]) -> tuple[int, list[str]]:
    """The least cost and the audits of consecutive blocks, given the moves of each."""
    ahead, picks = {0: 0}, []
    for k, moves in enumerate(reversed(blocks)):
        best: dict[int, tuple] = {}
        for m in moves:
            rest = ahead.get(m["end"] if k else 0)
            if rest is not None:
                best[m["start"]] = min(best.get(m["start"], (NEVER, "", 0)), (m["cost"] + rest, m["audit"], m["end"]))
        picks.append(best)
        ahead = {q: b[0] for q, b in best.items()}
    state, out = 0, []
    for best in reversed(picks):
        _, audit, to = best[state]
        out.append(audit)
        state = to
    return ahead[0], out


def fold(moves: pd.Series) -> pd.DataFrame:
    """folded() of the moves of each conversation's blocks, in order; `block` tells them apart."""
    return pd.DataFrame([folded([list(b) for _, b in groupby(m, itemgetter("block"))]) for m in moves], columns=["cost", "audits"])


def null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on equal names, where null equals null. The right side's names are dropped."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in names})
    on = [left[c].eqNullSafe(other[f"_{c}"]) for c in names]
    return left.join(other, on, how).drop(*(f"_{c}" for c in names))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of `turns` after the damage that each row's CRC-32 of `conv_id:turn` brings."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_")).drop("_")


def digest(role: str = "role", text: str = "text") -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def symbols(rows: DataFrame) -> DataFrame:
    """One slim row for the equal rows of a turn: conv_id, turn, digest, n, initial, blank, symbol, and `at`, which counts up in order."""
    tail = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    initial = F.left("role", F.lit(1))
    slim = rows.select(
        "conv_id", "turn", digest().alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), (tail == "").alias("blank"), (~tail.isin("", ".", "!", "?")).alias("cut")
    )
    slim = slim.groupBy("conv_id", "turn", "digest").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("initial", "blank", "cut")))
    slim = slim.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    slim = written(slim.withColumn("at", F.monotonically_increasing_id()), "turns")
    first = slim.filter("NOT blank").groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("lives"))
    symbol = F.when(F.col("lives").isNull(), "x").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    return slim.join(first, "at", "left").withColumn("symbol", symbol)


def blocks_of(rows: DataFrame) -> DataFrame:
    """conv_id, block, of (turn, digest, n) in order, signature, counts and first and last initial of up to BLOCK rows at a time."""
    members = F.array_sort(F.collect_list(F.struct("at", "turn", "digest", "n", "initial", "symbol")))
    lives = F.col("symbol") != "x"
    grouped = rows.groupBy("conv_id", F.expr(f"at DIV {BLOCK}").alias("block")).agg(
        members.alias("of"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - lives.cast("long")).otherwise(0)).alias("duplicate"),
        F.sum((lives & F.col("cut")).cast("long")).alias("truncated"),
        F.sum(F.col("n") - 1).alias("again"),
    )
    joined = lambda c: F.array_join(F.transform("of", lambda x: x[c]), "")
    grouped = grouped.withColumns({"signature": joined("symbol"), "initials": joined("initial")})
    legal = F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    return grouped.withColumns({"illegal": F.col("again") + F.length("initials") - 1 - legal, "starts": F.left("initials", F.lit(1)), "stops": F.right("initials", F.lit(1))}).drop("initials")


def audited(blocks: DataFrame) -> DataFrame:
    """The blocks' moves, of each distinct signature once. blocks: signature, first, last."""
    distinct = blocks.select("signature", "first", "last").distinct().withColumn("backwards", F.reverse("signature"))
    shards = distinct.repartitionByRange("last", "backwards", "first").sortWithinPartitions("last", "backwards")
    return shards.mapInPandas(audits, f"signature string, first boolean, last boolean, moves {MOVES}")


def plans(rows: DataFrame) -> DataFrame:
    """For each conversation of rows (conv_id, turn, role, text; no null role or text): counts, cost, and of its blocks `rows` (turn, digest, n) and `audits`."""
    blocks = written(blocks_of(symbols(rows)), "blocks")
    ends = blocks.groupBy("conv_id").agg(F.min("block").alias("b0"), F.max("block").alias("b1"))
    marked = null_safe(blocks, ends, ["conv_id"]).withColumns({"first": F.col("block") == F.col("b0"), "last": F.col("block") == F.col("b1")}).drop("b0", "b1")
    solved = marked.join(written(audited(marked), "audits"), ["signature", "first", "last"]).withColumn("moves", F.transform("moves", lambda m: m.withField("block", F.col("block"))))
    one = F.array_sort(F.collect_list(F.struct("block", "of", "moves", "starts", "stops")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "again")]
    conversation = solved.groupBy("conv_id").agg(one.alias("b"), *sums)
    pairs = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.concat(F.col("b")[i - 1]["stops"], F.col("b")[i]["starts"]))
    between = F.when(F.size("b") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    conversation = conversation.withColumn("illegal", F.col("illegal") + between).withColumn("plan", F.pandas_udf(fold, "cost long, audits array<string>")(F.flatten("b.moves")))
    return conversation.select("conv_id", "blank", "duplicate", "truncated", "illegal", (F.col("plan.cost") + DELETE * F.col("again")).alias("cost"), F.transform("b", lambda x: x["of"]).alias("rows"), "plan.audits")


def audit_of(rows: Column | str, audits: Column | str) -> Column:
    """The initials of all edits: of each row's own and a deletion for each of its repeats."""

    def one(block: Column, audit: Column) -> Column:
        edits = F.split(audit, ",")
        own = F.transform(block, lambda x, i: F.concat(F.get(edits, i), F.repeat(F.lit("D"), (x["n"] - 1).cast("int"))))
        return F.concat(F.array_join(own, ""), F.element_at(edits, -1))

    return F.array_join(F.zip_with(rows, audits, one), "")


def edits_of(planned: DataFrame) -> DataFrame:
    """conv_id, last, turn, digest, edits: those of each row of a plan, and with `last` those at the conversation's end."""
    each = planned.select("conv_id", F.explode(F.arrays_zip("rows", "audits")).alias("b")).select("conv_id", "b.rows", F.split("b.audits", ",").alias("edits"))
    rows = each.select("conv_id", "edits", F.posexplode("rows").alias("i", "x")).select("conv_id", F.lit(False).alias("last"), "x.turn", "x.digest", F.get("edits", F.col("i")).alias("edits"))
    tail = planned.select("conv_id", F.lit(True).alias("last"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.element_at(F.split(F.element_at("audits", -1), ","), -1).alias("edits"))
    return rows.union(tail)


def repaired_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """conv_id and SHA-256 of the repaired `role:text` lines; each row's edits come just before its text, the end's last."""
    lines, state, edit, empty = hashlib.sha256(), 0, "", True

    def put(role: str, text: str) -> None:
        nonlocal empty
        lines.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
        empty = False

    for frame in frames:
        ids, hashes = [], []
        for conv_id, last, edits, role, text in zip(frame["conv_id"], frame["last"], frame["edits"], frame["role"], frame["text"], strict=True):
            if edits is not None:
                for _ in range(edits.count("I")):
                    put(ROLES[WANTED[state]], "")
                    state = STEPS[state][WANTED[state]]
                edit = edits.lstrip("I")
            elif edit in ("K", "R"):
                role = role if edit == "K" else ROLES[WANTED[state]]
                put(role, text)
                state, edit = STEPS[state][role[0]], ""
            if last:
                ids.append(None if pd.isna(conv_id) else int(conv_id))
                hashes.append(lines.hexdigest())
                lines, state, edit, empty = hashlib.sha256(), 0, "", True
        yield pd.DataFrame({"conv_id": pd.array(ids, dtype="Int64"), "repaired_sha256": hashes})


def hashed(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of each conversation that a plan has."""
    edits = edits_of(planned).withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    texts = rows.select("conv_id", F.lit(False).alias("last"), "turn", digest().alias("digest"), F.lit(None).cast("string").alias("edits"), "role", "text")
    order = [F.col("conv_id"), F.col("last"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("edits").isNull()]
    dealt = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "last", "edits", "role", "text").mapInPandas(repaired_lines, "conv_id long, repaired_sha256 string")


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id, gaps: turns that lie between a conversation's first and last one and are not there."""
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    return turns.withColumn("gaps", F.coalesce("gaps", F.lit(0)))


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows."""
    bounded_batches(rows.sparkSession)
    planned = written(plans(rows), "plans")
    counted = planned.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", audit_of("rows", "audits").alias("audit"))
    return null_safe(null_safe(counted, gaps(rows), ["conv_id"]), hashed(rows, planned), ["conv_id"])


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The repair of every conversation after the damage. One without rows left has zeros, no audit and an empty string's hash."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repairs(damaged(turns))
    out = null_safe(turns.select("conv_id").distinct(), done, ["conv_id"], "left")
    longs = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = F.lit(hashlib.sha256().hexdigest())
    out = out.withColumns(longs | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", nothing)})
    return out.select("conv_id", *longs, "audit", "repaired_sha256")


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
