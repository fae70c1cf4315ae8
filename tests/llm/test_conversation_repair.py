import hashlib
import heapq
import re
import zlib

import pytest
from pyspark.sql import functions as F

from boundwright.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    show = lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield conv_id, turn, "user" if kind == 4 else role, text


def cheapest(rows):
    """Best first over (cost, audit); rows: (initial, must go, truncated)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        state = (i, "s" if roles == "s" else roles[-1:])
        if (state, "end") in seen:
            continue
        seen.add((state, "end"))
        if i == len(rows) and LEGAL.match(roles):
            return cost, audit, roles
        ways = [("I", 5, x, i) for x in "ua"]
        if i < len(rows):
            initial, gone, cut = rows[i]
            ways.append(("D", 2, "", i + 1))
            if not gone:
                ways += [("K", 5 * cut, initial, i + 1)] + [("R", 1 + 5 * cut, x, i + 1) for x in "ua"]
        for letter, price, role, j in ways:
            longer = roles + role
            if re.match(r"(s?(ua)*u?)?\Z", longer):
                heapq.heappush(heap, (cost + price, audit + letter, j, longer))


def brute(rows):
    """Every conversation by itself."""
    out, groups = {}, {}
    for conv_id, *_ in rows:
        groups.setdefault(conv_id, [])
    for r in damage(rows):
        groups[r[0]].append(r)
    for conv_id, own in groups.items():
        md5 = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, md5(r)))
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not stripped else 1 if (role, text) in seen else 2 if stripped[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, roles = cheapest(marks)
        lines, i, k = [], 0, 0
        for letter in audit:
            if letter != "D":
                name = {"u": "user", "a": "assistant", "s": "system"}[roles[k]]
                lines.append(f"{name}:" if letter == "I" else f"{own[i][2] if letter == 'K' else name}:{own[i][3]}")
                k += 1
            i += letter != "I"
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def run(spark, tmp_path, rows, extra=()):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("?") for c in extra}).write.parquet(str(tmp_path / "conversations.parquet"))
    return found(C.op11_conversation_repair(spark, str(tmp_path)))


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(C.op11_conversation_repair(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b")]
    rows += [(1, t, "user", "same.") for t in range(9)] + [(2, 1, "tool", "x."), (2, 1, "user", "x."), (2, 1, "assistant", "y!")]
    rows += [(3, None, "system", "s."), (3, 0, "user", "q? "), (3, 7, "", "w."), (3, 9, "unknown", "v. \n"), (4, 5, "user", "long. " * 20_000)]
    rows += [(5, 0, "user", "twice.")] * 3 + [(6, t, r, f"{t}.") for t, r in enumerate(["assistant", "assistant", "system", "user", "user", "User"])]
    rows += [(c, t, r, x) for c in range(10, 60) for t, r, x in zip(range(5), ["system", "user", "assistant", "user", "assistant"], ["a.", f"b{c}.", "c", "d?", "\x1c"], strict=True)]
    assert run(spark, tmp_path, rows, ("digest", "n", "at", "block", "symbol")) == brute(rows)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_fold_to_the_whole(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    roles = ["user", "assistant", "system", "tool"]
    rows = [(c, t, roles[(c * t * t + t // 3 + c) % 4], f"{(t * c) % 11}" + ("." if (t + c) % 3 else "")) for c in range(30) for t in range(3 + c % 12)]
    assert run(spark, tmp_path, rows) == brute(rows)
