"""Token counts of a document's sections, by the character offsets of its tokens.

A document is encoded once and whole, so its tokens are those a model would see. Each token covers a span
of characters (a token that is part of one character's bytes covers that character); spans of tokens and
of sections are both ordered, so they are joined by binary search where the document lies, and nothing
is shuffled. A token that crosses a boundary is allocated by a rule:

* first: to the section of its first character;
* last: to that of its last character;
* most: to that of most of its characters, the earliest of equals;
* share: to each section, by its part of the token's characters.

Tokens whose character lies in no section count under section -1 (by `share`, their part outside).

Sections are (start, end) in characters, end excluded. Where none are given, they are the text's lines, each
with its line break. Defined results: a null text counts as empty and has one empty line; sections that are
null, empty or turned around have no tokens; of overlapping sections the one that starts last has the
token. Every section has its row, with or without tokens; section -1 only with some. Repeated documents each get their
rows; texts of any length are encoded whole; equal shares go to the earliest section; an empty table gives an empty
one; the columns returned are this operator's own, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.bpe import public, vocabulary
from boundwright.llm.common import bounded_batches, table

RULES = ("first", "last", "most", "share")
COUNTS = "array<struct<section: int, start: int, end: int, n_tokens: double, n_crossing: long, doc_tokens: long>>"


def lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        out.append((at, end))
        at = end
    if len(out) > 1 and out[-1][0] == out[-1][1]:
        out.pop()  # a last line break starts no line
    return out


def spans(ids: np.ndarray, lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The first and last character of each token."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return starts, ends - 1
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, sections: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; the last entry: of none."""
    usable = [(a, b, k) for k, (a, b) in enumerate(sections) if a is not None and b is not None and a < b]
    order = np.array(sorted(usable, key=lambda x: x[0]) or [(0, 0, -1)], dtype=np.int64)
    starts, ends, names = order.T

    def section_of(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, at, "right") - 1
        return np.where((k >= 0) & (at < ends[k]), names[k], -1)

    a, b = section_of(first), section_of(last)
    inner = np.searchsorted(starts, first, "right") != np.searchsorted(starts, last, "right")
    crossing = np.flatnonzero((a != b) | inner)
    total, cross = np.zeros(len(sections) + 1), np.zeros(len(sections) + 1, dtype=np.int64)
    chosen = b if rule == "last" else a
    whole = np.ones(len(first), dtype=bool)
    if rule in ("most", "share"):
        whole[crossing] = False
    np.add.at(total, chosen[whole], 1)
    for t in crossing.tolist():
        parts = section_of(np.arange(first[t], last[t] + 1))
        some, count = np.unique(parts, return_counts=True)
        np.add.at(cross, some, 1)
        if rule == "share":
            np.add.at(total, some, count / len(parts))
        elif rule == "most":
            most = set(some[count == count.max()].tolist())
            total[next(x for x in parts.tolist() if x in most)] += 1
    return total, cross


def counts(text: str | Column, path: str, pattern: str, sections: str | Column | None = None, rule: str = "first") -> Column:
    """The sections of a text with their tokens, by a rule. sections: array<struct<start: int, end: int>>, or the lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def rows(texts: pd.Series, given) -> pd.Series:
        own = vocabulary(path, pattern)
        lengths = np.zeros(max(own.bytes_of) + 1, dtype=np.int64)
        for i, x in own.bytes_of.items():
            lengths[i] = len(x)
        texts, out = ["" if x is None else x for x in texts], []
        for x, ids, some in zip(texts, own.encode(texts), given, strict=True):
            parts = lines(x) if some is None else [(None, None) if p is None else (p["start"], p["end"]) for p in some]
            ids = np.frombuffer(ids, dtype=np.int32)
            total, cross = allocate(*spans(ids, lengths, x), parts, rule)
            names = list(range(len(parts))) + ([-1] if total[-1] or cross[-1] else [])
            out.append([{"section": k, "start": parts[k][0] if k >= 0 else None, "end": parts[k][1] if k >= 0 else None, "n_tokens": float(total[k]), "n_crossing": int(cross[k]), "doc_tokens": len(ids)} for k in names])
        return pd.Series(out, dtype=object)

    if sections is None:

        @F.pandas_udf(COUNTS)
        def of_lines(texts: pd.Series) -> pd.Series:
            return rows(texts, [None] * len(texts))

        return of_lines(text)

    @F.pandas_udf(COUNTS)
    def of_sections(texts: pd.Series, given: pd.Series) -> pd.Series:
        return rows(texts, [[] if x is None else list(x) for x in given])

    return of_sections(text, sections)


def op4_line_tokens(spark, sf_dir: str) -> DataFrame:
    """The tokens of every line of every document; a token across lines belongs to that of its first character."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(counts("text", *public())).alias("c")).select("doc_id", "c.*")
    return docs.withColumn("n_tokens", F.col("n_tokens").cast("long"))


QUERIES = {"op4_line_tokens": op4_line_tokens}
