"""Quality classifier: a byte-level convolutional network, written in numpy.

A document's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by a filter's width less the
step, so every place of a filter over the whole document lies in some chunk. In each chunk every filter
keeps its greatest response; a document is described by the greatest and the mean of its chunks'
responses, which one logistic unit combines into the probability of label 1.

It learns on the driver from a bounded sample of labelled rows, each with its whole text: in order of a hash of the id,
at most SAMPLE_ROWS rows, up to the one with which their texts reach SAMPLE_BYTES bytes. Every document is then
scored whole where it lies; nothing is shuffled.

Defined results: a null text counts as empty and has a score too; texts of any length are scored SLICE chunks at a
time; labels other than 0 and 1, or without an id, are not learned from; several labels of an id count once, as the least, and of
several labelled rows with one id the one with the least text is learned from; repeated documents
score alike; where fewer than two classes are labelled the score is the smoothed share of label 1, without any label a
half; an empty table gives an empty one; columns other than doc_id and text are not read, and `accepted` returns them all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table

SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 32 << 20
WIDTH, STEP, CHUNK = 8, 2, 512
DEPTH, FILTERS = 8, 32
STEPS, BATCH, RATE, SEED = 700, 32, 0.006, 11
PLACES = (CHUNK - WIDTH) // STEP + 1
#: Bytes from the start of one chunk to that of the next.
HOP = PLACES * STEP
PAD = 256
#: Chunks that are convolved at a time.
SLICE = 256


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all texts as rows of byte values, and the first row of each text. An empty text has one row of padding."""
    counts = [max(1, -(-(len(x) - (WIDTH - STEP)) // HOP)) for x in texts]
    first = np.cumsum([0, *counts])
    rows = np.full((first[-1], CHUNK), PAD, dtype=np.int16)
    for at, n, text in zip(first.tolist(), counts, texts, strict=False):
        line = np.full(n * HOP + CHUNK - HOP, PAD, dtype=np.int16)
        line[: len(text)] = np.frombuffer(text, dtype=np.uint8)
        rows[at : at + n] = np.lib.stride_tricks.sliding_window_view(line, CHUNK)[::HOP]
    return rows, first


class Network:
    def __init__(self, bias: float = 0.0, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.w = {
            "embed": draw.normal(0, 0.5, (PAD + 1, DEPTH)),
            "filters": draw.normal(0, 0.7 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)),
            "shift": np.zeros(FILTERS),
            "out": draw.normal(0, 0.1, 2 * FILTERS),
            "bias": np.array([bias]),
        }
        self.w["embed"][PAD] = 0
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def respond(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's greatest response of each filter, and the place of it."""
        best = np.empty((len(rows), FILTERS), dtype=np.float32)
        place = np.empty((len(rows), FILTERS), dtype=np.int64)
        for at in range(0, len(rows), SLICE):
            some = self.w["embed"][rows[at : at + SLICE]].reshape(-1, CHUNK * DEPTH)
            seen = np.lib.stride_tricks.sliding_window_view(some, WIDTH * DEPTH, axis=1)[:, :: STEP * DEPTH]
            value = seen.reshape(-1, WIDTH * DEPTH) @ self.w["filters"]
            value = value.reshape(-1, PLACES, FILTERS)
            place[at : at + SLICE] = value.argmax(1) if self.learning else 0
            best[at : at + SLICE] = value.max(1)
        return np.maximum(best + self.w["shift"], 0), place

    learning = False

    def pool(self, chunk: np.ndarray, first: np.ndarray) -> np.ndarray:
        starts = first[:-1]
        mean = np.add.reduceat(chunk, starts, axis=0) / np.diff(first)[:, None]
        return np.hstack((np.maximum.reduceat(chunk, starts, axis=0), mean)).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        rows, first = cut(texts)
        logit = self.pool(self.respond(rows)[0], first) @ self.w["out"] + self.w["bias"]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def slopes(self, texts: list[bytes], wanted: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean logistic loss."""
        rows, first = cut(texts)
        chunk, place = self.respond(rows)
        pooled = self.pool(chunk, first)
        off = (1 / (1 + np.exp(-(pooled @ self.w["out"] + self.w["bias"]))) - wanted) / len(texts)
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        top = np.zeros_like(chunk)
        hit = chunk == pooled[of, :FILTERS]
        top[hit] = 1
        top /= np.maximum(np.add.reduceat(top, first[:-1], axis=0)[of], 1)
        back = off[of, None] * (top * self.w["out"][:FILTERS] + self.w["out"][FILTERS:] / np.diff(first)[of, None])
        back[chunk <= 0] = 0
        embed, filters = np.zeros((PAD + 1, DEPTH)), np.zeros(self.w["filters"].shape)
        for at in range(0, len(rows), SLICE):
            some = slice(at, at + SLICE)
            n = len(rows[some])
            seen = rows[some][np.arange(n)[:, None, None], (place[some] * STEP)[:, :, None] + np.arange(WIDTH)]
            filters += np.einsum("rfi,rf->if", self.w["embed"][seen].reshape(n, FILTERS, -1), back[some], optimize=True)
            to_inputs = (back[some][:, :, None] * self.w["filters"].T).reshape(-1, DEPTH)
            embed += np.stack([np.bincount(seen.ravel(), to_inputs[:, k], PAD + 1) for k in range(DEPTH)], axis=1)
        embed[PAD] = 0
        return {
            "embed": embed,
            "filters": filters,
            "shift": back.sum(0),
            "out": pooled.T @ off,
            "bias": off.sum(keepdims=True),
        }


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam over shuffled batches; the order depends on the seed alone."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    net = Network(float(np.log(share / (1 - share))), seed)
    if len(set(labels.tolist())) < 2:
        net.w["out"][:] = 0
        return net
    net.learning = True
    draw, first, second, step = np.random.default_rng(seed), {}, {}, 0
    while step < steps:
        order = draw.permutation(len(texts))
        for at in range(0, min(len(order), (steps - step) * BATCH), BATCH):
            some = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in net.slopes([texts[i] for i in some], labels[some].astype(np.float32)).items():
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                net.w[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.learning = False
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Network:
    """A network fitted to the bounded sample of labelled documents that are not held out."""
    marked = labels.filter(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # of `rows` rows
    sample = texts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < size).collect()
    sample.sort(key=lambda r: r.doc_id)
    return fit([r.text.encode() for r in sample], np.array([r.quality for r in sample], dtype=np.int64))


def score(text: str | Column, net: Network) -> Column:
    """The probability of label 1."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(net.scores([(x or "").encode() for x in texts]))

    return probability(text)


def accepted(docs: DataFrame, net: Network, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, with the columns they had."""
    bounded_batches(docs.sparkSession)
    return docs.filter(score(text, net) >= least)


def op8_byte_network(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    net = learned(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text", net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op8_byte_network": op8_byte_network}
