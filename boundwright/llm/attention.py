"""Language-model scoring by causal self-attention over subword ids.

Words are lower-cased (A-Z), joined by single spaces and split into ids of a public byte-level
vocabulary; an end id closes each document and stands before its first id. The model has one layer:

* queries, keys, values and a residual vector come from tables indexed by id, a learned bias depends on
  the distance, and a masked softmax mixes the values of the CONTEXT + STRIDE latest positions at most;
* the state predicts the next id in steps, each a softmax of what the state says: one of the classes, then the
  id within its class. The HEAD commonest ids fill classes of CLASS ids each. All other ids are one class of
  the first step, which the state divides into tail classes of TAIL ids, and those into their ids;
* what the state says is added to log shares: of classes and their ids after the latest id, from the counts of
  all words of the training documents; of tail classes and their ids, from the counts of all their ids.

A word's probability is a mixture: that of its ids by the steps above and, with the weight WORD_WEIGHT, its share of all training
words if it is one of the FREQUENT commonest. So a word known from training never costs much more than in the base, however
little there was to learn from; one that is not is spelt by its ids.

A document is covered by windows of STRIDE positions that each see CONTEXT positions before them, so
windows overlap and each id is scored once; windows are scored many at a time. Base scores, counts and log
shares come from all training documents.

The weights are learned from every window of all training documents, once each. Windows move in blocks of up to BLOCK
neighbours, whose ids overlap and are sent once. A hash (of doc_id, text and place) deals the blocks to ROUNDS rounds
of Adam and, in each, to learners of about LEARNER_WINDOWS windows, which take them in the order of the hash; the
changes of all learners are averaged by their windows. So the layout of the input decides nothing.

Word counts are a shuffle that grows with the corpus. The commonest words, at most FREQUENT, are broadcast and scored
where the documents lie: those above a count that a histogram of counts gives. The other words of each document
meet their counts in a join, which has no hot key because each of them is about a FREQUENT-th part of all tokens at most.

Defined results: a null text counts as empty and has the end token alone; a null doc_id is held in
(never held out); rows with equal id and text are each a document, and score alike; with nothing to learn from, all
counts are zero and an empty table gives an empty one; words of equal counts are on the same side of the
cutoff; a text of any length is encoded and cut into windows, ROWS_HELD documents at a time; columns other than doc_id
and text are not read, so none can clash.
"""

from __future__ import annotations

import base64
import pickle
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import chain, groupby, islice
from math import fsum, log10
from zlib import crc32

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, table, written

HEAD, CLASS, TAIL, SHARED, DEPTH = 1024, 32, 256, 128, 24
CONTEXT, STRIDE = 8, 24
ROUNDS, BATCH, RATE, SEED = 6, 256, 0.05, 5
#: Small tables are learned from in smaller batches, as many as LEAST_BATCHES and of LEAST_BATCH windows at least.
LEAST_BATCHES, LEAST_BATCH = 256, 8
#: Windows of a learner in a round, and of a block.
LEARNER_WINDOWS, BLOCK = 1 << 16, 8
FREQUENT = 1 << 16
#: Parts of a doubling in the histogram of word counts.
STEPS = 8
#: Windows scored at a time, blocks put in order at a time, entries of a dictionary of words, and models averaged in one group, each cut into so many pieces.
SLICE, ORDERED, KEPT_WORDS, FAN, PIECES = 512, 512, 300_000, 32, 32
#: Documents that a worker holds at once, and words whose ids it remembers.
ROWS_HELD, REMEMBERED = 400, 300_000
PAD = -1
#: Logits of rows whose greatest is farther from zero are shifted, so that their exponentials neither overflow nor vanish together.
TOP = np.float32(60)
#: The weight of a word's share in its probability.
WORD_WEIGHT = 0.3
CLASSES, ROWS = HEAD // CLASS + 1, HEAD + SHARED + 1
SPAN = CONTEXT + STRIDE
DISTANCE = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(SPAN)
MASK = np.where(DISTANCE < 0, np.float32(-1e9), np.float32(0))


class Subwords:
    """Words to ids of a public vocabulary; the id after its last is the end. Each word is encoded with a space before it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self.starts = np.zeros(self.end, dtype=bool)
        self.starts[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.known: dict[bytes, bytes] = {}

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The ids of each list of words, the end after them."""
        known, end = self.known, np.int32(self.end).tobytes()
        if len(known) > REMEMBERED:  # keep the half met first, where the common words are
            for word in list(islice(known, REMEMBERED // 2, None)):
                del known[word]
        new = list(set(chain.from_iterable(texts)).difference(known))
        ids, sizes = self.flat(new)
        flat, ends = ids.tobytes(), np.cumsum(4 * sizes).tolist()
        known.update((w, flat[a:b]) for w, a, b in zip(new, [0, *ends], ends, strict=False))
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)) + end, dtype=np.int32) for words in texts]
        for word in [w for w in new if len(w) > 64]:
            del known[word]
        return out

    def flat(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has.

        Words are encoded at once, joined by spaces: no match of the pattern spans a space, and the ids that start
        with one are where words start. Words that hold white space of their own are encoded one at a time.
        """
        texts = [w.decode() for w in words]
        odd = [i for i, x in enumerate(texts) if x.split() != [x]]
        plain = texts if not odd else [x for x in texts if x.split() == [x]]
        ids = np.array(self.encode(" " + " ".join(plain)) if plain else [], dtype=np.int32)
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(plain):
            odd, ids, at = list(range(len(texts))), ids[:0], at[:0]
        sizes, bounds = np.diff(np.r_[at, len(ids)]), np.r_[at, len(ids)]
        if not odd:
            return ids, sizes
        parts, counts, done = [], [], 0
        for k, i in enumerate(odd):  # k odd words stand before word i
            own = np.array(self.encode(" " + texts[i]), dtype=np.int32)
            parts += [ids[bounds[done] : bounds[i - k]], own]
            counts += [sizes[done : i - k], [len(own)]]
            done = i - k
        return np.concatenate([*parts, ids[bounds[done] :]]).astype(np.int32), np.concatenate([*counts, sizes[done:]]).astype(np.int64)


@lru_cache(maxsize=2)
def subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def laid(ids: np.ndarray, end: int, pad: int = PAD) -> np.ndarray:
    """A document's ids after padding and the end id, padded to whole windows; of the type of its ids."""
    n = -(-len(ids) // STRIDE)
    line = np.full(CONTEXT + 1 + n * STRIDE, pad, dtype=ids.dtype)
    line[CONTEXT] = end
    line[CONTEXT + 1 : CONTEXT + 1 + len(ids)] = ids
    return line


def windows(ids: np.ndarray, end: int) -> np.ndarray:
    """The windows of a document: rows of SPAN + 1 ids. The last STRIDE are to be predicted, each from those before it."""
    return np.lib.stride_tricks.sliding_window_view(laid(ids, end), SPAN + 1)[::STRIDE]


@dataclass
class Words:
    """Natural log shares of words by the hashes of their ids, in order; starts: whether an id starts a word, the end id included."""

    starts: np.ndarray
    known: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, own: Subwords, words: list[bytes], shares: list[float], end_share: float) -> Words:
        ids, sizes = own.flat(words)
        first = np.cumsum(np.r_[sizes, 1]) - np.r_[sizes, 1]
        keys = hashes(np.r_[ids, np.int32(own.end)], first)
        order = np.argsort(keys)
        return cls(np.r_[own.starts, True], keys[order], np.r_[shares, end_share][order] * np.log(10))

    def mixed(self, ids: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of documents' ids start, and their log probabilities; each: those of the ids."""
        first = np.flatnonzero(self.starts[ids])
        keys = hashes(ids, first)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        share = np.where(self.known[at] == keys, self.share[at] + np.log(WORD_WEIGHT), -np.inf)
        return first, np.logaddexp(np.add.reduceat(each, first) + np.log(1 - WORD_WEIGHT), share)


def hashes(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run of ids that begins at one of `first`."""
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    for bits, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(bits))) * np.uint64(factor)
    return np.add.reduceat(x ^ (x >> np.uint64(31)), first)


@dataclass
class Model:
    """Tables and output weights `w`; `row`: the table row of each id, `slot`: its place among the head ids, those of the tail after them."""

    w: dict[str, np.ndarray]
    row: np.ndarray
    slot: np.ndarray
    end: int
    #: Log shares of the classes after each table row, and of the members of each class after each table row.
    after: np.ndarray
    within: np.ndarray
    #: Log shares of the tail's classes, and of their members.
    tail: np.ndarray
    tails: np.ndarray
    #: Adam's running means, and how many steps it has made.
    memory: dict[str, np.ndarray] = field(default_factory=dict)
    words: Words | None = None
    scale: float = field(default=float(1 / np.sqrt(DEPTH)))

    @classmethod
    def fresh(cls, counts: np.ndarray, end: int, pairs=None) -> Model:
        """counts: of every id, the end included; pairs: gets `row` and `slot` and returns the counts of pairs."""
        draw = np.random.default_rng(SEED)
        order = np.argsort(-counts, kind="stable")
        order = np.r_[end, order[order != end]]
        head, others = order[:HEAD], order[HEAD:]
        slot = np.empty(len(counts), dtype=np.int32)
        slot[order] = np.arange(len(counts))
        row = HEAD + np.arange(len(counts), dtype=np.int32) % SHARED
        row[head] = np.arange(len(head))
        row = np.r_[row, np.int32(ROWS - 1)]  # the last row, also reached by PAD = -1, is padding
        smooth = counts + 0.5
        n = max(1, -(-len(others) // TAIL))
        tails = np.zeros(n * TAIL)
        tails[: len(others)] = smooth[others]
        tails = tails.reshape(n, TAIL)
        mass = tails.sum(1, keepdims=True)
        share = np.zeros(HEAD + 1)
        share[: len(head)], share[HEAD] = smooth[head], smooth[others].sum()
        share = np.maximum(share, 1e-9) / smooth.sum()
        met = pairs(row, slot) if pairs else np.zeros((ROWS + 1, HEAD + 2))
        first = met[ROWS, :-1] + share  # of the id after a word: the first of the next word, or the end
        first[0] += counts[end]
        first /= first.sum()
        follow = met[:ROWS, :-1] + met[:ROWS, -1:] * first + share
        follow /= follow.sum(1, keepdims=True)
        members = follow[:, :-1].reshape(ROWS, CLASSES - 1, CLASS)
        of_class = members.sum(2)
        after = np.log(np.c_[of_class, follow[:, -1]]).astype(np.float32)
        within = np.ascontiguousarray(np.log(members / of_class[:, :, None]).transpose(1, 0, 2), dtype=np.float32)
        floor = 1e-30  # of places without an id
        tail = np.log(np.maximum(mass[:, 0] / max(floor, mass.sum()), floor)).astype(np.float32)
        tails = np.log(np.maximum(tails / np.maximum(mass, floor), floor)).astype(np.float32)
        w = {k: draw.normal(0, 0.3, (ROWS, DEPTH)) for k in ("query", "key", "value", "residual")}
        w |= {"distance": np.zeros(SPAN), "class": draw.normal(0, 0.02, (DEPTH, CLASSES)), "class_bias": np.zeros(CLASSES)}
        w |= {"member": draw.normal(0, 0.02, (CLASSES - 1, DEPTH, CLASS)), "member_bias": np.zeros((CLASSES - 1, CLASS))}
        w |= {"tail": np.zeros((DEPTH, n)), "tail_bias": np.zeros(n)}
        w |= {f"tail-{c}": np.zeros((DEPTH + 1, TAIL)) for c in range(n)}  # the last row is the bias
        return cls({k: v.astype(np.float32) for k, v in w.items()}, row, slot, end, after, within, tail, tails)

    def states(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Attention of the last STRIDE of each window's rows over all that came before them in the window."""
        w, now = self.w, rows[:, CONTEXT:]
        query, key, value = w["query"].take(now, 0), w["key"].take(rows, 0), w["value"].take(rows, 0)
        query *= self.scale
        a = np.matmul(query, key.transpose(0, 2, 1))
        far = TOP - np.abs(w["distance"]).max()
        plain = -far <= a.min() and a.max() <= far if a.size else True  # every place sees one that is no padding, so no row needs a shift
        a += w["distance"][np.maximum(DISTANCE, 0)] + MASK
        padding = rows == ROWS - 1
        padded = np.flatnonzero(padding.any(1))
        a[padded] += np.where(padding[padded], np.float32(-1e9), np.float32(0))[:, None, :]
        total = row_sums(np.exp(a, out=a) if plain else exponentials(a))
        state = np.matmul(a, value)
        state /= total
        state += w["residual"].take(now, 0)
        np.maximum(state, 0, out=state)
        return state, a, total, query, key, value

    def places(self, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of ids to be predicted: class, place in it, an order by class, and where the classes begin in that order."""
        slot = self.slot[target]
        group = np.minimum(slot // CLASS, CLASSES - 1).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        return slot, group, order, np.searchsorted(group[order], np.arange(CLASSES + 1))

    def member_logits(self, state: np.ndarray, latest: np.ndarray, group: np.ndarray, cuts: np.ndarray, within: np.ndarray) -> np.ndarray:
        """What the states, in order of their classes, say of the members; within: the log shares as one table."""
        z = np.empty((cuts[-2], CLASS), dtype=state.dtype)
        for c in np.flatnonzero(cuts[1:-1] > cuts[:-2]).tolist():
            np.matmul(state[cuts[c] : cuts[c + 1]], self.w["member"][c], out=z[cuts[c] : cuts[c + 1]])
        z += within.reshape(-1, CLASS).take(group * ROWS + latest, 0)
        return z

    def tail_parts(self, slot: np.ndarray):
        """(class, its rows) of the slots of tail ids."""
        group = (slot - HEAD) // TAIL
        for c in np.unique(group).tolist():
            yield c, np.flatnonzero(group == c)

    def log_probabilities(self, lines: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The natural log probability of each of a window's last STRIDE ids; 0 where there is none. tables: those of `biased`."""
        after, within = tables or self.biased()
        rows = self.row[lines[:, :-1]]
        state, latest = self.states(rows)[0].reshape(-1, DEPTH), rows[:, CONTEXT:].ravel()
        target = lines[:, CONTEXT + 1 :].ravel()
        slot, group, order, cuts = self.places(target)
        z = state @ self.w["class"]
        z += after.take(latest, 0)
        out = softmax_at(z, group)
        head, tail = order[: cuts[-2]], order[cuts[-2] :]
        z = self.member_logits(state.take(head, 0), latest[head], group[head].astype(np.int32), cuts, within)
        out[head] += softmax_at(z, slot[head] % CLASS)
        if len(tail):
            state, slot = state[tail], slot[tail]
            own = softmax_at(state @ self.w["tail"] + (self.tail + self.w["tail_bias"]), (slot - HEAD) // TAIL)
            for c, some in self.tail_parts(slot):
                v = self.w[f"tail-{c}"]
                own[some] += softmax_at(state[some] @ v[:-1] + (self.tails[c] + v[-1]), (slot[some] - HEAD) % TAIL)
            out[tail] += own
        out[target == PAD] = 0
        return out.reshape(len(lines), STRIDE)

    def biased(self) -> tuple[np.ndarray, np.ndarray]:
        """The log shares with the learned biases added."""
        return self.after + self.w["class_bias"], self.within + self.w["member_bias"][:, None, :]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The natural log probability of each document's ids."""
        cut = [windows(x, self.end) for x in docs]
        lines = np.concatenate(cut) if cut else np.empty((0, SPAN + 1), dtype=np.int32)
        tables = self.biased()
        some = [self.log_probabilities(lines[i : i + SLICE], tables) for i in range(0, len(lines), SLICE)]
        if not docs:
            return np.empty(0)
        if self.words is None:
            total = np.concatenate([x.sum(1, dtype=np.float64) for x in some])
            return np.add.reduceat(total, np.cumsum([0, *map(len, cut)])[:-1])
        each = np.concatenate(some).ravel()[lines[:, CONTEXT + 1 :].ravel() != PAD].astype(np.float64)
        first, total = self.words.mixed(np.concatenate(docs), each)
        return np.add.reduceat(total, np.searchsorted(first, np.cumsum([0, *map(len, docs)])[:-1]))

    def slopes(self, lines: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean loss of the ids to be predicted; of the tail's members, that of the classes met."""
        w, rows = self.w, self.row[lines[:, :-1]]
        shaped, a, total, query, key, value = self.states(rows)
        a /= total
        state, target = shaped.reshape(-1, DEPTH), lines[:, CONTEXT + 1 :].ravel()
        known = target != PAD
        missing = np.flatnonzero(~known)
        weight = np.float32(1 / max(1, len(known) - len(missing)))  # of every id; gradients are sums until the end
        slot, group, order, cuts = self.places(target)
        latest = rows[:, CONTEXT:].ravel()
        off = state @ w["class"]
        off += (self.after + w["class_bias"]).take(latest, 0)
        off = off_target(off, group)
        off[missing] = 0
        ones = np.ones(len(off), dtype=np.float32)
        g = {"class": state.T @ off, "class_bias": ones @ off, "member": np.zeros_like(w["member"]), "member_bias": np.zeros_like(w["member_bias"])}
        back = off @ w["class"].T
        head, tail = order[: cuts[-2]], order[cuts[-2] :]
        tail = tail[known[tail]]
        own, of = state.take(head, 0), group[head].astype(np.int32)
        off = self.member_logits(own, latest[head], of, cuts, self.within)
        off += w["member_bias"].take(of, 0)
        off = off_target(off, slot[head] % CLASS)
        off[~known[head]] = 0
        to_own = np.empty_like(own)
        for c in np.flatnonzero(cuts[1:-1] > cuts[:-2]).tolist():
            part = slice(cuts[c], cuts[c + 1])
            g["member"][c], g["member_bias"][c] = own[part].T @ off[part], ones[part] @ off[part]
            np.matmul(off[part], w["member"][c].T, out=to_own[part])
        back[head] += to_own
        if len(tail):
            own, slot = state[tail], slot[tail]
            off = off_target(own @ w["tail"] + (self.tail + w["tail_bias"]), (slot - HEAD) // TAIL)
            g |= {"tail": own.T @ off, "tail_bias": off.sum(0)}
            to_own = off @ w["tail"].T
            for c, some in self.tail_parts(slot):
                v = w[f"tail-{c}"]
                off = off_target(own[some] @ v[:-1] + (self.tails[c] + v[-1]), (slot[some] - HEAD) % TAIL)
                g[f"tail-{c}"] = np.vstack((own[some].T @ off, off.sum(0)))
                to_own[some] += off @ v[:-1].T
            back[tail] += to_own
        back *= state > 0
        back = back.reshape(shaped.shape)
        to_value = np.matmul(a.transpose(0, 2, 1), back)
        to_a = np.matmul(back, value.transpose(0, 2, 1))
        to_a *= a
        to_a -= a * row_sums(to_a)
        g["distance"] = np.bincount(np.maximum(DISTANCE, 0).ravel(), np.where(DISTANCE < 0, 0, to_a.sum(0)).ravel(), SPAN).astype(np.float32)
        to_query, to_key = np.matmul(to_a, key), np.matmul(to_a.transpose(0, 2, 1), query)
        to_query *= self.scale
        now = rows[:, CONTEXT:]
        g["key"], g["value"] = sums_at(rows, ROWS, to_key, to_value)
        g["query"], g["residual"] = sums_at(now, ROWS, to_query, back)
        for v in g.values():
            v *= weight
        return g

    def learn(self, slices: Iterable[np.ndarray], seed: int, rate: float, batch: int = BATCH) -> int:
        """One pass of Adam, from what `memory` holds, over the windows of all slices, each in an order that the seed gives; how many they were.

        What a batch does not touch, as most classes of the tail, is left alone.
        """
        draw, memory = np.random.default_rng(seed), self.memory
        step, seen = int(memory.get("steps", np.zeros(1))[0]), 0
        for lines in slices:
            order = draw.permutation(len(lines))
            seen += len(lines)
            for at in range(0, len(order), batch):
                step += 1
                pace = np.float32(rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step))
                for k, g in self.slopes(lines[order[at : at + batch]]).items():
                    if f"first {k}" not in memory:
                        memory |= {f"first {k}": np.zeros_like(g), f"second {k}": np.zeros_like(g)}
                    m, v = memory[f"first {k}"], memory[f"second {k}"]
                    m *= np.float32(0.9)
                    v *= np.float32(0.99)
                    v += np.float32(0.01) * g * g
                    g *= np.float32(0.1)
                    m += g
                    root = np.sqrt(v, out=g)
                    root += np.float32(1e-7)
                    np.divide(m, root, out=root)
                    root *= pace
                    self.w[k] -= root
        memory["steps"] = np.array([step], dtype=np.float32)
        return seen


def exponentials(z: np.ndarray) -> np.ndarray:
    """e to the logits of each row, in place, up to a factor of the row's own."""
    if z.size and not (-TOP <= z.min() and z.max() <= TOP):  # only then are the rows' own looked for
        top = z.max(-1, keepdims=True)
        if top.max() > TOP or top.min() < -TOP:
            z -= top
    return np.exp(z, out=z)


def row_sums(z: np.ndarray) -> np.ndarray:
    """The sums along the last axis, as a product, which is several times faster on short rows."""
    return (z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], dtype=z.dtype)).reshape(*z.shape[:-1], 1)


def sums_at(at: np.ndarray, n: int, *slopes: np.ndarray) -> list[np.ndarray]:
    """Of each array the sums, in n rows, of the rows that `at` sends to the same place."""
    at = at.ravel().astype(np.uint16)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=np.uint16(n)))
    out = []
    for slope in slopes:
        g = np.zeros((n, slope.shape[-1]), dtype=slope.dtype)
        g[at[order[first]]] = np.add.reduceat(slope.reshape(-1, slope.shape[-1]).take(order, 0), first)
        out.append(g)
    return out


def softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each row at one place."""
    exponentials(z)
    out = z[np.arange(len(z)), at] / row_sums(z)[:, 0]
    return np.log(np.maximum(out, np.float32(1e-37)))


def off_target(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The softmax of each row, less one at one place."""
    exponentials(z)
    z /= row_sums(z)
    z[np.arange(len(z)), at] -= 1
    return z


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; each task adds up first what it meets, KEPT_WORDS words at a time."""

    def counted(batches):
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                counts.update(split(text))
                if len(counts) > KEPT_WORDS:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts = Counter()
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return docs.select("text").mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded(words: DataFrame, tokens: tuple[str, str]) -> DataFrame:
    """(n, ids): each word's count and its ids, in 32 bits each."""

    def encode(batches):
        own = subwords(*tokens)
        for pdf in batches:
            ids, sizes = own.flat(pdf["word"])
            flat, ends = ids.tobytes(), np.cumsum(4 * sizes).tolist()
            yield pd.DataFrame({"n": pdf["n"], "ids": [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]})

    return words.select("word", "n").mapInPandas(encode, "n long, ids binary")


def spelled(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and how many each has."""
    return np.frombuffer(b"".join(pdf["ids"]), dtype=np.int32), np.fromiter(map(len, pdf["ids"]), dtype=np.int64, count=len(pdf)) // 4


def id_counts(words: DataFrame, docs: int, end: int) -> np.ndarray:
    """How often each id stands in the training documents, from their words' counts (n, ids). As many rows as ids come to the driver."""

    def counted(batches):
        total = np.zeros(end + 1, dtype=np.int64)
        for pdf in batches:
            ids, sizes = spelled(pdf)
            np.add.at(total, ids, np.repeat(pdf["n"].to_numpy(), sizes))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "n": total[some]})

    counts = np.zeros(end + 1, dtype=np.float64)
    for r in words.mapInPandas(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    counts[-1] = docs
    return counts


def pair_counts(words: DataFrame, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """How often each head id (last but one column: any other id) follows each table row within words.

    The last row counts what words begin with, the last column what they end with. At most
    (ROWS + 1) * (HEAD + 2) sums come to the driver, whatever the corpus.
    """
    sent = words.sparkSession.sparkContext.broadcast((row.astype(np.int64), np.minimum(slot, HEAD).astype(np.int64)))

    def counted(batches):
        row, slot = sent.value
        total = np.zeros((ROWS + 1) * (HEAD + 2), dtype=np.int64)
        for pdf in batches:
            ids, sizes = spelled(pdf)
            ends = np.cumsum(sizes)
            n, firsts = np.repeat(pdf["n"].to_numpy(), sizes), (ends - sizes)[sizes > 0]
            before = np.r_[ROWS, row[ids[:-1]]][: len(ids)]
            before[firsts] = ROWS
            np.add.at(total, before * (HEAD + 2) + slot[ids], n)
            lasts = (ends - 1)[sizes > 0]
            np.add.at(total, row[ids[lasts]] * (HEAD + 2) + HEAD + 1, n[lasts])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"pair": some, "n": total[some]})

    out = np.zeros((ROWS + 1) * (HEAD + 2))
    sums = words.mapInPandas(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    sent.destroy()
    out[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(ROWS + 1, HEAD + 2)


def packing(end: int) -> np.dtype:
    """How ids are written; PAD is the greatest number."""
    return np.dtype(np.uint16 if end < (1 << 16) - 1 else np.uint32)


def unpacked(some: list[bytes], kind: np.dtype) -> np.ndarray:
    ids = np.frombuffer(b"".join(some), dtype=kind)
    out = ids.astype(np.int32)
    out[ids == np.iinfo(kind).max] = PAD
    return out


def numbers(of: int, n: int) -> np.ndarray:
    """A hash for each of n blocks of a document with the hash `of`."""
    x = np.uint64(of & (1 << 64) - 1) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for bits, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(bits))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def blocks(docs: DataFrame, end: int, k: int) -> DataFrame:
    """(number, block): the ids of all blocks of windows of documents (number, ids) that are dealt to round k, each with a hash of its own."""
    kind = packing(end)

    def cut(batches):
        for pdf in batches:
            found, lines = [], []
            for of, ids in zip(pdf["number"], pdf["ids"], strict=True):
                n = -(-len(ids) // (STRIDE * kind.itemsize))
                number = numbers(int(of), -(-n // BLOCK)) >> np.uint64(1)
                some = np.flatnonzero(number % np.uint64(ROUNDS) == k)
                if not len(some):
                    continue
                line, size = laid(np.frombuffer(ids, dtype=kind), end, np.iinfo(kind).max).tobytes(), kind.itemsize
                found.append(number[some])
                lines += [line[i * BLOCK * STRIDE * size : ((i + 1) * BLOCK * STRIDE + CONTEXT + 1) * size] for i in some.tolist()]
            yield pd.DataFrame({"number": np.concatenate([np.empty(0, dtype=np.uint64), *found]).astype(np.int64), "block": lines})

    return docs.select("number", "ids").mapInPandas(cut, "number long, block binary")


def opened(some: list[bytes], kind: np.dtype) -> np.ndarray:
    """The windows of blocks."""
    sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some)) // kind.itemsize
    many = (sizes - CONTEXT - 1) // STRIDE
    ends = np.cumsum(many)
    first = np.repeat(np.cumsum(sizes) - sizes, many) + STRIDE * (np.arange(many.sum()) - np.repeat(ends - many, many))
    return unpacked(some, kind)[first[:, None] + np.arange(SPAN + 1)]


def ordered(batches, kind: np.dtype):
    """(learner, windows) of batches sorted by learner: ORDERED blocks at a time, whatever the batches are; fewer at a learner's end."""
    rows = ((k, x) for pdf in batches for k, x in zip(pdf["learner"], pdf["block"], strict=True))
    for learner, own in groupby(rows, key=lambda r: r[0]):
        while some := [x for _, x in islice(own, ORDERED)]:
            yield learner, opened(some, kind)


#: What learners change of a model.
PARTS = ("w", "memory")


def taught(docs: DataFrame, model: Model, k: int, learners: int = 1, batch: int = BATCH, sent=None) -> DataFrame:
    """(part, n, w): of each learner, what has changed of the model after all its n windows of documents (number, ids) in round k. sent: the model's broadcast, where it has one."""
    start, rate = sent or docs.sparkSession.sparkContext.broadcast(model), RATE * (1 - 0.85 * (k + 0.5) / ROUNDS)
    kind = packing(model.end)

    def learn(batches):
        subwords.cache_clear()  # words that the worker remembers from an earlier stage are of no use here
        model = start.value
        for part, slices in groupby(ordered(batches, kind), key=lambda x: x[0]):
            own = replace(model, **{x: {k: v.copy() for k, v in getattr(model, x).items()} for x in PARTS})
            n = own.learn((some for _, some in slices), SEED + 1000 * k + int(part), rate, batch)
            changed = {(x, k): v - getattr(model, x).get(k, 0) for x in PARTS for k, v in getattr(own, x).items()}
            yield pd.DataFrame({"part": [part], "n": [n], "w": [pickle.dumps({k: v for k, v in changed.items() if v.any()})]})

    learner = F.pmod(F.floor(F.col("number") / ROUNDS), F.lit(learners)).cast("int").alias("learner")
    some = blocks(docs, model.end, k).select(learner, "number", "block")
    dealt = some.repartitionById(learners, F.col("learner")).sortWithinPartitions("learner", "number", "block")
    return dealt.select("learner", "block").mapInPandas(learn, "part int, n long, w binary")


def averaged(some: DataFrame) -> DataFrame:
    """One row of rows (part, n, w): the mean of the changes by n. A weight that a row lacks did not change.

    The changes are cut by names into PIECES, and FAN or so of one piece are averaged at a time, so a group is FAN / PIECES whole models or so.
    """

    def cut(batches):
        for pdf in batches:
            for part, n, x in zip(pdf["part"], pdf["n"], pdf["w"], strict=True):
                pieces = [{} for _ in range(PIECES)]
                for name, v in pickle.loads(x).items():
                    pieces[crc32(repr(name).encode()) % PIECES][name] = v
                yield pd.DataFrame({"piece": range(PIECES), "part": part, "n": n, "w": [pickle.dumps(v) for v in pieces]})

    def mean(pdf):
        pdf, total = pdf.sort_values("part"), {}
        for n, x in zip(pdf["n"], pdf["w"], strict=True):
            for name, v in pickle.loads(x).items():
                total[name] = total.get(name, 0) + int(n) * v.astype(np.float64)
        n, own = int(pdf["n"].sum()), pdf.iloc[:1]
        return own.assign(n=n, w=[pickle.dumps({k: (v / n).astype(np.float32) for k, v in total.items()})])[["piece", "part", "n", "w"]]

    def joined(pdf):
        whole = {k: v for x in pdf["w"] for k, v in pickle.loads(x).items()}
        return pd.DataFrame({"part": [0], "n": pdf["n"].iloc[:1], "w": [pickle.dumps(whole)]})

    left = some.count()
    if left < 2:
        return some
    kind = "piece int, part int, n long, w binary"
    each = some.mapInPandas(cut, kind)
    while left > 1:
        left = -(-left // FAN)
        each = written(each.groupBy("piece", (F.col("part") % left).alias("of")).applyInPandas(mean, kind).withColumn("part", F.col("part") % left), "averaged")
    return each.groupBy("part").applyInPandas(joined, some.schema)


def trained(docs: DataFrame, model: Model) -> Model:
    """The model after ROUNDS rounds over all windows of documents (number, ids); in each, all learners start from the same model and what they changed is averaged."""
    size = STRIDE * packing(model.end).itemsize
    windows = docs.agg(F.sum(F.ceil(F.octet_length("ids") / size))).first()[0] or 0
    learners = max(1, -(-windows // (ROUNDS * LEARNER_WINDOWS)))
    batch = min(BATCH, max(LEAST_BATCH, windows // LEAST_BATCHES))
    for k in range(ROUNDS):
        sent = docs.sparkSession.sparkContext.broadcast(model)
        learned = written(taught(docs, model, k, learners, batch, sent), "learned")
        sent.destroy()
        if last := averaged(learned).first():
            for (x, name), v in pickle.loads(last.w).items():
                getattr(model, x)[name] = getattr(model, x).get(name, 0) + v
    return model


def commonest(words: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The words (word, n) at or above a count that at most `most` words reach; only a histogram of counts comes to the driver."""
    step = F.floor(F.log2("n") * STEPS)
    left, least = most, None
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("m")).orderBy(F.desc("step")).collect():
        left -= r.m
        if left < 0:
            break
        least = r.step
    return words.filter(step >= least) if least is not None else words.limit(0)


READ = "n_words long, base double, known long, ids binary, rare array<binary>, times array<int>"


def scored(docs: DataFrame, tokens: tuple[str, str]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select("doc_id", "text", held_out().alias("held_out"))
    training = own.filter("NOT held_out")
    words = written(word_counts(training), "words")
    ends = training.count()
    sums = words.agg(F.sum("n"), F.count("*")).first()
    total = (sums[0] or 0) + ends
    floor = total + 0.1 * (sums[1] + (ends > 0) + 1)
    share = lambda c: log10((c + 0.1) / floor)
    end, spelt = subwords(*tokens).end, written(encoded(words, tokens), "spelt")
    model = Model.fresh(id_counts(spelt, ends, end), end, lambda row, slot: pair_counts(spelt, row, slot))
    common = {bytes(r.word): share(r.n) for r in commonest(words).collect()}
    spelt_words = Words.of(subwords(*tokens), list(common), list(common.values()), share(ends))
    sent = spark.sparkContext.broadcast(common)

    @F.pandas_udf(READ)
    def take(texts: pd.Series) -> pd.DataFrame:
        common, rows, kind = sent.value, [], packing(end)
        for at in range(0, len(texts), ROWS_HELD):
            split_ = [split(x) for x in texts.iloc[at : at + ROWS_HELD]]
            for some, ids in zip(split_, subwords(*tokens).ids(split_), strict=True):
                shares = [x for x in map(common.get, some) if x is not None]
                rare = Counter(w for w in some if w not in common) if len(shares) < len(some) else {}
                rows.append((len(some), fsum(shares), len(shares), ids.astype(kind).tobytes(), list(rare), list(rare.values())))
        return pd.DataFrame(rows, columns=["n_words", "base", "known", "ids", "rare", "times"])

    judged = own.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("number"), take("text").alias("j")).select("doc_id", "held_out", "number", "j.*")
    judged = written(judged.withColumn("at", F.monotonically_increasing_id()), "judged")
    sent.destroy()
    model = spark.sparkContext.broadcast(replace(trained(judged.filter("NOT held_out"), model), memory={}, words=spelt_words))

    @F.pandas_udf("double")
    def probability(ids: pd.Series) -> pd.Series:
        subwords.cache_clear()
        kind = packing(end)
        some = [[unpacked([x], kind) for x in ids.iloc[at : at + ROWS_HELD]] for at in range(0, len(ids), ROWS_HELD)]
        return pd.Series(np.concatenate([np.empty(0), *map(model.value.score, some)]) / np.log(10))

    # An unknown word's count is 0; log10 of Spark and of the driver agree to the last digits of a double.
    met = judged.select("at", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("at", F.col("r.rare").alias("word"), "r.times")
    met = met.join(words, "word", "left")
    count = F.coalesce("n", F.lit(0))
    rare = met.groupBy("at").agg(
        F.sum(F.col("times") * F.log10((count + 0.1) / F.lit(float(floor)))).alias("rare_base"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    both = judged.select("at", "doc_id", "held_out", "n_words", "known", "base", probability("ids").alias("score"))
    both = written(both, "scored").join(rare, "at", "left")
    model.destroy()
    return both.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + share(ends)).alias("base_score"),
        "score",
    )


def op6_attention(spark, sf_dir: str) -> DataFrame:
    """Base and attention scores of every document."""
    import public_tokenizers

    return scored(table(spark, sf_dir, "documents"), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {"op6_attention": op6_attention}
