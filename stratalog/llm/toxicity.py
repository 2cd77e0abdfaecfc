"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax.

A word is the mean of the vectors of its byte n-grams (with word ends) and of
itself, so misspellings share most of a known word's vectors. ``WINDOW`` running
words are averaged and go through a linear softmax of two classes; a text scores
as its worst window, over all of its words. Vectors and softmax are trained
together in numpy on whole texts of at most ``SAMPLE`` labelled rows of each
class, chosen by hash; the worst window of a text takes its label.

Null or wordless texts get the score of the bias alone. Labels that are null are
not used; a row labelled twice takes the larger label; an id with several texts gives
an example of each. Repeated rows score each. A null id is held out from nothing, and
no label can have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, U64, Words, id_remainder, mix, slices

BUCKET_BITS = 17
GRAMS = (3, 4, 5)
DIMENSIONS = 12
WINDOW = 12
SAMPLE = 1500
EPOCHS = 12
RATE = 0.5


def _grams(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of the picked words, and where each word's begin."""
    size = words.end[pick] - words.start[pick] + 2
    at = np.concatenate([[0], np.cumsum(size)])
    text = np.full(int(at[-1]), ord("<"), np.uint8)
    inner = np.ones(len(text), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    text[at[1:] - 1] = ord(">")
    text[inner] = words.bytes[np.repeat(words.start[pick] - np.concatenate([[0], np.cumsum(size - 2)[:-1]]), size - 2) + np.arange(int((size - 2).sum()))]
    wide = text.astype(U64) + U64(1)
    word = np.repeat(np.arange(len(pick)), size)
    out, owner = [mix(words_hash(words, pick))], [np.arange(len(pick))]
    for n in GRAMS:
        if len(text) < n:
            continue
        m = len(text) - n + 1
        h = np.full(m, n, U64)
        for j in range(n):
            h = h * U64(0x100000001B3) + wide[j : j + m]
        inside = word[:m] == word[n - 1 :]
        out.append(mix(h[inside]))
        owner.append(word[:m][inside])
    h, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (h[order] >> U64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(pick)))])


def words_hash(words: Words, pick: np.ndarray) -> np.ndarray:
    if getattr(words, "_h", None) is None:
        words._h = words.hashes()
    return words._h[pick]


class Bag:
    """Distinct words of some texts with their n-grams, and the texts as word numbers."""

    def __init__(self, column: pa.Array) -> None:
        w = Words(column, NOT_SPACE)
        self.first = w.first
        w._h = w.hashes()
        _, pick, self.word = np.unique(w._h, return_index=True, return_inverse=True)
        gram, self.at = _grams(w, pick) if len(pick) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.gram = gram.astype(np.int32)

    @classmethod
    def of(cls, texts: list[str], part: int = 1 << 19) -> Bag:
        """Built in parts of about so many characters, so that what is needed meanwhile stays small; words are distinct in each part."""
        cut = np.cumsum([len(t) for t in texts]) // part
        bags = [cls(pa.array([texts[i] for i in np.flatnonzero(cut == k)], pa.large_string())) for k in np.unique(cut)]
        out = cls.__new__(cls)
        chain = lambda arrays: np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for a in arrays]))])
        before = np.cumsum([0, *(len(b.at) - 1 for b in bags)])
        out.first, out.at = chain([b.first for b in bags]), chain([b.at for b in bags])
        out.word = np.concatenate([b.word + k for b, k in zip(bags, before, strict=False)])
        out.gram = np.concatenate([b.gram for b in bags])
        return out

    def word_means(self, value: np.ndarray) -> np.ndarray:
        """Mean over each distinct word's n-grams of a number per bucket."""
        if not len(self.gram):
            return np.zeros(0)
        return np.add.reduceat(value[self.gram], self.at[:-1]) / np.diff(self.at)

    def worst(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the largest window mean (0 if it has no word), its first word and its number of words."""
        s = self.word_means(value)[self.word]
        total = np.concatenate([[0.0], np.cumsum(s)])
        n = np.diff(self.first)
        width = np.minimum(n, WINDOW)
        count = np.where(n > 0, n - width + 1, 0)
        start = np.repeat(self.first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        span = np.repeat(width, count)
        mean = (total[start + span] - total[start]) / np.maximum(span, 1)
        best, where = np.zeros(len(n)), np.zeros(len(n), np.int64)
        full = np.flatnonzero(count)
        if len(full):
            cut = (np.cumsum(count) - count)[full]
            top = np.maximum.reduceat(mean, cut)
            is_top = np.flatnonzero(mean == np.repeat(top, count[full]))
            doc = np.searchsorted(cut, is_top, "right") - 1
            _, one = np.unique(doc, return_index=True)
            best[full], where[full] = top, start[is_top[one]]
        return best, where, width


class Model:
    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.value = (vectors.astype(np.float64) @ (weights[:, 1] - weights[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])

    def score(self, column: pa.Array) -> np.ndarray:
        z = Bag(column).worst(self.value)[0] + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: np.ndarray, seed: int = 1) -> Model:
    """Minibatch Adagrad on vectors, weights and bias together."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    e = (rng.standard_normal((size, DIMENSIONS)) * 0.1).astype(np.float32)
    w = rng.standard_normal((DIMENSIONS, 2)) * 0.5
    b = np.zeros(2)
    if not len(texts) or len(set(labels.tolist())) < 2:
        p = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros_like(e), w, np.array([0.0, np.log((p + 1e-3) / (1 - p + 1e-3))]))
    bag = Bag.of(texts)
    y = labels.astype(np.int64)
    cost = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    ge, gw, gb = np.full((size, DIMENSIONS), 1e-6, np.float32), np.full(w.shape, 1e-6), np.full(2, 1e-6)
    n = np.diff(bag.first)
    for epoch in range(EPOCHS):
        best, where, width = bag.worst((e @ (w[:, 1] - w[:, 0]).astype(np.float32)).astype(np.float64))
        if epoch == 0:  # nothing is known yet: any window of the text
            where = bag.first[:-1] + (rng.random(len(n)) * np.maximum(n - width + 1, 1)).astype(np.int64)
        use = np.flatnonzero(width > 0)
        if epoch < 1:  # first whole texts, in pieces of a window
            rows = [np.arange(bag.first[i], bag.first[i + 1], WINDOW) for i in use]
            doc, where_ = np.repeat(use, [len(r) for r in rows]), np.concatenate(rows)
            begin = where_
            span = np.minimum(WINDOW, bag.first[doc + 1] - begin)
        else:
            doc, begin, span = use, where[use], width[use]
        order = rng.permutation(len(doc))
        for i in range(0, len(order), 256):
            k = order[i : i + 256]
            s, t, m = begin[k], doc[k], span[k]
            word = bag.word[np.repeat(s - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            grams = bag.at[word + 1] - bag.at[word]
            gram = bag.gram[np.repeat(bag.at[word] - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))]
            share = np.repeat(1.0 / (grams * np.repeat(m, m)), grams)
            row = np.repeat(np.repeat(np.arange(len(k)), m), grams)
            cut = np.searchsorted(row, np.arange(len(k)))
            h = np.add.reduceat(e[gram] * share[:, None], cut)
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p.copy()
            g[np.arange(len(k)), y[t]] -= 1.0
            g *= cost[t][:, None] / len(k)
            dh, dw, db = g @ w.T, h.T @ g, g.sum(axis=0)
            uniq, inverse = np.unique(gram, return_inverse=True)
            de = np.empty((len(uniq), DIMENSIONS), np.float32)
            for c in range(DIMENSIONS):
                de[:, c] = np.bincount(inverse, weights=dh[row, c] * share, minlength=len(uniq))
            ge[uniq] += de * de
            e[uniq] -= RATE * de / np.sqrt(ge[uniq])
            gw += dw * dw
            w -= 0.1 * dw / np.sqrt(gw)
            gb += db * db
            b -= 0.1 * db / np.sqrt(gb)
    model = Model(e, w, b)
    # The softmax's bias is trained to the end on the worst windows, the rest as it is.
    model.bias = _bias(bag.worst(model.value)[0], y, cost)
    return model


def _bias(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> float:
    """The bias of the least weighted log loss, by halving: its slope rises throughout."""
    lo, hi = -float(np.abs(z).max(initial=0.0)) - 20.0, float(np.abs(z).max(initial=0.0)) + 20.0
    for _ in range(steps):
        b = (lo + hi) / 2
        slope = float((weight * (1.0 / (1.0 + np.exp(-np.clip(z + b, -500, 500))) - y)).sum())
        lo, hi = (lo, b) if slope > 0 else (b, hi)
    return (lo + hi) / 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows outside the held-out fold; about ``sample`` texts of each class come to the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(id_remainder("doc_id", 5) != 0)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda c: int(min(1.0, 1.1 * sample / max(1, n.get(c, 0))) * 2**31)
    limit = F.when(F.col("toxic") == 1, share(1)).otherwise(share(0))
    chosen = known.where(F.col("toxic").isin(0, 1) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2**31)) < limit))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about 2.2 x sample ids
    got = sorted({(r["doc_id"], r["toxic"], r["text"]) for r in rows.select("doc_id", "toxic", "text").collect()})
    return train([t for _, _, t in got], np.array([y for _, y, _ in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.value.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.value, m.bias = shared.value[0].astype(np.float64), shared.value[1]
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(b.column(1)))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
