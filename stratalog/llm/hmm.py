"""Hidden Markov language model over words.

Counts of all training words are kept exactly in a table. The model's symbols are
the ``SYMBOLS`` most frequent words and one for all others; a rare or unseen word's
share of that symbol is its share in the unigram base, so the model gives a
probability to every text over the same events as the base. Symbols of all training
texts are written once. Expected counts of each Baum-Welch pass are made by all
partitions and summed in slices; the driver gets one vector of the model's size.
Passes over all training texts go on until the likelihood gains less than
``SETTLED`` of itself, ``PASSES`` at most; the first guess comes from a bounded sample.

Likelihoods and expected counts are exact, of whole texts: those of up to ``WHOLE``
tokens go through the scaled recursions side by side; longer ones are cut into
segments whose transfer matrices, multiplied in order, give each segment the messages
from before and behind it, and moves across cuts count like others.

Null and empty texts are the end token alone. Repeated rows count and score each. A
null id is held out from nothing: its row is not learned from.
Without training rows every token is unknown with probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, U64, Words, checkpoint, discard, id_remainder, slices, sum_vectors, vector_rows

SYMBOLS = 8192
KNOWN = 1 << 18
STATES = 8
PASSES = 3
SETTLED = 1e-3
FIRST_PASSES = 25
WHOLE = 1024
SAMPLE_TEXTS = 400
PRIOR = 30.0
END = U64(0)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token (0) after each text, and where texts begin."""
    w = Words(column, NOT_SPACE)
    h = w.hashes()
    h[h == END] = U64(1)
    return np.insert(h, w.first[1:], END), w.first + np.arange(len(w.first))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(h, c)``: how often each token occurs in all texts. Counted within tasks before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return h, np.bincount(inverse, weights=np.concatenate([x[1] for x in held])).astype(np.int64)

        for b in slices(batches, "text"):
            h, c = np.unique(tokens(b.column(0))[0], return_counts=True)
            held.append((h, c))
            size += len(h)
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "c"])
                    held, size = [], 0
        if held:
            h, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Exact totals, and hashes and counts of at most ``KNOWN`` words; the most frequent are the model's symbols."""

    def __init__(self, total: int, distinct: int, h: np.ndarray, c: np.ndarray) -> None:
        self.total, self.distinct = total, distinct
        symbols = min(SYMBOLS, len(h))
        self.rare = symbols
        self.p0 = np.append((c[:symbols] + 1.0), 0.0) / (total + distinct + 1.0)
        self.p0[-1] = max(1.0 - self.p0[:-1].sum(), 1e-300)
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.symbol = np.where(order < symbols, order, symbols).astype(np.int32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count of each token; count -1 where it is not held here."""
        if not len(self.h):
            return np.zeros(len(h), np.int32), np.full(len(h), -1, np.int64)
        uniq, inverse = np.unique(h, return_inverse=True)
        k = np.minimum(np.searchsorted(self.h, uniq), len(self.h) - 1)
        hit = self.h[k] == uniq
        return np.where(hit, self.symbol[k], self.rare).astype(np.int32)[inverse], np.where(hit, self.c[k], -1)[inverse]


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def guess(cls, p0: np.ndarray, states: int = STATES, seed: int = 3) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = p0 * rng.gamma(2.0, 0.5, (states, len(p0)))
        move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
        return cls(np.full(states, 1.0 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def flat_size(self) -> int:
        s = len(self.start)
        return s + s * s + s * self.emit.shape[1] + 1

    def _transfer(self, table: np.ndarray, symbol: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled products of emissions and moves over each segment, without the move into its first token, and the log10 of their scales."""
        s = len(self.start)
        order = np.argsort(-size, kind="stable")
        ranked, b = size[order], begin[order]
        live = np.searchsorted(-ranked, -np.arange(int(ranked[0])), "left")
        m = np.broadcast_to(np.eye(s), (len(size), s, s)).copy()
        log = np.zeros(len(size))
        for t, n in enumerate(live.tolist()):
            x = m[:n] if t == 0 else m[:n] @ self.move
            x = x * table[symbol[b[:n] + t]][:, None, :]
            c = np.maximum(x.max(axis=(1, 2), keepdims=True), 1e-300)
            m[:n] = x / c
            log[:n] += np.log10(c[:, 0, 0])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return m[back], log[back]

    def _messages(self, table: np.ndarray, symbol: np.ndarray, begin: np.ndarray, size: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: states before its first token, weights of the states of its last one by what follows, and log10 likelihood of texts of several segments at their first one."""
        before, behind, log = np.tile(self.start, (len(size), 1)), np.ones((len(size), len(self.start))), np.zeros(len(size))
        many = np.flatnonzero(~lead | np.append(~lead[1:], False))
        if not len(many):
            return before, behind, log
        m, scale = self._transfer(table, symbol, begin[many], size[many])
        head = lead[many]
        number = np.arange(len(many)) - np.maximum.accumulate(np.where(head, np.arange(len(many)), 0))
        a = np.tile(self.start, (len(many), 1))
        own = np.zeros(len(many))
        for k in range(int(number.max()) + 1):
            pick = np.flatnonzero(number == k)
            x = np.einsum("ns,nst->nt", a[pick], m[pick])
            c = np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
            own[pick] = np.log10(c[:, 0]) + scale[pick]
            onward = pick[(pick + 1 < len(many)) & ~head[np.minimum(pick + 1, len(many) - 1)]]
            a[onward + 1] = (x / c)[np.searchsorted(pick, onward)] @ self.move
        z = np.ones((len(many), len(self.start)))
        for k in range(int(number.max()), 0, -1):
            pick = np.flatnonzero(number == k)
            x = np.einsum("nst,nt->ns", m[pick], z[pick]) @ self.move.T
            z[pick - 1] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
        before[many], behind[many] = a, z
        firsts = np.flatnonzero(head)
        log[many[firsts]] = np.add.reduceat(own, firsts)
        return before, behind, log

    def expected(self, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Expected counts over whole texts, flat: start, moves, emissions, log10 likelihood."""
        s, v = self.emit.shape
        out = np.zeros(self.flat_size())
        begin, size, lead = segments(first)
        if not len(size):
            return out
        table = np.ascontiguousarray(self.emit.T)
        before, behind, _ = self._messages(table, symbol, begin, size, lead)
        order = np.argsort(-size, kind="stable")
        begin, size, lead, before, behind = (x[order] for x in (begin, size, lead, before, behind))
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # lanes with more than t tokens
        alpha, scale = [], []
        a = before
        for t, n in enumerate(live.tolist()):
            if t:
                a = a[:n] @ self.move
            a = a * table[symbol[begin[:n] + t]]
            c = np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
            a = a / c
            alpha.append(a)
            scale.append(c)
            out[-1] += np.log10(c).sum()
        moves = np.zeros((s, s))
        gamma_all = np.zeros((int(size.sum()), s))
        where = np.zeros(len(gamma_all), np.int64)
        at = len(gamma_all)
        beta = np.zeros((0, s))
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            if len(beta) < n:  # lanes that end here
                ends = alpha[t][len(beta) : n]
                z = behind[len(beta) : n]
                beta = np.vstack([beta, z / np.maximum((ends * z).sum(axis=1, keepdims=True), 1e-300)])
            g = alpha[t] * beta
            g /= np.maximum(g.sum(axis=1, keepdims=True), 1e-300)
            at -= n
            gamma_all[at : at + n], where[at : at + n] = g, symbol[begin[:n] + t]
            f = beta * table[symbol[begin[:n] + t]] / scale[t]
            if t:
                moves += alpha[t - 1][:n].T @ f
                beta = f @ self.move.T
            else:
                out[:s] = g[lead].sum(axis=0)
                # Moves across cuts: from what the segment before ends in, which ``before`` was made of.
                cut = np.flatnonzero(~lead)
                if len(cut):
                    back = np.empty_like(order)
                    back[order] = np.arange(len(order))
                    prior = back[order[cut] - 1]
                    last = np.stack([alpha[size[p] - 1][p] for p in prior.tolist()])
                    moves += last.T @ f[cut]
        out[s : s + s * s] = (moves * self.move).ravel()
        for k in range(s):
            lo = s + s * s + k * v
            out[lo : lo + v] = np.bincount(where, weights=gamma_all[:, k], minlength=v)
        return out

    def updated(self, counts: np.ndarray, p0: np.ndarray, prior: float = PRIOR) -> Hmm:
        s, v = self.emit.shape
        start = counts[:s] + 0.1
        move = counts[s : s + s * s].reshape(s, s) + 0.1
        emit = counts[s + s * s : -1].reshape(s, v) + prior * p0
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def log10(self, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each text's symbols."""
        begin, size, lead = segments(first)
        table = np.ascontiguousarray(self.emit.T)
        total = self._messages(table, symbol, begin, size, lead)[2]
        alone = np.flatnonzero(lead & np.append(lead[1:], True))
        order = alone[np.argsort(-size[alone], kind="stable")]
        if len(order):
            b = begin[order]
            a = np.tile(self.start, (len(order), 1))
            log = np.zeros(len(order))
            for t, n in enumerate(np.searchsorted(-size[order], -np.arange(int(size[order[0]])), "left").tolist()):
                a = (a[:n] if t == 0 else a[:n] @ self.move) * table[symbol[b[:n] + t]]
                c = np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
                a = a / c
                log[:n] += np.log10(c[:, 0])
            total[order] = log
        return total[lead]


def segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, size, and whether it leads its text, of segments of WHOLE tokens at most; every text has a token."""
    n = np.diff(first)
    parts = -(-n // WHOLE)
    begin = np.repeat(first[:-1] - (np.cumsum(parts) - parts) * WHOLE, parts) + np.arange(int(parts.sum())) * WHOLE
    end = np.minimum(begin + WHOLE, np.repeat(first[1:], parts))
    return begin, end - begin, begin == np.repeat(first[:-1], parts)


def fit(train: DataFrame) -> tuple[DataFrame, Vocabulary, Hmm]:
    """The counts of all training tokens, the vocabulary and the trained model."""
    sc = train.sparkSession.sparkContext
    counts = checkpoint(word_counts(train))
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Words above a count such that there are KNOWN at most, by a histogram of counts: tasks send no more than is taken.
    step = F.floor(F.log2("c") * 32)
    room, least = KNOWN, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        room -= r["n"]
        if room < 0:
            least = r["step"] + 1
            break
    top = counts.where(step >= least).toPandas().sort_values(["c", "h"], ascending=[False, True])
    words = Vocabulary(int(n["n"]), int(n["v"]), top["h"].to_numpy(np.int64).view(U64), top["c"].to_numpy(np.int64))
    model = Hmm.guess(words.p0)
    if not words.total:
        return counts, words, model
    text = F.col("text").cast("string")
    share = int(min(1.0, 1.5 * SAMPLE_TEXTS * 1.0 / max(1, train.count())) * 2**31)
    some = train.where(text.isNotNull()).select(F.xxhash64(text).alias("h"), text.alias("text")).where(F.pmod("h", F.lit(2**31)) < share)
    sample = [r["text"] for r in some.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(SAMPLE_TEXTS).collect()]
    if sample:  # a guess to start from; the passes below are over all training texts
        for _ in range(FIRST_PASSES):
            total = np.zeros(model.flat_size())
            for i in range(0, len(sample), 100):
                h, first = tokens(pa.array(sample[i : i + 100], pa.large_string()))
                total += model.expected(words.look_up(h)[0], first)
            model = model.updated(total, words.p0)
    known = sc.broadcast(words)  # KNOWN words

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            h, first = tokens(b.column(0))
            raw = known.value.look_up(h)[0].astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[2 * lo : 2 * hi] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], names=["symbols"])

    coded = checkpoint(train.select(text.alias("text")).mapInArrow(code, "symbols binary"))
    likelihood = -np.inf
    for _ in range(PASSES):
        shared = sc.broadcast(model)  # STATES x SYMBOLS numbers

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            total = np.zeros(model.flat_size())
            for b in slices(batches, "symbols", 1 << 19):
                rows = b.column(0).to_pylist()
                total += model.expected(np.frombuffer(b"".join(rows), np.uint16), np.cumsum([0, *(len(x) // 2 for x in rows)]))
            yield vector_rows(total)

        total = sum_vectors(coded.mapInArrow(run, "slice int, data binary"), model.flat_size())
        shared.destroy()
        model = model.updated(total, words.p0)
        gain, likelihood = total[-1] - likelihood, float(total[-1])
        if gain < SETTLED * abs(likelihood):
            break
    discard(coded)
    return counts, words, model


SCORED = "doc_id {}, n_tokens bigint, known bigint, log_sum double, n_rare bigint, rare_held double, hmm double, rest array<bigint>"


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: Hmm) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of each row.

    Words outside the broadcast part of the vocabulary get their counts by a join, so that every count is exact.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        for b in slices(batches, "text", 1 << 20):
            h, first = tokens(b.column(1))
            symbol, c = words.look_up(h)
            held = c >= 0
            logs = np.where(held, np.log10(np.maximum(c, 0) + 1.0), 0.0)
            total = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            missing = ~held
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[missing], minlength=b.num_rows))]).astype(np.int32)), pa.array(h[missing].view(np.int64)))
            rare = symbol == words.rare
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(first)), pa.array(total(held.astype(np.int64))), pa.array(total(logs)), pa.array(total(rare.astype(np.int64))), pa.array(total(np.where(rare & held, logs, 0.0))), pa.array(model.log10(symbol, first) if words.total else np.zeros(b.num_rows)), rest],
                names=["doc_id", "n_tokens", "known", "log_sum", "n_rare", "rare_held", "hmm", "rest"],
            )

    text = F.col("text").cast("string").alias("text")
    # Each row gets a number of its own, fixed by what is written.
    rows = checkpoint(docs.select("doc_id", text).mapInArrow(run, SCORED.format(kind))).withColumn("row", F.monotonically_increasing_id())
    found = rows.select("row", F.explode("rest").alias("h")).join(counts, "h", "left")
    per = found.groupBy("row").agg(F.count("c").alias("more"), F.coalesce(F.sum(F.log10(F.col("c") + 1.0)), F.lit(0.0)).alias("logs"))
    j = rows.join(per, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0)), "logs": F.coalesce("logs", F.lit(0.0))})
    unit = float(np.log10(words.total + words.distinct + 1.0))
    rare = float(np.log10(words.p0[-1]))
    base = F.col("log_sum") + F.col("logs") - F.col("n_tokens") * F.lit(unit)
    # A rare token's share of the rare symbol: log10 of its base probability over the symbol's.
    lift = F.col("rare_held") + F.col("logs") - F.col("n_rare") * F.lit(unit + rare)
    return j.select("doc_id", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(words.total).cast("bigint").alias("train_tokens"), base.alias("base_score"), ((F.col("hmm") + lift) if words.total else base).alias("score"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(id_remainder("doc_id", 7) != 2)
