"""Near-duplicate documents by improved consistent weighted sampling.

Weights are TF-IDF of five-word shingles; a text of fewer words, but not none, is
one shingle. Document frequencies come from a counting sketch over all documents
with a fixed number of counters, less the sketch's mean noise. ``BANDS`` x ``ROWS``
samples are banded. The more copies a text has, the less its shingles weigh beside
those of an edit, so near copies within large groups fall under any threshold of such
weights. Hence ``PLAIN`` further bands are sampled by term frequencies alone, which no
other document changes. Members of a bucket are verified by weighted Jaccard similarity
of ``THRESHOLD`` or more over whole texts, by TF-IDF or by term frequencies, and links
make classes. Before texts are read for that, pairs are screened by their weights and
by four bits of each sample: of two texts at the threshold, ``UNLIKE`` or more of the
samples of either kind differ there in fewer than one pair of 10,000.

The randomness of a sample (two Gammas and a uniform) is taken from a table of
``TABLE`` triples by the shingle's hash; shingles that meet there are told apart by
their hashes.

Exact copies are one node, told from others by a 64-bit hash of the text. Null and wordless texts are never duplicates. Rows
repeated with equal id and text are copies like others. Unlike texts under one id,
or under none, are documents of their own. A class is named by the
least id of its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, checkpoint, discard, mix, rolling, run_starts, slices, sum_vectors, vector_rows
from .graph import SLOTS, cluster

SHINGLE = 5
BANDS, ROWS = 16, 4
PLAIN = 8
THRESHOLD = 0.8
SKETCH = 1 << 20
TABLE_BITS = 14
TABLE = 1 << TABLE_BITS
HASH_BITS = 48
#: Of the samples by TF-IDF, and of those by term frequencies.
UNLIKE = (26, 17)
#: 64-bit words with four bits of each sample.
LANES = (BANDS * ROWS // 16, PLAIN * ROWS // 16)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, how often they occur, and where texts begin."""
    w = Words(column, ALNUM)
    h = w.hashes()
    n = np.diff(w.first)
    at = run_starts(w.first, SHINGLE)
    s = rolling(h, SHINGLE)[at] if len(at) else np.zeros(0, U64)
    doc = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        one = np.zeros(len(short), U64)
        for k, d in enumerate(short.tolist()):
            run = h[w.first[d] : w.first[d + 1]]
            one[k] = rolling(run, len(run))[0]
        s, doc = np.concatenate([s, one]), np.concatenate([doc, short])
    s = s >> U64(64 - HASH_BITS)
    if len(n) < 1 << 64 - HASH_BITS:  # one sort of numbers with the text above the hash
        key = np.sort(doc.astype(U64) << U64(HASH_BITS) | s)
        s, doc = key & U64((1 << HASH_BITS) - 1), (key >> U64(HASH_BITS)).astype(np.int64)
    else:
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    tf = np.diff(np.append(start, len(s)))
    return s[start], tf, np.concatenate([[0], np.cumsum(np.bincount(doc[start], minlength=len(n)))])


class Idf:
    """Inverse document frequencies, at least 1 and in steps of a quarter, by the sketch's counters."""

    def __init__(self, counters: np.ndarray, docs: int) -> None:
        noise = counters.sum() / len(counters)
        df = np.maximum(counters - noise, 1.0)
        self.level = np.clip(np.round(4 * (1.0 + np.log(max(docs, 1) / np.minimum(df, max(docs, 1))))), 4, 255).astype(np.uint8)

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.level[(s >> U64(HASH_BITS - 20)).astype(np.int64)]


def fit(docs: DataFrame) -> Idf:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(SKETCH + 1), 0
        for b in slices(batches, "text"):
            total[:SKETCH] += np.bincount((shingles(b.column(0))[0] >> U64(HASH_BITS - 20)).astype(np.int64), minlength=SKETCH)
            docs += b.num_rows
        total[SKETCH] = docs
        yield vector_rows(total)

    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    got = sum_vectors(text.mapInArrow(run, "slice int, data binary"), SKETCH + 1)
    return Idf(got[:SKETCH], int(got[SKETCH]))


class Sampler:
    """Samples by ``ln a = ln c - r (t - beta + 1)``, ``t = floor(ln w / r + beta)``; the least ``a`` wins."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        k = (BANDS + PLAIN) * ROWS
        r = rng.gamma(2.0, 1.0, (k, TABLE)).astype(np.float32)
        log_c = np.log(rng.gamma(2.0, 1.0, (k, TABLE))).astype(np.float32)
        beta = rng.random((k, TABLE)).astype(np.float32)
        self.fields = np.stack([r, 1 / r, beta, log_c - r + r * beta], axis=2)  # one look-up fetches all four
        self.turn = rng.integers(1, 1 << 63, k, dtype=np.int64).astype(U64) | U64(1)

    def bands(self, s: np.ndarray, tf: np.ndarray, weight: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes (texts x BANDS + PLAIN) of texts that all have a shingle, the band's number in the lowest bits, and four bits of each sample (texts x LANES)."""
        by_kind = [np.log(x).astype(np.float32) for x in (weight, tf)]
        sizes = np.diff(first)
        out = np.zeros((len(sizes), BANDS + PLAIN), U64)
        bits = np.zeros((len(sizes), sum(LANES)), U64)
        h = mix(s)
        for k in range((BANDS + PLAIN) * ROWS):
            log_w = by_kind[k >= BANDS * ROWS]
            own = h * self.turn[k]
            x = self.fields[k].take((own >> U64(64 - TABLE_BITS)).view(np.int64), axis=0, mode="clip")
            t = np.floor(log_w * x[:, 1] + x[:, 2])
            a = x[:, 3] - x[:, 0] * t
            least = np.minimum.reduceat(a, first[:-1])
            tie = np.flatnonzero(a == np.repeat(least, sizes))
            doc = np.searchsorted(first, tie, "right") - 1
            if len(tie) > len(sizes):  # shingles that meet in the table
                order = np.lexsort((own[tie], doc))
                _, one = np.unique(doc[order], return_index=True)
                tie = tie[order[one]]
            sample = mix(s[tie] + t[tie].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))
            out[:, k // ROWS] = out[:, k // ROWS] * U64(0xD6E8FEB86659FD93) + sample
            bits[:, k // 16] |= (sample >> U64(60)) << U64(4 * (k % 16))
        number = np.arange(BANDS + PLAIN, dtype=U64)
        return mix(out + number * U64(0x9E3779B97F4A7C15)) & ~U64(SLOTS - 1) | number, bits


def _feature(s: np.ndarray, tf: np.ndarray, level: np.ndarray) -> bytes:
    return s.tobytes() + tf.astype(np.uint32).tobytes() + level.tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """The greater of the weighted Jaccard similarities by TF-IDF and by term frequencies."""
    (sa, ta, la), (sb, tb, lb) = ((np.frombuffer(x, U64, n), np.frombuffer(x, np.uint32, n, 8 * n).astype(np.int64), np.frombuffer(x, np.uint8, n, 12 * n)) for x, n in ((a, len(a) // 13), (b, len(b) // 13)))
    k = np.minimum(np.searchsorted(sa, sb), len(sa) - 1)
    hit = sa[k] == sb
    both = np.minimum(ta[k[hit]], tb[hit])
    tf, tf_idf = int(both.sum()), int((both * lb[hit]).sum())  # a shingle's level is the same in all texts
    return max(tf / (int(ta.sum() + tb.sum()) - tf), tf_idf / (int((ta * la).sum() + (tb * lb).sum()) - tf_idf))


def _sketches(bits: np.ndarray, *totals: np.ndarray) -> list[bytes]:
    """Of each text: its bits and its two total weights."""
    return [x.tobytes() for x in np.concatenate([bits, np.stack([t.astype(np.float64) for t in totals], axis=1).view(U64)], axis=1)]


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), U64).reshape(len(values), sum(LANES) + 2)


def _may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the texts of sketches, row by row, may be alike by one of the two kinds of weights."""
    z = x[..., : sum(LANES)] ^ y[..., : sum(LANES)]
    z |= z >> U64(2)
    z = (z | z >> U64(1)) & U64(0x1111111111111111)
    n = np.bitwise_count(z)
    u, v = (np.ascontiguousarray(m[..., sum(LANES) :]).view(np.float64) for m in (x, y))
    # The lighter of two alike texts has at least THRESHOLD of the other's weight (less what sums of floats may differ by).
    heavy = np.minimum(u, v) >= (THRESHOLD - 1e-6) * np.maximum(u, v)
    return (n[..., : LANES[0]].sum(axis=-1) < UNLIKE[0]) & heavy[..., 0] | (n[..., LANES[0] :].sum(axis=-1) < UNLIKE[1]) & heavy[..., 1]


def may_be_alike(values: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    m = _matrix(values)
    return lambda r, at: _may(m[at], m[r])


def _key(docs: DataFrame) -> F.Column:
    """Tells rows apart, by id and text."""
    return F.xxhash64(docs["doc_id"], docs["text"].cast("string"))


def _told(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, g, alone)`` of every row: its class, and whether it has neither id nor words, so that others of its key are no copies."""
    sc = docs.sparkSession.sparkContext
    idf = fit(docs)
    shared = sc.broadcast(idf.level)  # SKETCH bytes

    def weigher() -> Idf:
        i = Idf.__new__(Idf)
        i.level = shared.value
        return i

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf = Sampler(), weigher()
        for b in slices(batches, "text", 1 << 20):
            s, tf, first = shingles(b.column(3))
            w = tf * (idf.of(s) / 4.0)
            full = np.flatnonzero(np.diff(first))
            bands: list = [None] * b.num_rows
            sketches: list = [None] * b.num_rows
            if len(full):
                begin = np.append(first[full], first[-1])
                found, bits = sampler.bands(s, tf, w, begin)
                for d, x, y in zip(full.tolist(), found.view(np.int64).tolist(), _sketches(bits, *(np.add.reduceat(v, begin[:-1]) for v in (w, tf))), strict=True):
                    bands[d], sketches[d] = x, y
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["key", "doc_id", "node", "bands", "sketch"])

    kind = dict(docs.dtypes)["doc_id"]
    text = F.col("text").cast("string")
    rows = docs.select(_key(docs).alias("key"), "doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("node"), text.alias("text"))
    # Copies share a node; one of them stands for it.
    each = checkpoint(rows.mapInArrow(sketch, f"key bigint, doc_id {kind}, node bigint, bands array<bigint>, sketch binary"))
    stands = checkpoint(each.where("bands is not null").groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    members = stands.select("node", F.explode("bands").alias("bucket")).select("bucket", "node")

    def worth(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    keep = _may(*(_matrix(b.column(i).to_pylist()) for i in (2, 3)))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

        one, two = (stands.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")

    def features(nodes: DataFrame) -> DataFrame:
        wanted = nodes.join(stands.select("node", "key"), "node")
        found = rows.join(wanted, ["key", "node"]).select("node", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf = weigher()
            for b in slices(batches, "text", 1 << 20):
                s, tf, first = shingles(b.column(1))
                level = idf.of(s)
                f = [_feature(s[lo:hi], tf[lo:hi], level[lo:hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.binary())], names=["node", "f"])

        return found.mapInArrow(run, "node bigint, f binary").dropDuplicates(["node"])

    labels = cluster(members, features, lambda a, b: similarity(a, b) >= THRESHOLD, worth, may_be_alike, stands.select("node", "sketch"))
    group = F.when(F.col("bands").isNull(), F.concat(F.lit("-"), F.col("key").cast("string"))).otherwise(F.coalesce("label", "node").cast("string"))
    alone = F.col("bands").isNull() & F.col("doc_id").isNull()
    out = checkpoint(each.join(labels, "node", "left").select("key", "doc_id", group.alias("g"), alone.alias("alone")))
    discard(each, stands, labels)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id, class_size)`` of every row."""
    told = _told(docs)
    per = checkpoint(told.groupBy("g").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    return told.join(per, "g").select("doc_id", "class_id", F.when(F.col("alone"), F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("class_size"))


def first_of_class(docs: DataFrame) -> DataFrame:
    """Documents, all columns, one row of each class: that with the least id, one without an id only where none has one."""
    told = _told(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r")
    kept = told.groupBy("g").agg(least).select("g", F.col("r.key").alias("stays"))
    per = told.groupBy("key", "g").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("alone"))
    # Rows that go, and those repeated with equal id and text, of which one stays; all others are not looked up twice.
    fate = checkpoint(per.join(kept, "g").where("not alone and (key <> stays or n > 1)").select(F.col("key").alias("_key"), (F.col("key") == F.col("stays")).alias("_stays")))
    discard(told)
    keyed = docs.withColumn("_key", _key(docs)).join(fate, "_key", "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.where("_stays is null").select(*columns).union(keyed.where("_stays").dropDuplicates(["_key"]).select(*columns))
