"""Exact top-k inner products by elimination with a pivot table.

Every vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared
norm, and a query gets 0 there; then the largest inner product is the least
distance. Distances of all rows to many pivots are precomputed. The largest
difference of two pivot distances bounds a distance from below, so a score from
above.

The index holds rows by their nearest pivot in blocks of up to ``ROW_BLOCK``, with the
range of each pivot distance over the block; queries lie in blocks of up to
``QUERY_BLOCK`` alike. Each query begins with the k-th best score over the rows of the
pivots' sample. Pairs of blocks that no query can gain from, by the ranges alone, never
meet. The others are met by a join, and a query block takes its row blocks in the order
of bounds: those under the k-th score of every query end it; in the rest the queries
whose own bound for the block reaches their k-th score are scored, all at once, by one
product of matrices, and rows are eliminated that do not reach it. Scores are integers
and exact: products that doubles cannot hold are made of integers.

Vectors that are null or hold null or non-finite components take no part; shorter
ones count as filled up with zeros. Rows of one id are one vector, the least. Scores
must stay under 2^63 in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard

PIVOTS = 32
PIVOT_SAMPLE = 2048
QUERY_BLOCK = 1024
ROW_BLOCK = 1024
SCALE = 64
#: Row blocks that a query block takes in one turn; each turn keeps its best rows.
TURN = 64
BLOCK = "block bigint, ids binary, v binary, lo binary, hi binary"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of each component, rows that take part only."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint"))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select("vec_id", ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    offs = column.offsets.to_numpy()
    n = np.diff(offs)
    flat = column.values.to_numpy(zero_copy_only=False)
    if len(flat):
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], n)] = flat[offs[0] : offs[-1]]
    return out


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    f = v.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(most - (f * f).sum(axis=1), 0.0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


class Pivots:
    """Pivots far from each other, out of a bounded sample of rows."""

    def __init__(self, sample: np.ndarray, most: float, count: int = PIVOTS) -> None:
        self.most, self.width = most, sample.shape[1]
        points = _lifted(sample, most)
        chosen = [0] if len(points) else []
        far = _distances(points, points[:1])[:, 0] if len(points) else np.zeros(0)
        while len(chosen) < min(count, len(points)):
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
        self.points = points[chosen]

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        return _distances(_lifted(v, self.most), self.points)

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return _distances(np.hstack([v.astype(np.float64), np.zeros((len(v), 1))]), self.points)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all queries and rows, exact."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1]) < 2.0**52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


class Best:
    """The k best rows so far of each query of a block, by score then least id."""

    def __init__(self, pivots: Pivots, ids: np.ndarray, v: np.ndarray, k: int, sample: np.ndarray | None = None) -> None:
        self.pivots, self.ids, self.v, self.k = pivots, ids, v, k
        self.d = pivots.of_queries(v)
        self.norm = (v.astype(np.float64) ** 2).sum(axis=1)
        self.query, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -np.inf)  # a score that the k-th reaches
        self.evaluated = 0
        if sample is not None and len(sample) > k:  # one more than k, as a query may itself be in the sample
            self.least = np.partition(_scores(v, sample), len(sample) - k - 1, axis=1)[:, len(sample) - k - 1].astype(np.float64)

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """What no score with a row whose pivot distances lie in the ranges exceeds, for each query."""
        low = np.maximum(np.maximum(lo - self.d, self.d - hi), 0.0).max(axis=1, initial=0.0)
        whole = self.norm + self.pivots.most
        return (whole - low * low) / 2.0 + (1.0 + 1e-7 * whole)  # rounding errors of the bound stay below what is added

    def offer(self, ids: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Exact for all rows: only queries that cannot gain are left out, never those whose bound is equal."""
        live = np.flatnonzero(self.bounds(lo, hi) >= self.least)
        if not len(live):
            return
        score = _scores(self.v[live], v)
        self.evaluated += score.size
        q, r = np.nonzero(score >= self.least[live, None])
        keep = ids[r] != self.ids[live[q]]
        q, r = q[keep], r[keep]
        self.query, self.row, self.score = (np.concatenate(x) for x in ((self.query, live[q]), (self.row, ids[r]), (self.score, score[q, r])))
        order = np.lexsort((self.row, -self.score, self.query))
        query = self.query[order]
        rank = np.arange(len(order)) - np.searchsorted(query, query)
        order = order[rank < self.k]
        self.query, self.row, self.score = self.query[order], self.row[order], self.score[order]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.ids)) == self.k)
        last = np.searchsorted(self.query, full, "right") - 1
        self.least[full] = np.maximum(self.least[full], self.score[last])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.row), pa.array(self.score)], names=["query_id", "vec_id", "score"])


def _pivots(vectors: DataFrame) -> tuple[Pivots, np.ndarray]:
    """Pivots and the bounded sample of rows that they come from."""
    top = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)), F.max(F.size("v"))).first()
    most, width = float(top[0] or 0.0), int(top[1] or 0)
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    sample = np.zeros((len(some), width), np.int64)
    for i, r in enumerate(some):
        sample[i, : len(r["v"])] = r["v"]
    return Pivots(sample, most), sample


def blocks(vectors: DataFrame, pivots: Pivots, size: int, queries: bool = False) -> DataFrame:
    """Rows by their nearest pivot, in blocks of ``size`` with the ranges of their pivot distances."""
    width = pivots.width
    kind = "vec_id bigint, cell int, v binary, d binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), width)
            d = pivots.of_queries(v) if queries else pivots.of_rows(v)
            cell = d.argmin(axis=1) if d.shape[1] else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in d], pa.binary())], names=["vec_id", "cell", "v", "d"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _regrouped(batches, size):
            v, d = (np.frombuffer(b"".join(t.column(i).to_pylist()), x).reshape(t.num_rows, -1) for i, x in ((2, np.int64), (3, np.float64)))
            lo, hi = (d.min(axis=0), d.max(axis=0)) if d.shape[1] else (np.zeros(0), np.zeros(0))
            cols = [pa.array([x.tobytes()], pa.binary()) for x in (t.column(0).to_numpy(), v, lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array([int(t.column(0)[0].as_py())]), *cols], names=["block", "ids", "v", "lo", "hi"])

    # Cells may be of any size: rows are ordered by cell and id over all tasks, and cut where a block is full.
    placed = vectors.mapInArrow(place, kind)
    return placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").mapInArrow(build, BLOCK)


def _regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last one smaller."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _floats(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.float64)


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of each row for which ``is_query`` holds."""
    held = checkpoint(scaled(vectors, scale))
    pivots, sample = _pivots(held)
    width, most = pivots.width, pivots.most
    shared = held.sparkSession.sparkContext.broadcast((pivots, sample))  # PIVOT_SAMPLE rows at most
    rows = checkpoint(blocks(held, pivots, ROW_BLOCK))
    asked = checkpoint(blocks(held.where(is_query), pivots, QUERY_BLOCK, queries=True))
    discard(held)

    def begin(ids: bytes, v: bytes) -> Best:
        pivots, sample = shared.value
        return Best(pivots, np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(-1, width), k, sample)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the queries of a block need at least, and the largest norm among them."""
        for b in batches:
            best = [begin(i.as_py(), v.as_py()) for i, v in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array([float(x.least.min()) for x in best]), pa.array([float(x.norm.max()) for x in best])], names=["query_block", "lo", "hi", "least", "norm"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks with a bound that reaches what is needed, from the ranges alone."""
        for b in batches:
            out: list[tuple[int, int, float]] = []
            for q, lo, hi, least, norm, others in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                lo, hi = _floats(lo), _floats(hi)
                for o in others:
                    gap = np.maximum(np.maximum(_floats(o["lo"]) - hi, lo - _floats(o["hi"])), 0.0).max(initial=0.0)
                    bound = (norm + most - gap * gap) / 2.0 + 1.0 + 1e-7 * (norm + most)
                    if bound >= least:
                        out.append((q, o["block"], bound))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_block", "block", "bound"])

    # The ranges of the rows' blocks, about 1,024 in a line, go to each query block: one line for a million rows.
    many = rows.count()
    line = rows.select(F.pmod(F.xxhash64("block"), F.lit(max(1, -(-many // 1024)))).alias("line"), F.struct("block", "lo", "hi").alias("o")).groupBy("line").agg(F.collect_list("o").alias("others"))
    lines = checkpoint(line)
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, -(-many // 1024)) - 1).cast("bigint"))).alias("line")
    needed = asked.mapInArrow(reach, "query_block bigint, lo binary, hi binary, least double, norm double")
    pairs = needed.select("*", numbers).join(lines.select(F.col("line").cast("bigint"), "others"), "line").select("query_block", "lo", "hi", "least", "norm", "others")
    pairs = checkpoint(pairs.mapInArrow(meet, "query_block bigint, block bigint, bound double"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for i in range(b.num_rows):
                bound, ids, v, lo, hi = (b.column(j)[i].as_py() for j in range(2, 7))
                if lo is None:  # the queries come first
                    if best is not None:
                        yield best.batch()
                    best = begin(ids, v)
                elif bound >= best.least.min():
                    best.offer(np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(-1, width), _floats(lo), _floats(hi))
        if best is not None:
            yield best.batch()

    turns = max(1, -(-many // TURN))
    turn = F.pmod(F.xxhash64("block"), F.lit(turns)).alias("turn")
    theirs = pairs.join(rows, "block").select("query_block", turn, "bound", "ids", "v", "lo", "hi")
    nothing = F.lit(None).cast("binary")
    asking = asked.join(pairs.select("query_block", turn).distinct().withColumnRenamed("query_block", "block"), "block").select(F.col("block").alias("query_block"), "turn", F.lit(float("inf")).alias("bound"), "ids", "v", nothing.alias("lo"), nothing.alias("hi"))
    dealt = asking.union(theirs).repartition("query_block", "turn").sortWithinPartitions("query_block", "turn", F.desc("bound"))
    found = checkpoint(dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint"))
    discard(rows, asked, lines, pairs)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
