"""Clusters from hash buckets: connected components of verified links within buckets.

Every pair of a bucket ends in one component or has been compared. Nodes are 64-bit
numbers without order of their own, so a bucket's least node is one chosen at random,
and the same one in most buckets that a group shares. All members of a bucket are
first held against it. That settles buckets of two nodes, and large groups of copies,
which need no other links. Buckets that still hold more than one component then meet
whole: their members' features come together and all pairs of unlike components are
compared, each pair in the least bucket that it shares, the components growing as
links are found. Buckets of more than ``CHUNK`` bytes are dealt in parts, and each two
parts meet. Where nodes have sketches, these meet first, and features are read only
for nodes with a partner that may be alike. Rows grow with members, and with the
square only of a bucket's number of parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import U64, checkpoint, discard

SLOTS = 32
#: Bytes of one part of a bucket; two meet in a task.
CHUNK = 16 << 20
#: Bytes that a member counts besides its features.
ROW = 512
#: Parts that packed buckets are dealt in, bits of a bucket besides, and members that a task holds before it packs them.
PART_BITS = 11
BITS = 32
PACKED = 1 << 18

#: Of the values of a group: whether the one of a number may be alike those of other numbers.
Screen = Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]


class Forest:
    """Union-find over the links of one task; its trees stand for the links."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):  # noqa: ANN001, ANN201 - nodes are strings or integers
        up = self.up
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def link(self, a, b) -> None:  # noqa: ANN001
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list, list]:
        """Every node that is not a root, with its root."""
        nodes = [x for x, y in self.up.items() if x != y]
        return [self.root(x) for x in nodes], nodes


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of edges ``(a, b)``; the label is the least node.

    Every node takes the least label around it, then its label's label, then the least
    around it again, until that last step changes nothing; one table is written a turn.
    """
    e = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", F.col("a").alias("b"))).union(edges.select(F.col("b").alias("a"), "b")).distinct())
    labels = e.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    if e.isEmpty():
        return labels
    while True:
        near = e.join(labels, e["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = near.join(far, "label", "left").select(F.col("a").alias("node"), F.coalesce(F.least("further", "label"), F.col("label")).alias("label"))
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("label")))
        again = e.join(jumped, e["b"] == jumped["node"]).groupBy("a").agg(F.min("label").alias("label"), own.alias("own"))
        seen = Observation()
        before, labels = labels, checkpoint(again.observe(seen, F.count_if(F.col("label") != F.col("own")).alias("n")).select(F.col("a").alias("node"), "label"))
        discard(before)
        if not seen.get["n"]:
            discard(e)
            return labels


def verified(pairs: DataFrame, features: DataFrame, alike: Callable[[bytes, bytes], bool]) -> DataFrame:
    """Links ``(a, b)`` with the components of those pairs whose features ``(node, f)`` are alike: the trees of each task."""
    left, right = features.toDF("a", "fa"), features.toDF("b", "fb")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "fa", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            fa, fb = batch.column(2), batch.column(3)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if forest.root(a) != forest.root(b) and alike(fa[i].as_py(), fb[i].as_py()):
                    forest.link(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.edges()], names=["a", "b"])

    return joined.mapInArrow(run, "a bigint, b bigint")


def _shared(members: DataFrame) -> DataFrame:
    """``(bucket, node, lo)`` of buckets with more than one node, each member once; ``lo`` is the bucket's least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = low = last = None  # of the last row; whether its bucket's least node is out
        told = False
        for batch in batches:
            if not batch.num_rows:
                continue
            b, n = (batch.column(i).to_numpy() for i in range(2))
            begins = np.append(True, b[1:] != b[:-1])
            fresh = begins.copy()
            fresh[1:] |= n[1:] != n[:-1]
            goes_on = bucket is not None and b[0] == bucket
            if goes_on:
                fresh[0] = n[0] != last
            b, n, begins = b[fresh], n[fresh], begins[fresh]
            if goes_on and len(b):
                begins[0] = b[0] != bucket
            if not len(b):
                continue
            at = np.flatnonzero(begins)
            if goes_on and not begins[0]:
                at = np.append(0, at)
            size = np.diff(np.append(at, len(b)))
            lo = n[at].copy()
            out = size > 1
            extra = []
            if goes_on and not begins[0]:
                lo[0] = low
                out[0] = True
                if not told:
                    extra = [(bucket, low)]
            keep = np.repeat(out, size)
            lo = np.repeat(lo, size)
            bucket, last = b[-1], n[-1]
            low, told = lo[-1], bool(keep[-1])
            first = np.array([x[0] for x in extra], np.int64), np.array([x[1] for x in extra], np.int64)
            cols = [np.concatenate([first[0], b[keep]]), np.concatenate([first[1], n[keep]]), np.concatenate([first[1], lo[keep]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "node", "lo"])

    dealt = members.select("bucket", "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    return checkpoint(dealt.mapInArrow(run, "bucket bigint, node bigint, lo bigint"))


class Dealer:
    """Members ``(bucket, node)`` in packs, one for each of 2^``PART_BITS`` parts of the buckets: what a shuffle moves of them is few long rows.

    A pack holds ``BITS`` bits of each bucket besides its part, then the nodes, then their sizes (0 to 255). Buckets that meet so are
    one, whose members are compared like others.
    """

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def put(self, bucket: np.ndarray, node: np.ndarray, size: np.ndarray) -> None:
        self.held.append((bucket, node, size.astype(np.uint8)))
        self.size += len(bucket)

    def full(self) -> bool:
        return self.size >= PACKED

    def take(self) -> tuple[pa.Array, pa.Array]:
        """``(part, data)`` of what was put since."""
        if not self.size:
            return pa.array([], pa.int32()), pa.array([], pa.binary())
        bucket, node, size = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        part = (bucket >> U64(64 - PART_BITS)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, low, node, size = part[order], bucket[order].astype(np.uint32), node[order], size[order]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        cuts = zip(begin.tolist(), np.append(begin[1:], len(part)).tolist(), strict=True)
        return pa.array(part[begin].astype(np.int32)), pa.array([low[lo:hi].tobytes() + node[lo:hi].tobytes() + size[lo:hi].tobytes() for lo, hi in cuts], pa.binary())


def _shared_packs(packs: DataFrame, apart: int) -> DataFrame:
    """What ``_shared`` gives, of members ``(part, data)`` that a ``Dealer`` packed. A bucket is cut in two where its members' sizes leave out more than ``apart``, as no two from either side are alike."""

    def met(part: int, held: list[bytes]) -> pa.RecordBatch:
        n = [len(x) // 13 for x in held]
        low, node, size = (np.concatenate([np.frombuffer(x, kind, k, at * k) for x, k in zip(held, n, strict=True)]) for kind, at in ((np.uint32, 0), (np.int64, 4), (np.uint8, 12)))
        order = np.argsort(low)
        low = low[order]
        same = np.append(low[1:] == low[:-1], False)
        same[1:] |= same[:-1]  # whichever of its neighbours a bucket has
        low, node, size = low[same], node[order[same]], size[order[same]].astype(np.int64)
        order = np.lexsort((node, size, low))
        low, node, size = low[order], node[order], size[order]
        fresh = np.append(True, (low[1:] != low[:-1]) | (node[1:] != node[:-1]))[: len(low)]
        low, node, size = low[fresh], node[fresh], size[fresh]
        at = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (size[1:] - size[:-1] > apart))[: len(low)])
        n = np.diff(np.append(at, len(low)))
        bucket = (low[at].astype(np.int64) | part << BITS) << 8 | size[at]
        least = np.minimum.reduceat(node, at) if len(at) else node
        keep = np.repeat(n > 1, n)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.repeat(bucket, n), node, np.repeat(least, n))], names=["bucket", "node", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield met(part, held)
                    held = []
                part = p
                held.append(data)
        if held:
            yield met(part, held)

    dealt = packs.select("part", "data").repartition("part").sortWithinPartitions("part")
    return checkpoint(dealt.mapInArrow(run, "bucket bigint, node bigint, lo bigint"))


def _parts(rows: DataFrame, size: DataFrame) -> DataFrame:
    """Rows ``(bucket, node, ...)`` for each two parts ``(i, j)`` of their bucket that they meet in; ``size``: ``(node, bytes)``."""
    n = rows.select("bucket", "node").join(size, "node").groupBy("bucket").agg(F.ceil(F.sum("bytes") / F.lit(CHUNK)).cast("int").alias("n"))
    dealt = rows.join(n, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), "n").cast("int"))
    with_other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return with_other.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("n", "other")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal ``(bucket, i, j)``, the first three columns, which come one after another."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(k[lo]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(k[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class _Group:
    """Members of a bucket, or of two parts of it, with a label each, and the pairs to look at."""

    def __init__(self, t: pa.Table, screen: Screen | None, values: str) -> None:
        self.bucket, self.i, self.j = (t.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        self.node, self.label, self.part = (t.column(c).to_numpy() for c in ("node", "label", "part"))
        self.buckets = [frozenset(x) for x in t.column("buckets").to_pylist()]
        self.may = screen(t.column(values).to_pylist()) if screen else None

    def partners(self, r: int, label: np.ndarray) -> np.ndarray:
        """Later members of other labels that may be alike; in two parts, those of the other one."""
        other = label[r + 1 :] != label[r]
        if self.i != self.j:
            other &= self.part[r + 1 :] != self.part[r]
        at = np.flatnonzero(other) + r + 1
        return at[self.may(r, at)] if self.may and len(at) else at

    def here(self, r: int, k: int) -> bool:
        """Whether this bucket is the least that both share."""
        return min(self.buckets[r] & self.buckets[k]) == self.bucket


def _meeting(rows: DataFrame, size: DataFrame, beside: DataFrame) -> DataFrame:
    """``(bucket, i, j, node, label, part, buckets, ...)``, groups together, with the columns of ``beside`` by node."""
    own = rows.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # at most a node's buckets
    dealt = _parts(rows, size).join(own, "node").join(beside, "node")
    columns = [c for c in beside.columns if c != "node"]
    return dealt.select("bucket", "i", "j", "node", "label", "part", "buckets", *columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _screened(rows: DataFrame, sketches: DataFrame, screen: Screen) -> DataFrame:
    """Those rows ``(bucket, node, label)`` whose node has a partner of another component there that may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            g = _Group(t, screen, "sketch")
            hit = np.zeros(len(g.node), bool)
            for r in range(len(hit)):
                at = g.partners(r, g.label)
                for k in (at if not hit[r] else at[~hit[at]]).tolist():
                    if not (hit[r] and hit[k]) and g.here(r, k):
                        hit[r] = hit[k] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hit.sum()), g.bucket)), pa.array(g.node[hit]), pa.array(g.label[hit])], names=["bucket", "node", "label"])

    used = sketches.join(rows.select("node").distinct(), "node", "left_semi")
    size = used.select("node", (F.octet_length("sketch") + F.lit(ROW)).alias("bytes"))
    return checkpoint(_meeting(rows, size, used).mapInArrow(run, "bucket bigint, node bigint, label bigint").distinct())


def _compared(rows: DataFrame, features: DataFrame, alike: Callable[[bytes, bytes], bool], screen: Screen | None, sketches: DataFrame | None) -> DataFrame:
    """Links ``(a, b)`` between labels, by all pairs of rows ``(bucket, node, label)`` of a bucket: the trees of each task."""
    values = "f" if sketches is None else "sketch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for t in groups(batches):
            g = _Group(t, screen, values)
            f = t.column("f").to_pylist()
            label = np.array([forest.root(x) for x in g.label.tolist()])
            for r in range(len(f)):
                for k in g.partners(r, label).tolist():
                    if label[k] != label[r] and g.here(r, k) and alike(f[r], f[k]):
                        forest.link(label[r].item(), label[k].item())
                        one = forest.root(label[r].item())
                        label[(label == label[r]) | (label == label[k])] = one
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.edges()], names=["a", "b"])

    used = features if sketches is None else features.join(sketches, "node")
    size = features.select("node", (F.octet_length("f") + F.lit(ROW)).alias("bytes"))
    return checkpoint(_meeting(rows, size, used).mapInArrow(run, "a bigint, b bigint"))


def cluster(
    members: DataFrame,
    features: Callable[[DataFrame], DataFrame],
    alike: Callable[[bytes, bytes], bool],
    worth: Callable[[DataFrame], DataFrame] | None = None,
    screen: Screen | None = None,
    sketches: DataFrame | None = None,
    apart: int = 255,
) -> DataFrame:
    """``(node, label)`` of the nodes that have a link; ``members``: ``(bucket, node)``, repeated rows too, or packs ``(part, data)`` of a ``Dealer``,
    in which nodes whose sizes are more than ``apart`` from each other are not alike.

    ``features``: the ``(node, f)`` of given nodes. ``worth``: of pairs ``(a, b)`` those to verify, before features
    are read. ``screen`` tells by features, or by ``sketches`` ``(node, sketch)`` if given, which pairs may be alike.
    """
    shared = _shared_packs(members, apart) if "data" in members.columns else _shared(members)
    pairs = shared.where("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct()
    pairs = checkpoint(worth(pairs) if worth else pairs)
    wanted = checkpoint(pairs.select("a").union(pairs.select("b")).toDF("node").distinct())
    held = checkpoint(features(wanted))
    links = checkpoint(verified(pairs, held, alike))
    labels = components(links)
    discard(pairs, links)
    m = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    stat = m.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi and n > 2").select("bucket")
    rows = checkpoint(m.join(stat, "bucket"))
    discard(shared)
    if sketches is not None and screen is not None and not rows.isEmpty():
        before, rows = rows, _screened(rows, sketches, screen)
        discard(before)
    if rows.isEmpty():
        discard(rows, wanted, held)
        return labels
    nodes = rows.select("node").distinct()
    unread = checkpoint(nodes.join(wanted, "node", "left_anti"))
    more = checkpoint(features(unread))
    links = _compared(rows, held.join(nodes, "node", "left_semi").union(more), alike, screen, sketches)
    further = components(links)
    discard(rows, wanted, held, unread, more, links)
    old, new = labels.withColumnRenamed("label", "l"), further.toDF("l", "label")
    named = old.join(new, "l", "left").select("node", F.coalesce("label", "l").alias("label"))
    out = checkpoint(named.union(further.join(labels.select("node"), "node", "left_anti")))
    discard(labels, further)
    return out
