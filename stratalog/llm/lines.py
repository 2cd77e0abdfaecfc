"""Fuzzy line deduplication.

Lines are normalised (ASCII lower case, other than word characters as single
spaces) and equal ones counted once. A line's features are its distinct words, for
short lines its distinct runs of ``GRAM`` bytes. They are dealt by their hash into
groups of ``GROUP`` to twice as many, and the SimHash is made of a block for each
group: the majority of each bit over the group's features, those of groups of under
``LEAST`` features with the line's next ones. So an edit changes the blocks of the
groups that its features are in and leaves the others whole, which is
the pigeonhole: lines that share any block meet in its bucket. Every group of every
line has one. Lines of few groups are dealt in several ways, for ``BLOCKS`` or more; near the
length at which the number of groups changes a line has those of both numbers.
Lines of up to ``TINY`` bytes, whose one or two groups an edit may change all, meet by
what is left of them without any bytes that an alike one may lack, so that all of their
pairs are found. Lines that meet are verified by edit
similarity of ``SIMILARITY`` or more over whole lines, and links make groups. Of each
group the occurrence with the least (document, line) stays, in all documents
together; other occurrences go.

Of longer lines, pairs whose edits reach all of their groups are not found. Normalised lines are told
apart by a 64-bit hash, rows by one of id and text.

Lines without a word character always stay. Null text stays null. A document all
of whose lines go keeps an empty text. Rows repeated with equal id and text are
one document and are treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, checkpoint, discard, mix, packed, slices
from .graph import Dealer, cluster

SIMILARITY = 0.8
#: Blocks that a line has at least, if it has two groups or more, of words and of runs of bytes.
BLOCKS = (7, 16)
GROUP = 5
#: Features that a block is made of at least, if the line has so many.
LEAST = (5, 4)
#: Bytes of lines whose alike ones are all found.
TINY = 14
#: Lines of fewer words have features of so many bytes.
SHORT, GRAM = 12, 4
RESYNC = 8
APART = 4
_FEATURE_BITS = 40
#: The eight bits of a byte, each in a byte of its own.
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], dtype=U64)
_GOLDEN = U64(0x9E3779B97F4A7C15)
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_NOT_WORD = re.compile(rb"[^0-9a-z\x80-\xff]+")


class Lines:
    """Lines of a slice that have a word: place, words, and on demand hashes and normalised text."""

    def __init__(self, column: pa.Array) -> None:
        lines = Words(column, _LINE)
        w = Words(column, _WORD)
        self.words = w
        line = np.searchsorted(lines.start, w.start, "right") - 1
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else line
        self.used = line[first]
        self.first = np.append(first, len(line))
        self.doc = np.searchsorted(lines.first, self.used, "right") - 1
        # Line numbers count newlines, so empty lines have numbers too.
        breaks = np.flatnonzero(lines.bytes == 10)
        self.number = np.searchsorted(breaks, lines.start[self.used]) - np.searchsorted(breaks, lines.offsets[:-1])[self.doc]

    def hashes(self) -> np.ndarray:
        """Of the normalised lines."""
        self._h = self.words.hashes()
        return _line_hash(self._h, self.first)

    def buckets(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers of the picked lines (ascending), and where those of each begin. ``hashes`` comes first."""
        line, key = self.members(pick)
        order = np.argsort(line, kind="stable")
        return key[order], np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(pick)))])

    def members(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(line, bucket)``, lines by their place in ``pick``."""
        n = np.diff(self.first)[pick]
        long = np.flatnonzero(n >= SHORT)
        short = np.flatnonzero(n < SHORT * 1.25)  # alike lines have so many words at most where one has SHORT
        w = _spans(self.first[pick[long]], n[long])
        found = _with_both(np.repeat(long, n[long]), self._h[w], len(pick), 1)
        line, h = self._grams(pick[short])
        found += _with_both(short[line], h, len(pick), 2)
        found.append(self._tiny(pick, short))
        line, key = (np.concatenate(x) for x in zip(*found, strict=True))
        return line, key

    def sizes(self, pick: np.ndarray) -> np.ndarray:
        """Bytes of the normalised picked lines."""
        upto = np.append(0, np.cumsum(self.words.end - self.words.start + 1))
        return upto[self.first[pick + 1]] - upto[self.first[pick]] - 1

    def _tiny(self, pick: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(line, bucket)`` of the lines of up to ``TINY`` bytes: what is left of each without any bytes that an alike one may not have."""
        size = self.sizes(pick[short])
        at, keys = [], []
        for i, n in zip(short[size <= TINY].tolist(), size[size <= TINY].tolist(), strict=True):
            most = min(TINY, int(n / SIMILARITY + 1e-9))
            every = _less(self.text(pick[i]), int((1.0 - SIMILARITY) * most + 1e-9))
            at += [i] * len(every)
            keys += [int.from_bytes(blake2b(x, digest_size=8).digest(), "little") for x in every]
        return np.array(at, np.int64), np.array(keys, U64)

    def _grams(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of bytes of the normalised picked lines, with each one's place in ``pick``."""
        n = np.diff(self.first)[pick]
        w = _spans(self.first[pick], n)
        start, size = self.words.start[w], self.words.end[w] - self.words.start[w]
        at = np.cumsum(size + 1) - size - 1
        text = np.full(int(size.sum()) + len(w), 32, np.uint8)
        text[_spans(at, size)] = self.words.bytes[_spans(start, size)]
        wide = text.astype(U64) + U64(1)
        line = np.repeat(np.repeat(np.arange(len(pick)), n), size + 1)
        # Each line ends in a space, so one of fewer bytes than a run has a run of what it has.
        h = np.zeros(len(text), U64)
        for j in range(GRAM):
            part = np.zeros(len(text), U64)
            same = line[j:] == line[: len(line) - j]
            part[: len(text) - j] = np.where(same, wide[j:], U64(0))
            h = h * U64(0x100000001B3) + part
        whole = np.zeros(len(text), bool)
        whole[: max(0, len(text) - GRAM + 1)] = line[GRAM - 1 :] == line[: max(0, len(line) - GRAM + 1)]
        return line[whole], mix(h[whole])

    def text(self, i: int) -> bytes:
        w = self.words
        return _NOT_WORD.sub(b" ", w.bytes[w.start[self.first[i]] : w.end[self.first[i + 1] - 1]].tobytes())


def _line_hash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order matters: each word is mixed with its place in the line."""
    if not len(h):
        return np.zeros(0, U64)
    n = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    return mix(np.add.reduceat(mix(h + (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)), first[:-1]) + n.astype(U64))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def _with_both(line: np.ndarray, h: np.ndarray, lines: int, mark: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the lines' distinct features, with both numbers of groups where a line a quarter longer has more."""
    key = np.sort(line.astype(U64) << U64(_FEATURE_BITS) | h >> U64(64 - _FEATURE_BITS))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    line = (key >> U64(_FEATURE_BITS)).astype(np.int64)
    h = mix(key & U64((1 << _FEATURE_BITS) - 1))
    size = np.bincount(line, minlength=lines)
    groups, more = _groups(size), _groups(1.25 * size)
    out = [_blocks(line, h, groups, mark)]
    both = (more != groups)[line]
    return [*out, _blocks(line[both], h[both], more, mark)]


def _groups(size: np.ndarray) -> np.ndarray:
    """A power of two, so that a group has GROUP to 2 x GROUP features."""
    return 1 << np.floor(np.log2(np.maximum(size, GROUP) / GROUP)).astype(np.int64)


def _blocks(line: np.ndarray, h: np.ndarray, groups: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """``(line, bucket)`` of every group in every way to deal; ``line`` of each feature, ascending; ``groups`` of each line."""
    found = []
    m = groups[line]
    for way in range(BLOCKS[mark - 1]):
        use = (way * m < BLOCKS[mark - 1]) & ((m > 1) | (way == 0))
        if not use.any():
            break
        x, of = (h, m) if use.all() else (h[use], m[use])
        slot = mix(x + U64(int(_GOLDEN) * (way + 1) % (1 << 64))) & (of - 1).astype(U64)
        first = np.cumsum(groups) - groups
        entry = np.sort((first[line if len(x) == len(h) else line[use]].astype(U64) + slot) << U64(32) | x >> U64(32))
        at = (entry >> U64(32)).astype(np.int64)
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        lanes = np.empty((len(begin), 4), U64)
        octets = entry.view(np.uint8).reshape(-1, 8)
        for k in range(4):
            lanes[:, k] = np.add.reduceat(_SPREAD[octets[:, k]], begin)
        size = np.diff(np.append(begin, len(at)))
        at = at[begin]
        owner = np.repeat(np.arange(len(groups)), groups)[at]
        lanes, size = _filled(owner, lanes, size, LEAST[mark - 1])
        bits = np.packbits(lanes.view(np.uint8).reshape(len(begin), 32) * np.uint16(2) > size[:, None], axis=1).view(np.uint32)[:, 0]
        place = (groups[owner] * 64 + way).astype(U64) << U64(32) | (at - first[owner]).astype(U64) << U64(2) | U64(mark)
        found.append((owner, mix(bits.astype(U64) + _GOLDEN * place)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    owner, key = (np.concatenate(x) for x in zip(*found, strict=True))
    return owner, key


def _filled(owner: np.ndarray, lanes: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bits and sizes of the groups of lines (``owner``, ascending), those of under ``least`` features with the line's next groups, round about, until they have so many or all."""
    n = np.bincount(owner)
    first = (np.cumsum(n) - n)[owner]
    n = n[owner]
    place = np.arange(len(owner)) - first
    own, own_size, lanes, size = lanes, size, lanes.copy(), size.copy()
    small, step = np.flatnonzero((size < least) & (n > 1)), 1
    while len(small):
        other = first[small] + (place[small] + step) % n[small]
        lanes[small] += own[other]
        size[small] += own_size[other]
        step += 1
        small = small[(size[small] < least) & (n[small] > step)]
    return lanes, size


def _size_class(size: np.ndarray) -> np.ndarray:
    """Of bytes of lines: alike ones are ``APART`` classes from each other at most (their ratio is taken a bit larger, for rounding)."""
    return np.minimum(APART * np.log(np.maximum(size, 1)) / np.log(1.0001 / SIMILARITY), 255).astype(np.int64)


def _less(text: bytes, most: int) -> set[bytes]:
    """The text and what is left of it without up to ``most`` of its bytes."""
    every = last = {text}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        every = every | last
    return every


def _common(most: int, same: Callable[[int], bool]) -> int:
    """The largest k up to ``most`` with ``same(k)``, which holds for all smaller k then."""
    lo = 0
    while lo < most:
        k = (lo + most + 1) // 2
        if same(k):
            lo = k
        else:
            most = k - 1
    return lo


def _at_most(a: bytes, b: bytes, limit: int) -> bool:
    """Whether a greedy alignment, by the next ``RESYNC`` bytes that both have, costs ``limit`` edits at most."""
    cost = i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            n = _common(min(len(a) - i, len(b) - j, 64), lambda k: a[i : i + k] == b[j : j + k])  # noqa: B023
            i, j = i + n, j + n
            continue
        for s in range(min(limit - cost, 96) + 1):
            t = b.find(a[i + s : i + s + RESYNC], j, j + limit - cost + RESYNC) if i + s + RESYNC <= len(a) else -1
            if t >= 0:
                cost += max(s, t - j)
                i, j = i + s, t
                break
        else:
            break
    return cost + max(len(a) - i, len(b) - j) <= limit


def edit_alike(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length is ``least`` or more, by bit-parallel columns of one big integer."""
    if len(a) < len(b):
        a, b = b, a
    if len(b) < least * len(a):
        return False
    limit = int((1.0 - least) * len(a) + 1e-9)
    # Equal ends cost nothing in some best alignment.
    n = _common(len(b), lambda k: a[:k] == b[:k])
    a, b = a[n:], b[n:]
    n = _common(len(b), lambda k: a[len(a) - k :] == b[len(b) - k :])
    a, b = a[: len(a) - n], b[: len(b) - n]
    m = len(a)
    if m <= limit or _at_most(a, b, limit):
        return True
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance, left_over = full, 0, m, len(b)
    for c in b:
        if distance - left_over > limit:  # what is left can take off one each
            return False
        left_over -= 1
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(x | up)), up & x
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right = (right << 1 | 1) & full
        left = (left << 1) & full
        up, down = left | (full & ~((eq | down) | right)), right & (eq | down)
    return distance <= limit


def may_be_alike(values: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Of the texts of a group, whether one may be alike others: by lengths, and by how often bytes (in classes) occur, as an edit changes one byte more and one less."""
    size = np.array([len(x) for x in values])
    count = np.stack([np.bincount(np.frombuffer(x, np.uint8) & 31, minlength=32) for x in values]).astype(np.int32)

    def may(r: int, at: np.ndarray) -> np.ndarray:
        most = np.maximum(size[at], size[r])
        limit = np.floor((1.0 - SIMILARITY) * most + 1e-9)
        unlike = count[at] - count[r]
        return (np.maximum(np.maximum(unlike, 0).sum(axis=1), np.maximum(-unlike, 0).sum(axis=1)) <= limit) & (most - np.minimum(size[at], size[r]) <= limit)

    return may


def _occurrences(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, number, node)`` of each line; key tells rows apart. Other rows have ``(part, data)``: the buckets of the lines of a few slices, one line of those that are equal in a slice."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer()
        names = ["key", "doc_id", "number", "node", "part", "data"]
        types: list[pa.DataType] = []

        def dealt() -> pa.RecordBatch:
            part, data = dealer.take()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(part), t) for t in types), part, data], names=names)

        for b in slices(batches, "text", 1 << 20):
            types = [pa.int64(), b.column(1).type, pa.int64(), pa.int64()]
            x = Lines(b.column(2))
            own = x.hashes()
            _, pick = np.unique(own, return_index=True)
            pick.sort()
            if len(pick):
                line, bucket = x.members(pick)
                dealer.put(bucket, own[pick[line]].view(np.int64), _size_class(x.sizes(pick))[line])
            doc = pa.array(x.doc)
            none = [pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), pa.array(x.number.astype(np.int64)), pa.array(own.view(np.int64)), *none], names=names)
            if dealer.full():
                yield dealt()
        if types:
            yield dealt()

    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key bigint, doc_id {kind}, number bigint, node bigint, part int, data binary")


def drops(docs: DataFrame) -> DataFrame:
    """``(key, numbers)``: the lines that go, by row."""
    stored = checkpoint(_occurrences(docs))
    seen = stored.where("part is null").select("key", "doc_id", "number", "node")

    def features(nodes: DataFrame) -> DataFrame:
        wanted = seen.select("node", "key", "number").join(nodes, "node", "left_semi").dropDuplicates(["node"])
        by_row = wanted.groupBy("key").agg(F.collect_list(F.struct("number", "node")).alias("want"))  # at most the lines of one document
        rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text")).join(by_row, "key").select("want", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 1 << 20):
                x = Lines(b.column(1))
                place = {(d, k): i for i, (d, k) in enumerate(zip(x.doc.tolist(), x.number.tolist(), strict=True))}
                out = [(r["node"], x.text(place[d, r["number"]])) for d, want in enumerate(b.column(0).to_pylist()) for r in want]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["node", "f"])

        return rows.mapInArrow(run, "node bigint, f binary").dropDuplicates(["node"])

    labels = cluster(stored.where("part is not null").select("part", "data"), features, edit_alike, screen=may_be_alike, apart=APART)
    again = seen.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    told = again.join(labels, "node", "full").select("node", F.coalesce("label", "node").alias("label"))
    of = checkpoint(seen.join(told, "node").select("key", "doc_id", "number", "label"))
    discard(labels, stored)
    stays = of.groupBy("label").agg(F.min(F.struct("doc_id", "key", "number")).alias("stays"))
    gone = of.select("key", "number", "label").join(stays, "label").where(~((F.col("key") == F.col("stays.key")) & (F.col("number") == F.col("stays.number"))))
    out = checkpoint(gone.groupBy("key").agg(F.collect_set("number").alias("numbers")))  # at most the lines of one document
    discard(of)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """``(_row, text, n_lines, n_dropped)``: whole rows as a struct beside the text that is left."""
    p = packed(docs, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text")).select("_row", "key")
    j = p.join(drops(docs), "key", "left").withColumn("text", F.col("_row.text").cast("string"))
    lines = F.split("text", "\n")
    kept = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("numbers", i.cast("bigint"))), "\n"))
    return j.select("_row", kept.alias("text"), F.size(lines).alias("n_lines"), F.coalesce(F.size("numbers"), F.lit(0)).alias("n_dropped"))


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_lines, n_dropped)`` of every row."""
    return dedup(docs.select("doc_id", "text")).select("_row.doc_id", "text", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"), F.when(F.col("n_dropped") < 0, 0).otherwise(F.col("n_dropped")).alias("n_dropped"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Documents, all columns, with the lines that stay; ``n_chars``, if there, follows the text."""
    out = dedup(docs).select("_row.*", F.col("text").alias("_text")).withColumn("text", F.col("_text")).drop("_text")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
