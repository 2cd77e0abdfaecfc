"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``WINDOW`` words of benchmark items; an item with fewer
words, but not none, is one pattern. The alphabet is words. For each pattern
length a table over hashes of two-word blocks says how far the search may move:
positions whose block ends no pattern are skipped, a shift of 0 leads to the
bucket of patterns with that suffix hash, and words are compared directly.
All lanes (pieces of documents) of a slice move together.

Nulls and texts without words have no hits; null ids of items are ignored;
repeated rows are scanned each. Patterns come in blocks of at most
``BLOCK_PATTERNS``, one scan each, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, mix, packed, slices

WINDOW = 10
BLOCK_PATTERNS = 200_000
TABLE_BITS = 20
LANE = 128


def _blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


class Matcher:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, set[str]]) -> None:
        self.m = length
        self.texts = list(patterns)
        self.items = [sorted(patterns[t]) for t in self.texts]
        w = Words(pa.array([t.decode() for t in self.texts], pa.large_string()), ALNUM)
        self.words = w.hashes().reshape(-1, length)
        if length == 1:
            last, self.shift = mix(self.words[:, 0]), np.full(1 << TABLE_BITS, 1, np.uint8)
            self.shift[(last >> U64(64 - TABLE_BITS)).astype(np.int64)] = 0
        else:
            self.shift = np.full(1 << TABLE_BITS, length - 1, np.uint8)
            for j in range(1, length):
                last = _blocks(self.words[:, j - 1], self.words[:, j])
                np.minimum.at(self.shift, (last >> U64(64 - TABLE_BITS)).astype(np.int64), np.uint8(length - 1 - j))
        order = np.argsort(last, kind="stable")
        self.suffix, self.bucket = last[order], order

    def search(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers at which patterns begin, and the patterns."""
        m = self.m
        size = np.diff(w.first)
        ends = np.maximum(size - m + 1, 0)  # possible last words of a document
        lanes = -(-ends // LANE)
        doc = np.repeat(np.arange(len(size)), lanes)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = w.first[doc] + m - 1 + number * LANE
        stop = np.minimum(pos + LANE, w.first[doc + 1])
        found = []
        while len(pos):
            block = mix(h[pos]) if m == 1 else _blocks(h[pos - 1], h[pos])
            s = self.shift[(block >> U64(64 - TABLE_BITS)).astype(np.int64)]
            zero = s == 0
            if zero.any():
                at, b = pos[zero], block[zero]
                lo, hi = np.searchsorted(self.suffix, b, "left"), np.searchsorted(self.suffix, b, "right")
                n = hi - lo
                if n.any():
                    at = np.repeat(at, n)
                    pick = self.bucket[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    found.append((at - m + 1, pick))
            pos = pos + np.maximum(s, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, pick = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        same = (h[at[:, None] + np.arange(m)] == self.words[pick]).all(axis=1)
        at, pick = at[same], pick[same]
        true = np.fromiter((b" ".join(w.text(i) for i in range(a, a + m)) == self.texts[p] for a, p in zip(at.tolist(), pick.tolist(), strict=True)), bool, len(at))
        return at[true], pick[true]


def windows(item_id: str, text: str | None) -> Iterator[tuple[int, bytes]]:
    if not text:
        return
    w = Words(pa.array([text], pa.large_string()), ALNUM)
    words = [w.text(i) for i in range(len(w.start))]
    m = min(WINDOW, len(words))
    for i in range(len(words) - m + 1 if m else 0):
        yield m, b" ".join(words[i : i + m])


def pattern_blocks(benchmark: DataFrame, limit: int = BLOCK_PATTERNS) -> Iterator[dict[int, dict[bytes, set[str]]]]:
    """Patterns by length, at most ``limit`` and one item more in a block."""
    block: dict[int, dict[bytes, set[str]]] = {}
    n = 0
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct()
    for item, text in rows.toLocalIterator():
        for m, p in windows(item, text):
            block.setdefault(m, {}).setdefault(p, set()).add(item)
            n += 1
        if n >= limit:
            yield block
            block, n = {}, 0
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_PATTERNS) -> DataFrame:
    """``(_row, text, n_words, spans, items)``: hit word ranges as flat [from, to) pairs, and the ids of items found."""
    sc = docs.sparkSession.sparkContext
    p = packed(docs, "text").withColumns({"n_words": F.lit(0).cast("bigint"), "spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    schema = p.schema
    for block in pattern_blocks(benchmark, limit):
        shared = sc.broadcast([Matcher(m, block[m]) for m in sorted(block)])  # at most `limit` patterns and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                w = Words(b.column(1), ALNUM)
                h = w.hashes()
                spans, items = b.column(3).to_pylist(), [set(x) for x in b.column(4).to_pylist()]
                for matcher in shared.value:
                    at, pick = matcher.search(w, h)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    order = np.argsort(at, kind="stable")
                    for d, a, k in zip(doc[order].tolist(), at[order].tolist(), pick[order].tolist(), strict=True):
                        items[d].update(matcher.items[k])
                        lo = a - int(w.first[d])
                        if spans[d] and spans[d][-2] <= lo <= spans[d][-1]:
                            spans[d][-1] = max(spans[d][-1], lo + matcher.m)
                        else:
                            spans[d] += [lo, lo + matcher.m]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(w.first), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["_row", "text", "n_words", "spans", "items"])

        p = p.mapInArrow(run, schema)
    return p


def _covered(spans: list[int]) -> int:
    total, reach = 0, 0
    for lo, hi in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, hi - max(lo, reach))
        reach = max(reach, hi)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_PATTERNS) -> DataFrame:
    """Per document: ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items)``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, items = b.column(2).to_pylist(), b.column(3).to_pylist()
            hit = [_covered(s) for s in spans]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit]), b.column(2), b.column(3)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
            )

    found = scan(docs.select("doc_id", "text"), benchmark, limit).select("_row.doc_id", "n_words", "spans", "items")
    kind = dict(docs.dtypes)["doc_id"]
    return found.mapInArrow(digest, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<bigint>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_PATTERNS) -> DataFrame:
    """Documents, all columns, without those that hold a window of an item."""
    return scan(docs, benchmark, limit).where(F.size("spans") == 0).select("_row.*")
