"""Token packing: shortest-pack-first over the histogram of piece lengths.

Documents are cut into full pieces of ``size`` tokens and a rest. Lengths are
placed longest first, each into the packs that are shortest so far, by changing
counts of packing patterns; the patterns have one count for each, never one entry
per sequence. Patterns go back to documents by the rank of a piece among those of
its length.

Null text is empty: its document is the end id alone. Repeated rows are documents
of their own. The driver holds a histogram of ``size`` bins and the patterns.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, U64, Words, checkpoint, slices

SIZE = 4096
END_ID = 2
RANKS = 1 << 45
CACHE_WORDS = 600_000
RUN_WORDS = 256
PIECES = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(hidden)) for b in range(256)}


class Parts(Words):
    """What stands between ASCII spaces, in ASCII lower case; a stop or comma after an ASCII letter begins a part of its own.

    Such parts are encoded independently of each other.
    """

    def __init__(self, column: pa.Array) -> None:
        super().__init__(column, NOT_SPACE)
        at = np.flatnonzero((self.bytes == ord(".")) | (self.bytes == ord(",")))
        at = at[~np.isin(at, self.offsets)]
        before = self.bytes[at - 1]
        at = at[(before >= ord("a")) & (before <= ord("z"))]
        self.start, self.end = np.sort(np.concatenate([self.start, at])), np.sort(np.concatenate([self.end, at]))
        self.first = np.searchsorted(self.start, self.offsets)


class CachedTokenizer:
    """Ids of texts through a bounded cache of the ids of parts, by their 64-bit hashes.

    A part of plain lower-case letters is one word of the model, which is asked directly; other parts go through the whole tokenizer,
    and so do texts that may hold one of its special tokens.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, U64), np.zeros(0, np.int64)  # hashes in order, and where in ``bound`` each one is
        self.ids, self.bound = np.zeros(1 << 20, np.uint32), np.zeros(CACHE_WORDS + 1, np.int64)

    def _add(self, keys: np.ndarray, ids: list[int], sizes: np.ndarray) -> None:
        have, at = len(self.keys), int(self.bound[len(self.keys)])
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while have + len(keys) >= len(self.bound):
            self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
        self.ids[at : at + len(ids)] = ids
        self.bound[have + 1 : have + 1 + len(keys)] = at + np.cumsum(sizes)
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.place = np.insert(self.place, where, have + order)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 of those that are not here."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Other than plain parts are encoded as runs; a token belongs to the part in which it starts."""
        plain, rest, ids, sizes = [], [], [], []
        for k, w in enumerate(words):
            if _PLAIN.fullmatch(t := w.decode()):
                plain.append(k)
                coded = self.model.tokenize(w.decode("latin-1").translate(self.alphabet))
                sizes.append(len(coded))
                ids += [x.id for x in coded]
            else:
                rest.append((k, t))
        known = [keys[np.array(plain, np.int64)]]
        sizes = [np.array(sizes, np.int64)]
        for i in range(0, len(rest), RUN_WORDS):
            part = rest[i : i + RUN_WORDS]
            starts = np.cumsum([0, *(len(t) + 1 for _, t in part[:-1])])
            e = self.tokenizer.encode(" ".join(t for _, t in part), add_special_tokens=False)
            word = np.searchsorted(starts, np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids)), "right") - 1
            known.append(keys[[k for k, _ in part]])
            sizes.append(np.bincount(word, minlength=len(part)))
            ids += e.ids
        self._add(np.concatenate(known), ids, np.concatenate(sizes))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        w = Parts(column)
        keys, one, part = np.unique(w.hashes(), return_index=True, return_inverse=True)
        k = self._find(keys)
        missing = np.flatnonzero(k < 0)
        if len(missing):
            if len(self.keys) + len(missing) > CACHE_WORDS:
                self._clear()
                missing = np.arange(len(keys))
            self._learn(keys[missing], [w.text(i) for i in one[missing].tolist()])
            k = self._find(keys)
        k = k[part]
        lo = self.bound[k]
        size = self.bound[k + 1] - lo
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(lo - total[:-1], size) + np.arange(int(total[-1]))]
        cut = total[w.first].tolist()
        out = [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, "<|"), False).to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


_made: dict[str, CachedTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: full pieces and a rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _made.setdefault(tokenizer, None) or CachedTokenizer(tokenizer)
        _made[tokenizer] = coder
        for b in slices(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for i, ids in enumerate(coder.encode(b.column(1))):
                ids = np.append(ids, end_id).astype("<u4")
                for at in range(0, len(ids), size):
                    x = ids[at : at + size]
                    rows.append((i, at, len(x), zlib.crc32(x.tobytes()), len(ids)))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES.format(dict(docs.dtypes)["doc_id"]))


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)``: packing patterns for a histogram of lengths."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]  # by what is left
    done: list[tuple[int, tuple[int, ...]]] = []
    most = 0
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while most >= length and not open_[most]:
                most -= 1
            if most < length:
                fresh = open_[size - length]
                fresh[(length,)] = fresh.get((length,), 0) + n
                most, n = max(most, size - length), 0
                continue
            pattern, k = next(iter(open_[most].items()))
            c = min(n, k)
            if c == k:
                del open_[most][pattern]
            else:
                open_[most][pattern] = k - c
            rest = open_[most - length]
            wider = (*pattern, length)
            rest[wider] = rest.get(wider, 0) + c
            n -= c
    for left in open_:
        done += [(k, p) for p, k in left.items()]
    return done


class Plan:
    """Where the pieces of each length go: runs of ranks with the sequence of the first and the offset."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE) -> None:
        slots = []
        used = dict.fromkeys(histogram, 0)
        sequence = 0
        for count, lengths in sorted(shortest_pack_first(histogram, size), key=lambda x: (-sum(x[1]), x[1])):
            offset = 0
            for length in lengths:
                slots.append((length, used[length], sequence, offset))
                used[length] += count
                offset += length
            sequence += count
        self.slots = np.array(sorted(slots), np.int64).reshape(-1, 4)
        self.key = self.slots[:, 0] * RANKS + self.slots[:, 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        s = self.slots[np.searchsorted(self.key, length * RANKS + rank, "right") - 1]
        return s[:, 2] + rank - s[:, 1], s[:, 3]


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """``rank`` of each piece among those of its length, counted in buckets so that one length may have a third of all."""
    buckets = max(64, total // 500_000)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    n = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    return cut.withColumn("number", number).join(n.withColumn("before", before).drop("n"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("number") - 1).drop("bucket", "number", "before")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of each piece."""
    kind = dict(docs.dtypes)["doc_id"]
    whole = checkpoint(pieces(docs, tokenizer, size, end_id))
    histogram = {r["length"]: r["n"] for r in whole.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Plan(histogram, size))  # patterns: bounded by size, not by documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = shared.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = f"{PIECES.format(kind)}, sequence_id bigint, offset bigint"
    return ranked(whole, sum(histogram.values())).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, schema)
