"""WARC archives written and read back, with an external merge of their capture indexes.

Writing is JVM-side: one text line per record whose line end is the record end;
archives are gzipped as a whole, as Spark's writer can do no other, so offsets count
unpacked bytes; an archive holds one task's records, whose size AQE bounds, and
``RECORDS_PER_FILE`` at most. Archives are read record by record.
Of records with equal payloads of at least ``min_bytes`` bytes, that with the
largest id is the response; the others revisit it and carry no payload.

Every archive gives a run of index entries sorted by URL key, time and id. Runs
are dealt into key ranges, and in each range a loser tree merges them, so the
partitions hold, in order, the global capture histories. Ranges are cut on the
whole key: captures of one URL may fill many of them.

Null payloads are empty, null URLs are empty. Repeated rows are records of their
own; those with the largest id are all responses. A payload of null ids alone is
all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, remove, shared_folder

RECORDS_PER_FILE = 4096
SALTS = 16
CHUNK = 1 << 20
#: Entries of a run that are unpacked at a time.
AHEAD = 256
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ENTRY = "urlkey string, timestamp string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, archive string, offset bigint, length bigint"
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def base32_sha1(data: Column) -> Column:
    digest = F.sha1(data)
    five = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*five)), _HEX32, _BASE32)


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, digest, n, original)``; original is the id a revisit refers to, else null.

    Only digests that repeat are joined back, dealt over ``SALTS`` so that one payload may have a third of all rows.
    """
    p = pages.select(F.col("page_id").cast("bigint"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload").cast("bigint"))
    # The digests come from the html alone, so this side reads one wide column and keeps two narrow ones.
    many = p.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = p.join(many, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", "n", F.when(F.col("last") != F.coalesce("page_id", F.lit(-1)), F.col("last")).alias("original"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One column ``value``: the record as text, without its end."""
    p = with_originals(pages, min_bytes)
    again = F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    time = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(315360000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", time),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("original"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    body = F.when(again, "").otherwise(F.decode("payload", "UTF-8"))
    return p.select(F.concat(head, http, body).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    records(pages, min_bytes).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def urlkey(url: str) -> str:
    """Host parts reversed, then path and query, so that a host's captures lie together."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


_ID = re.compile(rb"<urn:page:(-?\d*)>")


def _head(f: BinaryIO) -> tuple[dict[bytes, bytes], int]:
    """Fields of a block of header lines, and its size with the empty line that ends it."""
    fields: dict[bytes, bytes] = {}
    size = 0
    while line := f.readline():
        size += len(line)
        if line == b"\r\n":
            break
        name, _, value = line[:-2].partition(b": ")
        fields[name] = value
    return fields, size


def parse(f: BinaryIO, archive: str) -> Iterator[tuple]:
    """Index entries of one archive in file order, read record by record. Digests of responses are taken from the payload itself."""
    at = 0
    while True:
        head, size = _head(f)
        if not head:
            return
        http, inner = _head(f)
        kind = head[b"WARC-Type"].decode()
        left = payload = int(head[b"Content-Length"]) - inner
        sha = hashlib.sha1()
        while left:
            if not (part := f.read(min(left, CHUNK))):
                raise EOFError(f"{archive}: record at {at} is cut")
            sha.update(part)
            left -= len(part)
        if kind == "response":
            digest = base64.b32encode(sha.digest()).decode()
        else:
            payload, digest = int(http[b"Content-Length"]), head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        ids = [int(m[1]) if (m := _ID.match(head.get(k, b""))) and m[1] else None for k in (b"WARC-Record-ID", b"WARC-Refers-To")]
        stamp = re.sub(rb"\D", b"", head[b"WARC-Date"]).decode()
        length = size + int(head[b"Content-Length"])
        yield urlkey(head[b"WARC-Target-URI"].decode("utf-8", "replace")), stamp, ids[0], kind, payload, digest, ids[1], archive, at, length
        at += length + len(f.read(4))


def _order(e: tuple) -> tuple:
    return e[0], e[1], -1 if e[2] is None else e[2], e[7], e[8]


class LoserTree:
    """K-way merge: each inner node keeps the loser of its match, so the next winner needs one path of matches."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.head: list = [None] * self.k
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._pull(i)
        for i in range(self.k):
            self._play(i)

    def _pull(self, i: int) -> None:
        e = next(self.runs[i], None)
        self.head[i] = None if e is None else (_order(e), e)

    def _before(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a][0], a) < (self.head[b][0], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # the first to come waits for its match
                self.tree[node] = i
                return
            if self._before(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while True:
            w = self.tree[0]
            if w < 0 or self.head[w] is None:
                return
            yield self.head[w][1]
            self._pull(w)
            self._play(w)


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*entries, strict=True))
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, ENTRY.split(", "), strict=True)], names=_NAMES)


def runs(spark, path: str) -> DataFrame:
    """Index entries of all archives; those of one archive are a sorted run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if entries := sorted(parse(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(b.column(1)[i].as_buffer())), CHUNK), b.column(0)[i].as_py()), key=_order):
                    yield _batch(entries)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("archive"), "content").mapInArrow(read, ENTRY)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """The parts of runs that a range has, as they came: Arrow slices that rise within a run."""
    out: list[list[pa.RecordBatch]] = []
    open_: dict[str, tuple[int, tuple]] = {}  # of each archive: its last run, and the last entry there
    for b in batches:
        columns = [b.column(i).to_pylist() for i in (0, 1, 2, 7, 8)]
        keys = [(u, t, -1 if p is None else p, a, o) for u, t, p, a, o in zip(*columns, strict=True)]
        begin = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i][3] == keys[begin][3] and keys[i] >= keys[i - 1]:
                continue
            archive = keys[begin][3]
            k, last = open_.get(archive, (-1, keys[begin]))
            if k < 0 or last > keys[begin]:  # another range's part of the run follows
                k = len(out)
                out.append([])
            out[k].append(b.slice(begin, i - begin))
            open_[archive] = k, keys[i - 1]
            begin = i
    return out


def _unpacked(run: list[pa.RecordBatch]) -> Iterator[tuple]:
    for b in run:
        for i in range(0, b.num_rows, AHEAD):
            yield from zip(*(c.to_pylist() for c in b.slice(i, AHEAD).columns), strict=True)


def merge(index: DataFrame) -> DataFrame:
    """Globally ordered entries: partition by partition, each merged from its parts of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for e in LoserTree([_unpacked(r) for r in _sorted_runs(batches)]):
            out.append(e)
            if len(out) == 8192:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    ranged = index.repartitionByRange("urlkey", "timestamp", "page_id", "archive", "offset")
    return ranged.mapInArrow(run, ENTRY)


def captures(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and merges their indexes. Archives without a path of their own are deleted once they are read."""
    spark = pages.sparkSession
    at = path or shared_folder(spark)
    write(pages, at, min_bytes)
    index = checkpoint(runs(spark, at))
    if path is None:
        remove(spark, at)
    return merge(index)
