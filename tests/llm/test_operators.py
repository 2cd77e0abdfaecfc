"""Operators against brute force, round trips and odd rows, on small tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from stratalog.llm import decontaminate, graph, hmm, language, lines, minhash, packing, passages, topk, toxicity, warc
from stratalog.llm.common import ALNUM, Words

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "!!!"), (5, "héllo Wörld 日本語"), (6, "a " * 30_000), (7, "same text here"), (7, "same text here"), (None, "no id")]
ODD_SCHEMA = "doc_id bigint, text string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(seed, n, pool=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).selectExpr("*", "'x' AS node", "1 AS key", "2 AS label", "cast(null AS string) AS lang")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, node string")


def test_words():
    texts = ["", None, "Ab1 c", "é", " x", "y ", "z"]
    w = Words(pa.array(texts, pa.string()), ALNUM)
    assert [[w.text(i).decode() for i in range(a, b)] for a, b in itertools.pairwise(w.first)] == [re.findall(WORD, lower(t)) for t in texts]
    h = Words(pa.array(["b a", "a"], pa.string()), ALNUM).hashes()
    assert h[1] == h[2] != h[0]


def test_language(spark, odd, empty):
    base = {"aa": "the quick brown fox and the lazy dog ", "bb": "zwölf boxkämpfer jagen viktor quer über "}
    train = spark.createDataFrame([(i, " ".join(random.Random(i).sample(t.split(), 6)), k) for i, (k, t) in enumerate(list(base.items()) * 30)], "doc_id bigint, text string, lang string")
    model = language.fit(train)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(train, model).collect()}
    assert all(got[i] == k for i, (k, _) in enumerate(list(base.items()) * 30))
    rows = language.predict(odd, model).collect()
    assert len(rows) == len(ODD) and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 3, 4)) and all(0 <= r["score"] <= 1 for r in rows)
    assert language.predict(odd, language.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.accepted(odd, model).columns == odd.columns and language.accepted(empty, model).count() == 0


def test_edit_similarity():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i]
            for j, y in enumerate(b, 1):
                d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
        return d[-1]

    r = random.Random(1)
    for _ in range(300):
        a = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 30)))
        b = bytearray(a)
        for _ in range(r.randrange(0, 8)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = bytes([r.choice(b"abc")] * r.randrange(2))
        b = bytes(b)
        m = max(len(a), len(b))
        assert lines.edit_alike(a, b) == (m == 0 or 1 - distance(a, b) / m >= 0.8 - 1e-9)


def test_line_buckets_find_most_alike_pairs():
    r = random.Random(12)
    alike, texts = [], []
    for i in range(300):
        words = [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randrange(900)}" for _ in range(r.choice([6, 10, 14, 20, 31, 33, 60, 120]))]
        other = list(words)
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(other))
            other[k] = r.choice([other[k][:-1], other[k] + "x", "another"])
        texts += [" ".join(words), " ".join(other)]
        if lines.edit_alike(texts[-1].encode(), texts[-2].encode()):
            alike.append((2 * i, 2 * i + 1))
    x = lines.Lines(pa.array(["\n".join(texts)]))
    x.hashes()
    bucket, at = x.buckets(np.arange(len(texts)))
    own = [set(bucket[a:b].tolist()) for a, b in itertools.pairwise(at.tolist())]
    assert len(alike) > 200 and sum(bool(own[a] & own[b]) for a, b in alike) >= 0.9 * len(alike)


def share_a_bucket(texts):
    x = lines.Lines(pa.array(["\n".join(texts)]))
    x.hashes()
    bucket, at = x.buckets(np.arange(len(texts)))
    own = [set(bucket[a:b].tolist()) for a, b in itertools.pairwise(at.tolist())]
    return lambda i, k: bool(own[i] & own[k])


def test_line_buckets_of_all_groups():
    """Edits in a fifth of the words leave few groups whole, which may be any."""
    r, texts = random.Random(21), []
    for _ in range(60):
        words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(400)]
        texts += [" ".join(words), " ".join(w[:-1] + "x" if r.random() < 0.2 else w for w in words)]
    meet = share_a_bucket(texts)
    assert all(lines.edit_alike(texts[2 * i].encode(), texts[2 * i + 1].encode()) for i in range(60))
    assert sum(meet(2 * i, 2 * i + 1) for i in range(60)) >= 57


def test_line_buckets_find_all_tiny_pairs():
    r, texts = random.Random(22), set()
    while len(texts) < 400:
        a = [r.choice("abc d") for _ in range(r.randrange(4, 15))]
        texts.add(" ".join("".join(a).split()) or "a")
        a[r.randrange(len(a))] = r.choice("abc")
        texts.add(" ".join("".join(a).split()) or "a")
    texts = sorted(t for t in texts if len(t) <= lines.TINY)
    meet = share_a_bucket(texts)
    alike = [(i, k) for i, k in itertools.combinations(range(len(texts)), 2) if lines.edit_alike(texts[i].encode(), texts[k].encode())]
    assert len(alike) > 100 and all(meet(i, k) for i, k in alike)


def test_packed_buckets_against_plain_ones(spark):
    r, rows, members = random.Random(23), [], []
    size = lambda n: abs(n) * 5
    for _ in range(6):
        dealer = graph.Dealer()
        for _ in range(2):
            some = [(r.randrange(30) << 57 | r.randrange(9), r.randrange(-50, 50)) for _ in range(r.randrange(1, 80))]
            dealer.put(np.array([b for b, _ in some], np.uint64), np.array([n for _, n in some], np.int64), np.array([size(n) for _, n in some]))
            members += some
        rows += zip(*(x.to_pylist() for x in dealer.take()), strict=True)
    packs = spark.createDataFrame(rows, "part int, data binary")
    by = {}
    for b, n in members:
        by.setdefault(b, set()).add(n)
    for apart in (255, 10):
        want = Counter()
        for of in by.values():
            order = sorted(of, key=size)
            cuts = [0, *(i for i in range(1, len(order)) if size(order[i]) - size(order[i - 1]) > apart), len(order)]
            want.update((n, min(order[i:k])) for i, k in itertools.pairwise(cuts) if k - i > 1 for n in order[i:k])
        got = [tuple(x) for x in graph._shared_packs(packs, apart).collect()]
        assert Counter((n, lo) for _, n, lo in got) == want and len(set(got)) == len(got)
    assert want != Counter((n, min(of)) for of in by.values() if len(of) > 1 for n in of)


def test_line_size_classes():
    n = np.arange(1, 200_000)
    assert (lines._size_class((n / lines.SIMILARITY + 1e-9).astype(np.int64)) - lines._size_class(n) <= lines.APART).all()


def test_edit_similarity_quick_answers_agree():
    r = random.Random(13)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            row, last = [i + 1], row
            for j, d in enumerate(b):
                row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    for _ in range(300):
        a = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 60)))
        b = bytearray(a)
        for _ in range(r.randrange(0, 16)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = bytes(r.choice(b"abc") for _ in range(r.randrange(2)))
        b = bytes(b)
        most = max(len(a), len(b))
        assert lines.edit_alike(a, b) == (distance(a, b) <= int(0.2 * most + 1e-9))


def test_cluster_of_a_hot_bucket_against_all_pairs(spark):
    r = random.Random(14)
    value = {r.getrandbits(62): v for v in [*(100 + i % 40 for i in range(400)), *(10_000 + 100 * i for i in range(400))]}
    near = lambda a, b: abs(int(a) - int(b)) <= 40
    rows = [(s, n) for n in value for s in range(4)]  # all nodes meet in every bucket
    held = spark.createDataFrame([(n, str(v).encode()) for n, v in value.items()], "node bigint, f binary")
    got = {x["node"]: x["label"] for x in graph.cluster(spark.createDataFrame(rows, "bucket bigint, node bigint"), lambda w: held.join(w, "node"), near).collect()}
    forest = graph.Forest()
    for a, b in itertools.combinations(value, 2):
        if near(value[a], value[b]):
            forest.link(a, b)
    assert {n: forest.root(n) for n in forest.up} == got


def test_cluster_of_a_bucket_of_pairs(spark, monkeypatch):
    """Each node of a large bucket is alike one other, which no chosen node tells."""
    monkeypatch.setattr(graph, "CHUNK", 50 * graph.ROW)  # so that the bucket is met in parts
    nodes = list(range(200))
    random.Random(2).shuffle(nodes)
    members = spark.createDataFrame([(b, n) for b in (32, 65) for n in nodes] + [(98, n) for n in nodes[:40]], "bucket bigint, node bigint")
    held = spark.createDataFrame([(n, str(n).encode()) for n in nodes], "node bigint, f binary")
    near = lambda a, b: abs(int(a) - int(b)) == 100
    got = {x["node"]: x["label"] for x in graph.cluster(members, lambda w: held.join(w, "node"), near).collect()}
    assert got == {n: n % 100 for n in nodes}


def test_shared_buckets_across_batches(spark):
    r = random.Random(4)
    rows = [(r.randrange(40) ** 2, r.randrange(60)) for _ in range(400)]
    by = {b: {n for c, n in rows if c == b} for b, _ in rows}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = Counter(tuple(x) for x in graph._shared(spark.createDataFrame(rows, "bucket bigint, node bigint")).collect())
            assert got == Counter((b, n, min(of)) for b, of in by.items() if len(of) > 1 for n in of)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_line_screen_loses_no_alike_pair():
    r = random.Random(8)
    texts = []
    for _ in range(150):
        a = "".join(r.choice("abcde f") for _ in range(r.randrange(1, 60)))
        b = list(a)
        for _ in range(r.randrange(0, max(2, len(a) // 4))):
            b[r.randrange(len(b)) :][:1] = []
            b.insert(r.randrange(len(b) + 1), r.choice("abcdefgh"))
        texts += [a.encode(), "".join(b)[: r.choice((80, len(a)))].encode() or b"a"]
    may, all_ = lines.may_be_alike(texts), np.arange(len(texts))
    for i, x in enumerate(texts):
        passed = may(i, all_)
        assert all(passed[j] or not lines.edit_alike(x, y) for j, y in enumerate(texts))


def test_line_dedup(spark, odd, empty):
    long = prose(1, 40)
    docs = spark.createDataFrame([(1, f"First {prose(2, 9)}\n{long}\n\n--"), (2, f"{long.upper()}!\n{prose(3, 9)}\n--"), (3, long.replace(long.split()[7], long.split()[7] + "x"))], ODD_SCHEMA)
    got = {r["doc_id"]: r for r in lines.report(docs).collect()}
    assert got[1]["n_dropped"] == 0 and got[2]["text"] == f"{prose(3, 9)}\n--"
    assert lines.report(odd).count() == len(ODD) and lines.report(empty).count() == 0
    assert lines.deduplicated(odd).columns == odd.columns


def test_loser_tree():
    r = random.Random(4)
    for k in range(9):
        runs = [sorted((str(r.randrange(50)), "t", r.randrange(9), "", 0, "", 0, str(i), j) for j in range(r.randrange(12))) for i in range(k)]
        runs = [sorted(x, key=warc._order) for x in runs]
        assert [warc._order(e) for e in warc.LoserTree(runs)] == sorted(warc._order(e) for x in runs for e in x)


def test_warc(spark):
    pages = [(1, "http://a.b/x", "<p>é\r\n\r\nWARC/1.1\r\n"), (2, None, "<p>é\r\n\r\nWARC/1.1\r\n"), (3, "http://a.b/y\r\nz", None), (4, "http://[", ""), (5, "u", "q" * 100_000)]
    got = {r["page_id"]: r for r in warc.captures(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i, _, h in pages:
        raw = (h or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [got[i]["record_type"] for i in range(1, 6)] == ["revisit", "response", "revisit", "response", "response"] and got[1]["refers_to"] == 2 and got[3]["refers_to"] == 4
    assert warc.captures(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_toxicity(spark, odd, empty):
    r = random.Random(2)
    texts = [" ".join([*prose(i, 40).split(), *(["grumpf", "vilelike"] if i % 3 == 0 else [])]) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], ODD_SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.95
    assert model.score(pa.array([prose(r.random(), 30) + " grumpff vilelikee"]))[0] > model.score(pa.array([prose(r.random(), 30)]))[0]
    assert all(0 <= x["score"] <= 1 for x in toxicity.score(odd, model).collect()) and toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def test_passages(spark, odd, empty):
    p = prose(9, 70)
    fuzzy = p.split()
    fuzzy[30] = "other"
    docs = [(i, f"{prose(100 + i, 80)} {p if i < 4 else ' '.join(fuzzy)} {prose(200 + i, 60)}") for i in range(6)] + [(i, prose(300 + i, 150)) for i in range(6, 12)]
    got = passages.passages(spark.createDataFrame(docs, ODD_SCHEMA)).collect()
    assert {r["doc_id"] for r in got} == set(range(6)) and all(69 <= r["n_words"] <= 75 and 79 <= r["start_word"] <= 81 for r in got)
    assert passages.passages(odd).where("doc_id <> 7 and doc_id <> 6").count() == 0 and passages.passages(empty).count() == 0


def test_passages_two_in_one_pair(spark):
    docs = []
    for k, (n, m, gap) in enumerate([(100, 100, 300), (60, 60, 100), (30, 60, 80)]):
        p, q = prose(400 + k, n), prose(410 + k, m)
        docs += [(10 * k + i, f"{prose(420 + 10 * k + i, 40)} {p} {prose(460 + 10 * k + i, gap)} {q} {prose(490 + 10 * k + i, 40)}") for i in range(2)]
    got = {(r["doc_id"], r["start_word"]): r["n_words"] for r in passages.passages(spark.createDataFrame(docs, ODD_SCHEMA)).collect()}
    want = {(d, s) for d in (0, 1) for s in (40, 440)} | {(d, s) for d in (10, 11) for s in (40, 200)} | {(d, 150) for d in (20, 21)}
    assert set(got) == want and all(n in (60, 100) for n in got.values())


def test_passages_cut_at_gaps():
    p, seed, q = prose(500, 55).split(), prose(501, 8).split(), prose(502, 60).split()
    for gap in (25, 45):
        x = [*p, *prose(503, gap).split(), *seed, *prose(504, 40).split(), *q]
        y = [*p, *prose(505, gap).split(), *seed, *prose(506, 40).split(), *q]
        number = {w: n for n, w in enumerate(set(x + y))}
        at = [*range(0, 47, 6), 55 + gap, *range(103 + gap, 155 + gap, 6)]
        found = passages.parts(passages.align(*(np.array([number[w] for w in t], np.uint32) for t in (x, y)), [(a, a) for a in at]))
        assert [(i, j, n) for i, k, j, m, n in found] == [(0, 0, 55), (103 + gap, 103 + gap, 60)]


def test_passages_extend_over_edits():
    p = prose(510, 60).split()
    for edit in ([(9, 1), (49, 1)], [(9, 0), (49, 2)], [(k, 1) for k in range(3, 60, 5) if not 20 <= k < 30]):
        fuzzy = []
        for k, one in enumerate(p):
            kind = dict(edit).get(k)
            fuzzy += [one] if kind is None else [f"new{k}"] if kind == 1 else [one, f"new{k}"] if kind == 2 else []
        x, y = [*prose(511, 30).split(), *p, *prose(512, 30).split()], [*prose(513, 45).split(), *fuzzy, *prose(514, 30).split()]
        number = {w: n for n, w in enumerate(set(x + y))}
        at = next((30 + a, 45 + b) for a in range(18, 40) for b in range(a - 2, a + 3) if p[a : a + 8] == fuzzy[b : b + 8])
        ((i, k, j, m, n),) = passages.parts(passages.align(*(np.array([number[w] for w in t], np.uint32) for t in (x, y)), [at]))
        assert 30 <= i <= 34 and 86 <= k <= 90 and n >= (k - i) - len(edit)


def test_passages_null_and_repeated_ids(spark):
    p, q = prose(520, 70), prose(521, 70)
    docs = [(None, f"{prose(522, 30)} {p}"), (1, f"{prose(523, 40)} {p}"), (2, f"{prose(524, 50)} {p}"), (3, f"{prose(525, 60)} {q}"), (3, f"{prose(526, 70)} {q}"), (3, prose(527, 200))]
    got = {(r["doc_id"], r["start_word"], r["n_words"]) for r in passages.passages(spark.createDataFrame(docs, ODD_SCHEMA)).collect()}
    assert got == {(None, 30, 70), (1, 40, 70), (2, 50, 70), (3, 60, 70), (3, 70, 70)}


def test_passages_whose_seeds_lie_apart(spark):
    p = prose(530, 60).split()
    for crowd in (1, 12):  # others that hold one half each, so that every seed has few or many holders
        docs = [(i, f"{prose(540 + i, 30)} {' '.join(p[:30] if i % 2 else p[30:])} {prose(570 + i, 30)}") for i in range(2 * crowd)]
        docs += [(100 + i, f"{prose(600 + i, 40)} {' '.join(p)} {prose(610 + i, 40)}") for i in range(2)]
        got = passages.passages(spark.createDataFrame(docs, ODD_SCHEMA)).collect()
        assert {(r["doc_id"], r["start_word"], r["n_words"], r["other_id"]) for r in got} == {(100, 40, 60, 101), (101, 40, 60, 100)}


def test_passages_of_many_holders_meet(spark):
    a = prose(700, 30)  # in all pairs, and the edit leaves no run of 40 words: no seed of a passage is of few holders
    docs = [(i, f"{a} {prose(830 + i, 40)}") for i in range(12)]
    for g in range(1, 5):
        m = prose(700 + g, 30)
        docs += [(100 * g + i, f"{prose(730 + 20 * g + i, 30)} {m} {prose(1730 + 20 * g + i, 30)}") for i in range(12)]
        docs += [(100 * g + 50 + i, f"{prose(2730 + 20 * g + i, 40)} {a} edit{i} {m} {prose(3730 + 20 * g + i, 40)}") for i in range(2)]
    got = passages.passages(spark.createDataFrame(docs, ODD_SCHEMA)).collect()
    assert {(r["doc_id"], r["start_word"], r["n_words"], r["other_id"]) for r in got} == {(100 * g + 50 + i, 40, 61, 100 * g + 51 - i) for g in range(1, 5) for i in range(2)}


def test_passages_tell_classes(spark):
    p, q = prose(710, 60), prose(711, 60)
    docs = [(i, f"{prose(4000 + i, 30)} {p if i < 20 else q} {prose(4100 + i, 30)}") for i in range(32)]
    got = passages.report(spark.createDataFrame(docs, ODD_SCHEMA)).collect()
    assert {(r["doc_id"], r["n_texts"]) for r in got} == {(i, 19 if i < 20 else 11) for i in range(32)}
    assert [len({r["class_id"] for r in got if (r["doc_id"] < 20) == first}) for first in (True, False)] == [1, 1] and len({r["class_id"] for r in got}) == 2


def test_passages_screen_loses_none():
    r = random.Random(5)
    core = [r.randrange(1, 40) for _ in range(30)]
    rows = []
    for _ in range(60):  # the seed's words at MARGIN, equal words around them, and stray ones
        w = [r.randrange(1, 4000) for _ in range(2 * passages.MARGIN + passages.K)]
        lo, hi = r.randrange(0, 12), r.randrange(20, 31)
        w[passages.MARGIN - 11 + lo : passages.MARGIN - 11 + hi] = core[lo:hi]
        w[passages.MARGIN : passages.MARGIN + passages.K] = core[11:19]
        for _ in range(r.randrange(40)):
            k = r.choice([*range(passages.MARGIN - 11), *range(passages.MARGIN + 19, len(w))])
            w[k] = r.randrange(1, 60)
        rows.append(w)
    around = np.array(rows, np.uint32)
    two = [np.array([7, 8])] * len(rows)
    may = passages.unlike(around, two, [np.array([0, 1], np.int32)] * len(rows))
    told = Counter()
    for i in range(len(rows)):
        at = np.array([k for k in range(len(rows)) if k != i])
        maybe, behind, ahead = may(i, at)
        for k, ok, left, right in zip(at.tolist(), maybe.tolist(), behind.tolist(), ahead.tolist(), strict=True):
            (x, _, n), *rest = passages.align(around[i], around[k], [(passages.MARGIN,) * 2])
            run = (x, n) == (passages.MARGIN - left, passages.K + left + right) and not rest
            assert ok or run
            told[ok] += 1
    assert min(told[True], told[False]) > 30


def test_passages_surroundings_hold_a_word_once():
    words = np.arange(1, 1001, dtype=np.uint32)
    want = [{"seed": 7, "at": a, "label": None if a % 2 else 5, "rest": True, "rest_parts": 1, "main_parts": 1, "part": 0} for a in [*range(100, 160), 900]]
    every = [{"seed": 7, "at": o["at"]} for o in want]
    kinds = [pa.int64(), None, None, pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[3], [want], [every], [words.tobytes()]], kinds, strict=True)], names=["node", "want", "every", "words"])
    (rows,) = passages._surroundings(iter([batch]))
    assert rows.num_rows == 2 and rows.nbytes < 4000
    padded = np.concatenate([np.zeros(passages.MARGIN, np.uint32), words, np.zeros(passages.MARGIN, np.uint32)])
    _, node, at, label, open_, around, near, far = passages._occurrences_in(pa.Table.from_batches([rows]))
    assert at.tolist() == [o["at"] for o in want] and set(node.tolist()) == {3}
    for k, o in enumerate(want):
        assert open_[k] == (o["label"] is None) and label[k] == (o["label"] or 0)
        assert (around[k] == padded[o["at"] : o["at"] + 2 * passages.MARGIN + passages.K]).all()
        assert (far[k] + o["at"]).tolist() == [e["at"] for e in every if abs(e["at"] - o["at"]) <= passages.WORDS + passages.MAX_GAP] and set(near[k].tolist()) == {7}


def test_passages_of_runs_of_one_word():
    r = random.Random(11)
    texts = []
    for i in range(40):  # words repeated many times each, some beside prose, some with stray words in the runs
        n = r.choice([9, 14, 20, 28, 36, 45, 70])
        w = [x for _ in range(r.randrange(2, 6)) for x in [f"w{r.randrange(9)}"] * (n + r.choice([0, 0, 0, -1, 1, 5]))]
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(len(w))] = f"w{r.randrange(9)}"
        texts.append(f"{prose(5000 + i, r.choice([0, 12]))} {' '.join(w)} {prose(5100 + i % 3, r.choice([0, 12]))}")
    x = passages.Words(pa.array(texts), passages.ALNUM)
    h = x.hashes()
    flat = [np.frombuffer(b, np.uint32) for b in passages._flat(None, x, h)]
    held = {}  # of each seed: texts and places
    for k, span in passages.FAMILIES:
        at = passages.seeds(x, passages.rolling(h, k), k, span)
        for a, s in zip(at.tolist(), passages.rolling(h, k)[at].view(np.int64).tolist(), strict=True):
            d = int(np.searchsorted(x.first, a, "right")) - 1
            held.setdefault(s, []).append((d, a - int(x.first[d])))
    held = {s: o for s, o in held.items() if len({d for d, _ in o}) > 1}
    every = {d: [{"seed": s, "at": a} for s, o in held.items() for e, a in o if e == d] for d in range(len(texts))}
    want = [[e | {"label": None, "rest": True, "rest_parts": 1, "main_parts": 0, "part": 0} for e in every[d]] for d in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"node": list(range(len(texts))), "want": want, "every": list(every.values()), "words": [f.tobytes() for f in flat]})
    rows = pa.Table.from_batches(list(passages._surroundings(iter([batch]))))
    met, looked = set(), 0
    for s in held:
        _, node, _, _, _, around, near, far, dense = passages._occurrences_told(rows.filter(pc.equal(rows.column("seed"), s)))
        may = passages.unlike(around, near, far, s, dense)
        looked += len(node)
        for k in range(len(node)):
            at = np.flatnonzero(node != node[k])
            met |= {(int(node[k]), d) for d in node[at[may(k, at)[0]]].tolist()}
    linked = set()
    for i, j in itertools.combinations(range(len(texts)), 2):
        pairs = sorted({(a, b) for o in held.values() for d, a in o if d == i for e, b in o if e == j})
        found = chains_of(pairs)
        if any(passages.parts(passages.align(flat[i], flat[j], f)) for f in found):
            linked.add((i, j))
    assert looked < sum(map(len, held.values())) / 3  # not each place of a run
    assert len(linked) > 20 and linked <= met | {(j, i) for i, j in met}
    assert len({(min(p), max(p)) for p in met}) < len(texts) ** 2 / 4  # few of the others


def test_passages_make_all_anchors():
    r = random.Random(2)
    for _ in range(100):
        every = [[{"seed": r.choice([5, -3, 9]), "at": a, "label": r.choice([None, 0, 2])} for a in range(r.randrange(1, 30))] for _ in range(2)]
        (b,) = passages._rows_of_seeds(iter([pa.RecordBatch.from_pydict({"node": [1, 2], "all": every})]))
        x, y = (np.frombuffer(v, np.int64).reshape(-1, 5) for v in b.column(1).to_pylist())
        want = sorted({(p["at"], q["at"]) for p in every[0] for q in every[1] if p["seed"] == q["seed"] and (p["label"] is None or p["label"] != q["label"])})
        assert list(zip(*passages._anchors(x, y), strict=True)) == want


def chains_of(pairs):
    a, b = ([p[c] for p in pairs] for c in (0, 1))
    return [[pairs[k] for k in f] for f in passages.chains(a, b) if len(f) > 1] if pairs else []


def test_passages_name_all_others(spark):
    p, q = prose(620, 60), prose(621, 60)
    docs = [(1, f"{p} {prose(622, 40)} {p} {prose(623, 100)} {q}"), (2, f"{prose(624, 30)} {p}"), (3, f"{q} {prose(625, 30)} {p}")]
    got = {(r["doc_id"], r["start_word"], r["other_id"], r["other_start"]) for r in passages.passages(spark.createDataFrame(docs, ODD_SCHEMA)).collect()}
    assert got >= {(2, 30, 1, 0), (2, 30, 1, 100), (2, 30, 3, 90), (3, 90, 2, 30), (3, 0, 1, 260), (1, 100, 2, 30), (1, 0, 3, 90)}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(12)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x["node"]: x["label"] for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_near_duplicates(spark, odd, empty):
    a = prose(5, 200).split()
    docs = [(1, " ".join(a)), (2, " ".join(a)), (3, " ".join([*a[:100], "new", *a[100:]])), (4, prose(6, 200)), (5, "two words"), (6, "two words"), (7, None), (8, None)]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in minhash.classes(spark.createDataFrame(docs, ODD_SCHEMA)).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 2), 6: (5, 2), 7: (7, 1), 8: (8, 1)}
    assert minhash.classes(odd).count() == len(ODD) and minhash.classes(empty).count() == 0
    assert minhash.first_of_class(odd).columns == odd.columns and minhash.first_of_class(odd).count() == len(ODD) - 1


def test_near_copies_in_a_large_group(spark):
    """Shingles that most documents have weigh little, edits much: by TF-IDF these copies are unlike."""
    base = prose(1, 400).split()
    docs = []
    for i in range(120):
        w, r = list(base), random.Random(i)
        for at in r.sample(range(400), 4):
            w[at] = f"e{i}x{at}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, prose(50 + i, 300)) for i in range(20)]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in minhash.classes(spark.createDataFrame(docs, ODD_SCHEMA)).collect()}
    alike = [(i, k) for i in range(120) for k in range(i) if plain_jaccard(docs[i][1], docs[k][1]) >= 0.8]
    forest = graph.Forest()
    for i, k in alike:
        forest.link(i, k)
    together = Counter(forest.root(i) for i in range(120))
    found = sum(got[i][0] == got[k][0] for i, k in alike)
    assert alike and found >= 0.97 * len(alike) and max(n for _, n in got.values()) >= max(together.values()) * 0.97
    assert all(got[i] == (i, 1) for i in range(1000, 1020))


def plain_jaccard(x, y):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def test_near_duplicates_null_and_repeated_ids(spark):
    a, b, c = (prose(700 + i, 200).split() for i in range(3))
    near = " ".join([*a[:100], "new", *a[100:]])
    docs = [(None, " ".join(a)), (None, near), (None, " ".join(b)), (1, " ".join(c)), (1, prose(710, 200)), (1, " ".join(c)), (2, " ".join(b)), (None, None), (None, ""), (None, ""), (None, "!!!")]
    rows = spark.createDataFrame(docs, ODD_SCHEMA)
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in minhash.classes(rows).collect())
    assert got == {(None, None, 2): 2, (None, 2, 2): 1, (2, 2, 2): 1, (1, 1, 2): 2, (1, 1, 1): 1, (None, None, 1): 4}
    kept = Counter((r["doc_id"], r["text"]) for r in minhash.first_of_class(rows).collect())
    first = [k for k in kept if k in {(None, " ".join(a)), (None, near)}]
    assert len(first) == 1 and kept - Counter(first) == Counter([(2, " ".join(b)), (1, " ".join(c)), docs[4], *docs[7:]])


def test_hmm_likelihood_is_exact():
    model = hmm.Hmm.guess(np.full(6, 1 / 6), states=3)
    symbol = np.array([random.Random(i).randrange(6) for i in range(700)])
    first = np.array([0, 1, 5, 300, 700])
    for d, (lo, hi) in enumerate(itertools.pairwise(first.tolist())):
        a, total = model.start, 0.0
        for t in range(lo, hi):
            a = (a if t == lo else a @ model.move) * model.emit[:, symbol[t]]
            total, a = total + math.log10(a.sum()), a / a.sum()
        assert abs(model.log10(symbol, first)[d] - total) < 1e-9


@pytest.mark.parametrize("whole", [1, 2, 3, 1024])
def test_hmm_expected_counts_by_all_paths(whole, monkeypatch):
    monkeypatch.setattr(hmm, "WHOLE", whole)
    states, symbols = 2, 3
    model = hmm.Hmm.guess(np.full(symbols, 1 / symbols), states=states, seed=5)
    model.start = np.array([0.3, 0.7])
    symbol, first = np.array([0, 1, 2, 2, 1, 0, 1, 1, 2, 0]), np.array([0, 1, 3, 10])
    start, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)), 0.0
    for lo, hi in itertools.pairwise(first.tolist()):
        o, ways = symbol[lo:hi], []
        for path in itertools.product(range(states), repeat=hi - lo):
            p = model.start[path[0]] * model.emit[path[0], o[0]]
            for t in range(1, hi - lo):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], o[t]]
            ways.append((path, p))
        total = sum(p for _, p in ways)
        log += math.log10(total)
        for path, p in ways:
            start[path[0]] += p / total
            for t, x in enumerate(path):
                emit[x, o[t]] += p / total
                if t:
                    move[path[t - 1], x] += p / total
    assert np.allclose(model.expected(symbol, first), np.concatenate([start, move.ravel(), emit.ravel(), [log]]))
    assert abs(model.log10(symbol, first).sum() - log) < 1e-9


def test_hmm_passes_do_not_lose_likelihood():
    r = random.Random(4)
    symbol, first = np.array([r.choice([0, 0, 1]) if (i // 40) % 2 else r.choice([2, 3]) for i in range(3000)]), np.array([0, 10, 700, 3000])
    model, p0, seen = hmm.Hmm.guess(np.full(4, 0.25), states=2), np.full(4, 0.25), []
    for _ in range(12):
        total = model.expected(symbol, first)
        seen.append(total[-1])
        model = model.updated(total, p0, prior=0.0)
    assert all(b > a - 0.2 for a, b in itertools.pairwise(seen)) and seen[-1] > seen[0] + 100


def test_hmm(spark, odd, empty):
    docs = spark.createDataFrame([(i, prose(i, 30, 50)) for i in range(60)], ODD_SCHEMA).unionByName(odd.select("doc_id", "text"))
    train = hmm.training_rows(docs)
    got = hmm.score(docs, *hmm.fit(train)).collect()
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    counts = Counter(x for r in train.collect() for x in tok(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = Counter((r["doc_id"], len(tok(r["text"])), sum(counts[x] > 0 for x in tok(r["text"])), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tok(r["text"])), 6)) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want and {r["train_tokens"] for r in got} == {n}
    assert hmm.score(odd, *hmm.fit(empty)).count() == len(ODD)


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, []), (20, [9.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), topk.F.col("vec_id") % 20 == 0, k=5).collect()
    v: dict[int, list[int]] = {}
    for i, x in rows:
        if x is not None and all(y is not None and math.isfinite(y) for y in x):
            z = [math.floor(64 * float(np.float32(y))) for y in x]
            v[i] = min(v.get(i, z), z)
    want = set()
    for q in v:
        if q % 20 == 0:
            top = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:5]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(top)}
    assert {tuple(x) for x in got} == want


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [t for _, t in ODD] + ["don't, I'LL <|endoftext|>x <|ENDOFTEXT|> é é ́a 12,34.5 İs ΣΑΣ.", "A.b,c ..., x\x0by\x85z​", prose(1, 5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), ODD_SCHEMA)
    got = sorted(packing.pack(docs, path).collect())
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        mine = [r for r in got if r["doc_id"] == i]
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()) for a in range(0, len(ids), 4096)]
        assert all(r["doc_tokens"] == len(ids) for r in mine)
    for _, x in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in x:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack(docs.limit(0), path).count() == 0


def test_decontamination(spark, odd, empty):
    r = random.Random(8)
    items = [("a", prose(1, 25, 50)), ("b", "short item"), ("c", None), ("d", "..."), (None, "w1"), ("e", "w7"), ("a", prose(1, 25, 50))]
    docs = ODD + [(100 + i, " ".join(random.Random(i).choice([prose(1, 25, 50), prose(i, 15, 50), "Short, ITEM!", prose(1, 12, 50)]) for _ in range(r.randrange(1, 6)))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    pats = {}
    for i, t in items:
        w = re.findall(WORD, lower(t))
        for k in range(max(0, len(w) - 9) if len(w) > 10 else bool(w)) if i else ():
            pats.setdefault(tuple(w[k : k + 10]), set()).add(i)
        if i and len(w) > 10:
            pats.setdefault(tuple(w[len(w) - 10 :]), set()).add(i)
    want = Counter()
    for d, t in docs:
        w = re.findall(WORD, lower(t))
        hit, ids = set(), set()
        for p, own in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= own
        want[(d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    df = spark.createDataFrame(docs, ODD_SCHEMA)
    for limit in (5, 10_000):
        assert Counter(tuple(x)[:6] for x in decontaminate.contamination(df, bench, limit).collect()) == want
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns and decontaminate.contamination(empty, bench).count() == 0


def test_places_against_lists():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 40)
        tree, plain = passages.Places(n), [passages._NONE] * (n + 1)
        for _ in range(60):
            at = r.randint(1, n)
            plain[at] = passages._NONE if r.random() < 0.4 else (r.random(), at)
            tree.put(at, plain[at])
            lo, hi = r.randint(1, n), r.randint(0, n)
            assert tree.most(lo, hi) == max(plain[lo : hi + 1], default=passages._NONE)


def test_passages_of_a_text_that_repeats_itself(spark):
    r = random.Random(4)
    again = " ".join(["so on"] * 300)
    prose = [" ".join(f"w{r.randint(0, 9999)}" for _ in range(60)) for _ in range(3)]
    docs = spark.createDataFrame([(1, f"{prose[0]} {again}"), (2, f"{prose[1]} {again}"), (3, prose[2])], "doc_id bigint, text string")
    got = passages.passages(docs).collect()
    assert {(x.doc_id, x.other_id) for x in got} == {(1, 2), (2, 1)} and len(got) < 20
    assert max(x.n_words for x in got) == 600
