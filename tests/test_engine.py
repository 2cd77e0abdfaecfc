"""Façade, recovery, strict typing and the compaction invariant."""

import os
import random
import shutil
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.crc32c import crc32c, crc32c_many
from stratalog.operators import aggregate, compaction, mvcc, predicate, stats
from stratalog.plans import recovery
from stratalog.schema import ROW_ID, ColumnType, Durability, PredicateOp, Reader, RecordType, delta_schema, TXN_SCHEMA, user_schema
from stratalog.sources.segments import DamagedSegment, write_base
from stratalog.streaming.compactor import BackgroundCompactor
from stratalog.table import Database, Table

ITEMS = user_schema(sku=ColumnType.STRING, quantity=ColumnType.INT32)


def seen(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_crc_vectors():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    assert crc32c(b"6789", crc32c(b"12345")) == 0xE3069283
    assert crc32c_many([b"123456789", None, b"", b"a" * 300]) == [0xE3069283, None, 0, crc32c(b"a" * 300)]


def test_predicates_are_strict(spark):
    df = spark.createDataFrame([(1, None, float("nan"), "a"), (2**53 + 1, 2, 1.0, "ä"), (None, 3, None, None)], "a bigint, b int, c double, d string")
    assert predicate.where_op(df, "a", PredicateOp.EQ, 2**53).count() == 0
    assert predicate.where_op(df, "b", PredicateOp.NE, 2).count() == 1
    assert predicate.where_op(df, "c", PredicateOp.GT, 1.0).count() == 1
    assert predicate.where_op(df, "d", PredicateOp.GT, "z").count() == 1
    assert predicate.where_op(df, "a", PredicateOp.GT, None).count() == 0
    for column, literal in (("a", "1"), ("d", 1), ("a", 1.5), ("a", True)):
        with pytest.raises(TypeError):
            predicate.where_op(df, column, PredicateOp.EQ, literal)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 15, 16, 17, 1000, 10007])
def test_strategies_agree(spark, size):
    r = random.Random(size)
    rows = [(r.randint(0, 100), r.randint(-50, 50)) for _ in range(size)]
    want = (sum(a for p, a in rows if p > 50), sum(p > 50 for p, _ in rows))
    for strategy in ("codegen", "row", "arrow"):
        df = aggregate.strategy_session(spark, strategy).createDataFrame(rows, "p bigint, a bigint")
        assert tuple(aggregate.filter_gt_sum(df, "p", "a", 50, arrow=strategy == "arrow").first()) == want


def test_overflow(spark):
    df = spark.createDataFrame([(2**63 - 1,), (1,)], "x bigint")
    assert aggregate.scan_sum(df, "x", overflow="wrap").first()[0] == -(2**63)
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        aggregate.scan_sum(df, "x").collect()


def test_compaction_changes_no_view(spark):
    r = random.Random(5)
    user = T.StructType([T.StructField("x", T.LongType())])
    txns = [(i, 100 + i // 2, 100 + i, r.choice(["COMMITTED", "COMMITTED", "ACTIVE", "ABORTED"])) for i in range(1, 13)]
    txns = [t if t[3] == "COMMITTED" else (t[0], max(t[1], 106), 0, t[3]) for t in txns]
    base, delta, seq = [(i, i) for i in range(30)], [], 0
    state = {t[0]: t[3] for t in txns}
    for row in range(40):
        held = None  # the version that the next writer claims: its place in delta
        for who in sorted(r.sample(range(1, 13), 4)):
            if held is not None:
                delta[held][3] = who
            elif row < 30:
                delta.append([seq, row, 0, who, True, None])
                seq += 1
            if r.random() < 0.8:
                delta.append([seq, row, who, 0, False, (seq,)])
                seq += 1
                if state[who] == "COMMITTED":
                    held = len(delta) - 1
            elif state[who] == "COMMITTED":
                break
            if state[who] == "ACTIVE":
                break
            if state[who] == "ABORTED" and held is None:
                continue
    b = spark.createDataFrame(base, f"{ROW_ID} bigint, x bigint")
    d, t = spark.createDataFrame(delta, delta_schema(user)), spark.createDataFrame(txns, TXN_SCHEMA)
    w = mvcc.oldest_active_snapshot(t).first()[0]
    after = compaction.compact(b, d, t, w)
    for reader in (Reader(99, w), Reader(99, 112), *(Reader(i, s) for i, s, _, state in txns if state == "ACTIVE")):
        assert seen(mvcc.snapshot_read(b, d, t, reader)) == seen(mvcc.snapshot_read(after.base, after.delta, t, reader))
    again = compaction.compact(after.base, after.delta, t, w)
    assert seen(again.base) == seen(after.base) and again.delta.count() == after.delta.count()


def test_update_then_compact_keeps_one_row(spark, tmp_path):
    t = Table(spark, str(tmp_path), ITEMS)
    a = t.begin()
    t.insert(a, [("a", 1), ("b", 2)])
    t.commit(a)
    t.compact()
    b, old = t.begin(), t.begin()
    assert t.update(b, 1, ("a", 10)) and not t.update(old, 1, ("a", 11)) and not t.update(b, 77, ("z", 0))
    t.commit(b)
    assert seen(t.snapshot(old)) == [("a", 1), ("b", 2)]
    t.abort(old)
    c = t.begin()
    assert t.delete(c, 2)
    t.abort(c)
    t.compact()
    assert seen(t.snapshot()) == [("a", 10), ("b", 2)] and t.delta_size() == 0


def test_recovery(spark, tmp_path):
    root = str(tmp_path)
    db = Database(spark, root, ITEMS)
    a = db.begin()
    db.insert(a, [(f"s{i}", 100) for i in range(50)])
    db.commit(a)
    ghost = db.begin()
    db.insert(ghost, [("ghost", 1)])
    db.abort(ghost)
    db.checkpoint()
    b = db.begin()
    assert db.write(b, [(i, f"s{i - 1}", 5) for i in range(1, 11)])
    assert db.write(b, [(50,)], delete=True)
    db.commit(b)
    lost = db.begin()
    db.insert(lost, [("lost", 1)])
    want = seen(db.snapshot())
    for _ in range(2):
        again = Database(spark, root, ITEMS)
        assert seen(again.snapshot()) == want and len(want) == 49
    # A flipped byte in the last commit cuts it off; what is written later survives.
    commits = sorted(d for d in os.listdir(f"{root}/log") if os.path.exists(f"{root}/log/{d}/record.json") and RecordType.COMMIT.name in open(f"{root}/log/{d}/record.json").read())
    p = f"{root}/log/{commits[-1]}/record.json"
    text = open(p).read().replace("COMMIT", "COMNIT")
    os.remove(f"{root}/log/{commits[-1]}/.record.json.crc")
    open(p, "w").write(text)
    cut = Database(spark, root, ITEMS)
    assert cut.recovery["corrupt_record"] and len(seen(cut.snapshot())) == 50
    c = cut.begin()
    cut.insert(c, [("new", 3)])
    cut.commit(c)
    assert ("new", 3) in seen(Database(spark, root, ITEMS).snapshot())


def parts(folder):
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-"))


def logged(spark, root, rows=50):
    """A database with one committed batch and one more transaction; returns the folder of the batch."""
    db = Database(spark, root, ITEMS)
    a = db.begin()
    db.insert(a, [(f"s{i}", i) for i in range(rows)])
    db.commit(a)
    b = db.begin()
    db.insert(b, [("later", 1)])
    db.commit(b)
    return next(f"{root}/log/{d}" for d in sorted(os.listdir(f"{root}/log")) if len(parts(f"{root}/log/{d}")) > 1)


def test_lost_part_of_a_batch_is_reported(spark, tmp_path):
    root = str(tmp_path)
    batch = logged(spark, root)
    os.remove(parts(batch)[1])
    db = Database(spark, root, ITEMS)
    assert db.recovery["truncated_tail"] and not db.recovery["corrupt_record"]
    assert db.recovery["committed_transactions"] == 0 and seen(db.snapshot()) == []
    c = db.begin()
    db.insert(c, [("new", 3)])
    db.commit(c)
    again = Database(spark, root, ITEMS)
    assert not again.recovery["truncated_tail"] and seen(again.snapshot()) == [("new", 3)]


def test_lost_append_is_reported(spark, tmp_path):
    root = str(tmp_path)
    batch = logged(spark, root)
    shutil.rmtree(batch)
    db = Database(spark, root, ITEMS)
    assert db.recovery["truncated_tail"] and db.recovery["records_read"] == 1 and seen(db.snapshot()) == []


def test_cut_record_is_torn(spark, tmp_path):
    root = str(tmp_path)
    logged(spark, root)
    assert not Database(spark, root, ITEMS).recovery["truncated_tail"]
    last = f"{root}/log/{sorted(os.listdir(f'{root}/log'))[-1]}"
    os.remove(f"{last}/.record.json.crc")
    text = open(f"{last}/record.json").read()
    open(f"{last}/record.json", "w").write(text[:-5])
    db = Database(spark, root, ITEMS)
    assert db.recovery["truncated_tail"] and not db.recovery["corrupt_record"]
    assert db.recovery["bytes_read"] > 0 and len(seen(db.snapshot())) == 50


@pytest.mark.parametrize("lost", [[], [10], [1], [64], [65, 130], [199], [300]])
def test_first_hole(spark, lost):
    log = spark.createDataFrame([(i, False) for i in range(1, 200) if i not in lost], "lsn bigint, bad boolean")
    want = min((x for x in lost if x < 199), default=None)
    for span in (1, 8, 64, 1 << 16):
        assert recovery.first_hole(log, 1, span).first()[0] == want
    assert recovery.first_hole(log.where("lsn < 0"), 1).first()[0] is None


def test_damaged_base_is_reported(spark, tmp_path):
    root = str(tmp_path)
    db = Database(spark, root, ITEMS)
    a = db.begin()
    db.insert(a, [(f"s{i}", i) for i in range(5000)])
    db.commit(a)
    db.checkpoint()
    assert Database(spark, root, ITEMS, verify=True).recovery["checkpoint_found"]
    folder = db.table.base_paths[0]
    victim = parts(folder)[0]
    data = bytearray(open(victim, "rb").read())
    data[len(data) // 3] ^= 1
    os.remove(f"{folder}/.{os.path.basename(victim)}.crc")
    open(victim, "wb").write(data)
    with pytest.raises(Exception):
        Database(spark, root, ITEMS, verify=True)
    os.remove(victim)
    with pytest.raises(DamagedSegment):
        Database(spark, root, ITEMS)


def test_statistics_choose_files(spark, tmp_path):
    user = user_schema(x=ColumnType.INT64, s=ColumnType.STRING)
    t = Table(spark, str(tmp_path), user)
    path = str(tmp_path / "made")
    rows = spark.range(4000, numPartitions=4).selectExpr(f"id AS {ROW_ID}", "id * 2 AS x", "if(id % 5 = 0, NULL, concat('v', id div 1000)) AS s")
    write_base(rows, path, user, rows_per_file=500)
    t.base_paths, t.next_row_id = [path], 4000
    assert len(t.snapshot().inputFiles()) == 8
    for column, op, value, files in (("x", PredicateOp.GT, 6999, 1), ("x", PredicateOp.EQ, 10, 1), ("x", PredicateOp.LT, 0, 0), ("s", PredicateOp.GE, "v2", 4), ("x", PredicateOp.NE, 4, 8)):
        got = t.scan(column, op, value)
        assert seen(got) == seen(predicate.where_op(t.snapshot(), column, op, value))
        assert len(got.inputFiles()) == files
    a = t.begin()
    assert t.update(a, 7, (99999, "new"))
    assert t.cell(7, "s", a) == "new" and t.cell(7, "s") == "v0" and t.cell(5, "s") is None
    assert seen(t.scan("x", PredicateOp.GT, 90000, a)) == [(99999, "new")]
    with pytest.raises(KeyError):
        t.cell(10**6, "x")


def test_given_ids_and_background_compaction(spark, tmp_path):
    t = Table(spark, str(tmp_path), ITEMS)
    a = t.begin()
    t.insert_with_ids(a, [(40, "a", 1), (7, "b", 2)])
    first, _, _ = t.insert(a, [("c", 3)])
    assert first == 41
    t.commit(a)
    with BackgroundCompactor(t, threshold=2, poll_seconds=0.05):
        end = time.monotonic() + 60
        while t.delta_paths and time.monotonic() < end:
            time.sleep(0.1)
    assert t.metrics.runs == 1 and t.base_rows() == 3 and not t.txns
    assert seen(t.snapshot(row_ids=True)) == [(40, "a", 1), (41, "c", 3), (7, "b", 2)]


def test_writers_in_threads_lose_nothing(spark, tmp_path):
    t = Table(spark, str(tmp_path), ITEMS)
    a = t.begin()
    t.insert(a, [("hot", 0)])
    t.commit(a)
    won = []

    def work(k):
        b = t.begin()
        t.insert(b, [(f"t{k}", k)])
        won.append(t.update(b, 1, ("hot", k)))
        t.commit(b)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(1, 4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    got = seen(t.snapshot())
    assert sum(won) >= 1 and len(got) == 4 and sum(r[0] == "hot" for r in got) == 1


@pytest.mark.parametrize("mode", list(Durability))
def test_durability_modes_write_the_same_log(spark, tmp_path, mode):
    root = str(tmp_path)
    db = Database(spark, root, ITEMS, mode)
    a = db.begin()
    db.insert(a, [("a", 1), ("b", 2)])
    db.commit(a)
    assert not db.log.unsynced
    assert seen(Database(spark, root, ITEMS).snapshot()) == [("a", 1), ("b", 2)]


def test_rebuilt_dictionary_and_names(spark):
    words = stats.rebuild_dictionary(spark, ["b", "a"], "w")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "zz"), (4, "b")], "i int, w string")
    assert seen(stats.encode(df, words, "w").select("i", "code")) == [(1, 1), (2, None), (3, None), (4, 0)]
    for wrong in (["a", "a"], ["a", None]):
        with pytest.raises(ValueError):
            stats.rebuild_dictionary(spark, wrong, "w")
    assert [x.name for x in RecordType] == ["BEGIN", "INSERT", "UPDATE", "DELETE", "COMMIT", "ABORT"]
    assert [x.value for x in PredicateOp] == ["=", "!=", "<", "<=", ">", ">="]
    assert aggregate.capabilities(spark)["cores"] >= 1
