import json
import threading

import pytest
from pyspark.sql import functions as F

from quillon.operators import log as L
from quillon.operators.explain import explain
from quillon.plans.request import Filter, FindRequest
from quillon.shell import execute, parse_find
from quillon.sources import msgpack, wal
from quillon.sources.generate import documents
from quillon.store import DocumentStore, DuplicateId, NotFound
from quillon.streaming import tail


@pytest.mark.parametrize("kind", ["memory", "disk"])
def test_life_of_a_document(spark, tmp_path, kind):
    path = None if kind == "memory" else str(tmp_path / "db")
    db = DocumentStore(spark, path)
    made = db.insert([{"_id": "u1", "name": "alice", "age": 30}, {"_id": "u2", "name": "bob"}, {"name": "carol"}])
    assert made[:2] == ["u1", "u2"] and "-" in made[2]
    with pytest.raises(DuplicateId):
        db.insert({"_id": "u1"})
    with pytest.raises(DuplicateId):
        db.insert([{"_id": "x"}, {"_id": "x"}])
    assert db.update("u1", {"age": 31, "city": "mx", "_id": "u1"}) == {"_id": "u1", "name": "alice", "age": 31, "city": "mx"}
    with pytest.raises(ValueError):
        db.update("u1", {"_id": "u9"})
    db.delete("u2")
    for missing in (db.get, db.delete, lambda k: db.update(k, {})):
        with pytest.raises(NotFound):
            missing("u2")
    again = db if path is None else DocumentStore(spark, path)
    assert again.get("u1")["age"] == 31
    assert [r["_id"] for r in again.find(FindRequest((Filter("city", "eq", "mx"),))).collect()] == ["u1"]
    assert again.health() == {"entries": 5, "live": 2, "dead": 3, "waste_ratio": 0.6}
    assert again.compact() == {"old_entries": 5, "new_entries": 2, "removed_entries": 3}
    assert again.get("u1")["city"] == "mx"
    again.insert({"_id": "u2", "name": "bob again"})
    assert again.get("u2")["name"] == "bob again"
    if path:
        assert again.vacuum() == 1
        with pytest.raises(PermissionError):
            DocumentStore(spark, path, read_only=True).insert({})


def test_counters(spark):
    db = DocumentStore(spark)
    db.insert([{"_id": "a"}, {"_id": "b"}])
    db.get("a"), db.get("b"), db.find(), db.update("a", {"x": 1}), db.delete("b")
    with pytest.raises(NotFound):
        db.get("b")
    assert db.stats() == {"reads": 3, "writes": 3, "deletes": 1}


def test_shell(spark):
    db = DocumentStore(spark)
    assert execute(db, 'INSERT {"_id":"a","score":5,"city":"mx"}') == "inserted a"
    assert execute(db, 'insert {"_id":"b","score":9,"city":"us"}') == "inserted b"
    assert json.loads(execute(db, "get a"))["score"] == 5
    assert execute(db, "find score>=5 sort score desc limit 1").endswith("1 document(s)")
    assert execute(db, 'update a {"score":6}') == "updated a"
    assert execute(db, "delete b") == "deleted b"
    assert execute(db, "get b").startswith("error: not found")
    assert execute(db, "find {}").startswith("error")
    assert execute(db, "dance").startswith("unknown")
    assert execute(db, "exit") is None
    r = parse_find("city=mx age<=30 limit 3 sort age desc")
    assert r == FindRequest((Filter("city", "eq", "mx"), Filter("age", "lte", 30.0)), "age", False, 3)
    for bad in ("city=", "limit 0", "age>x", "sort"):
        with pytest.raises(ValueError):
            parse_find(bad)


def test_msgpack_round_trip():
    doc = {"_id": "a", "n": [0, -1, 127, 128, -33, 1 << 40, 2**64 - 1], "f": 1.5, "t": True, "z": None, "s": "é" * 40, "b": b"xy", "d": {str(i): i for i in range(20)}}
    assert msgpack.loads(msgpack.dumps(doc)) == doc
    with pytest.raises((ValueError, IndexError)):
        msgpack.loads(msgpack.dumps(doc)[:-1])


def test_wal(spark, tmp_path):
    good = wal.encode([(1, {"_id": "a", "v": 1}), (1, {"_id": "b", "v": 1}), (2, {"_id": "a", "v": 2}), (3, {"_id": "b"})])
    bad = bytearray(wal.encode([(1, {"_id": "bad"})]))
    bad[8] ^= 0xFF
    more = wal.encode([(1, {"_id": "c", "v": 3.5})], codec=2) + wal.encode([(1, {"v": 0})])
    (tmp_path / "001.log").write_bytes(good + bytes(bad) + more + good[:17])
    (tmp_path / "002.log").write_bytes(wal.encode([(2, {"_id": "c", "v": 4})]) + bytes(6))
    rows = wal.read(spark, str(tmp_path)).orderBy("file", "seq").collect()
    assert [(r["op"], r["version"], r["crc_ok"], r["ok"], r["_id"]) for r in rows] == [(1, 1, True, True, "a"), (1, 1, True, True, "b"), (2, 1, True, True, "a"), (3, 1, True, True, "b"), (1, 1, False, False, None), (1, 2, True, True, "c"), (1, 1, True, False, None), (2, 1, True, True, "c")]
    live = {r["_id"]: json.loads(r["payload"])["v"] for r in wal.live(wal.read(spark, str(tmp_path))).collect()}
    assert live == {"a": 2, "c": 4}


def test_migrate(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x.log").write_bytes(wal.encode([(1, {"_id": "a", "v": 1}), (1, {"_id": "b"}), (3, {"_id": "b"})], layout=1))
    assert wal.migrate(spark, str(tmp_path / "old"), str(tmp_path / "new")) == 1


def follower(spark, tmp_path):
    return tail.Follower(spark, str(tmp_path / "db" / "log"), str(tmp_path / "state"), str(tmp_path / "cp"))


def test_stream_follows_the_log(spark, tmp_path):
    db, replica = DocumentStore(spark, str(tmp_path / "db")), follower(spark, tmp_path)
    db.insert([{"_id": "a", "v": 1}, {"_id": "b", "v": 1}])
    replica.follow().awaitTermination()
    db.update("a", {"v": 2}), db.delete("b")
    replica.follow().awaitTermination()
    assert [(r["_id"], json.loads(r["doc"])["v"]) for r in replica.live().collect()] == [("a", 2)]
    assert [r["_id"] for r in replica.find(FindRequest((Filter("v", "eq", "2"),))).collect()] == ["a"]
    for write in (replica.insert, replica.update, replica.delete, replica.compact):
        with pytest.raises(PermissionError, match="follower mode"):
            write({})


def test_replica_survives_a_compaction(spark, tmp_path):
    db, replica = DocumentStore(spark, str(tmp_path / "db")), follower(spark, tmp_path)
    live = lambda: sorted(r["_id"] for r in replica.live().collect())
    db.insert([{"_id": "a"}, {"_id": "b"}, {"_id": "c"}])
    db.delete("b")
    replica.follow().awaitTermination()
    assert live() == ["a", "c"] and not replica.lagged()
    db.delete("c")  # the replica never sees this record
    db.compact()
    db.vacuum()
    assert replica.lagged()
    db = DocumentStore(spark, str(tmp_path / "db"))
    db.insert({"_id": "b"})
    replica.follow().awaitTermination()
    assert live() == ["a", "b"] == sorted(r["_id"] for r in db.live().collect()) and not replica.lagged()
    db.insert({"_id": "d"})
    replica.follow().awaitTermination()
    assert live() == ["a", "b", "d"]
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("batch=")]) <= tail.KEEP


def test_sequence_numbers_are_never_used_again(spark, tmp_path):
    db = DocumentStore(spark, str(tmp_path / "db"))
    db.insert([{"_id": "a"}, {"_id": "b"}])
    db.delete("b")
    db.compact()
    again = DocumentStore(spark, str(tmp_path / "db"))
    again.insert({"_id": "b"})
    assert {r["_id"]: r["seq"] for r in again.log().collect()} == {"a": 0, "b": 3}


@pytest.mark.parametrize("kind", ["memory", "disk"])
def test_threads_insert_and_read(spark, tmp_path, kind):
    """500 inserts from threads, readers beside them: every id once, and every document in the log."""
    db = DocumentStore(spark, None if kind == "memory" else str(tmp_path / "db"))
    db.insert({"_id": "first"})
    n = 500
    ids, errors = [None] * n, []

    def write(i):
        try:
            ids[i] = db.insert({"n": i} if i % 50 else {"_id": f"own{i}", "n": i})[0]
        except Exception as e:
            errors.append(e)

    def read():
        try:
            assert db.get("first")["_id"] == "first"
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(n)] + [threading.Thread(target=read) for _ in range(10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(set(ids)) == n
    rows = db.live().collect()
    assert {json.loads(r["doc"])["n"] for r in rows if r["_id"] != "first"} == set(range(n)) and len(rows) == n + 1
    seqs = [r["seq"] for r in db.log().collect()]
    assert sorted(seqs) == list(range(n + 1))
    assert db.stats() == {"reads": 10, "writes": n + 1, "deletes": 0}
    with pytest.raises(DuplicateId):
        db.insert({"_id": "own0"})


def test_storage_and_explain(spark, tmp_path):
    db = DocumentStore(spark, str(tmp_path / "db"))
    db.insert([{"_id": str(i), "v": i} for i in range(5)])
    info = db.storage()
    assert info["bytes"] > 0 and info["human"].endswith("KB") and info["live"] == 5
    told = explain(db.frame(), FindRequest((Filter("v", "gt", 2),)), dry_run=False)
    assert (told.scanned, told.matched) == (5, 2) and [name for name, _ in told.phases] == ["plan", "scan", "match"]


def test_index_of_a_log(spark, tmp_path):
    logs, saved = tmp_path / "logs", str(tmp_path / "index")
    logs.mkdir()
    (logs / "2.log").write_bytes(wal.encode([(1, {"_id": "a", "v": 1}), (1, {"_id": "b", "v": 1}), (1, {"_id": "z", "v": 1})]))
    (logs / "10.log").write_bytes(wal.encode([(2, {"_id": "a", "v": 2}), (3, {"_id": "b"})], codec=2))
    live = {r["_id"]: json.loads(r["payload"])["v"] for r in wal.live(wal.read(spark, str(logs))).collect()}
    assert live == {"a": 2, "z": 1}  # 10.log is the later one
    index = wal.open_index(spark, str(logs), saved)
    got = {r["_id"]: (r["found"], json.loads(r["payload"])["v"]) for r in wal.read_at(spark, index).collect()}
    assert got == {"a": ("a", 2), "z": ("z", 1)} and wal.spot_check(spark, index)
    (logs / "2.log").write_bytes(wal.encode([(1, {"_id": "y", "v": 5})]))  # the index is wrong now, and rebuilt
    assert not wal.spot_check(spark, spark.read.parquet(saved))
    assert sorted(r["_id"] for r in wal.open_index(spark, str(logs), saved).collect()) == ["a", "y"]


def test_index_has_bloom_filters(spark, tmp_path):
    """A file with the filter is larger than one without, by more than 64 KB: Parquet sizes it for many keys."""
    entries = spark.createDataFrame([(f"k{i}", "f", i) for i in range(100)], "_id string, file string, offset long").coalesce(1)
    wal.save_index(entries, str(tmp_path / "index"))
    entries.sortWithinPartitions("_id").write.parquet(str(tmp_path / "plain"))
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).glob("part-*.parquet"))
    assert size("index") > size("plain") + (64 << 10)
    assert spark.read.parquet(str(tmp_path / "index")).where("_id = 'k7'").count() == 1


def test_logger(caplog):
    from quillon.trace import logger

    with caplog.at_level("INFO", logger="quillon"):
        logger.info("compacted")
    assert "compacted" in caplog.text


def test_merge_patch_with_null_and_missing(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, n int")
    patch = spark.createDataFrame([(1, None, 9, True), (3, "z", 1, True)], "k int, s string, n int, has_s boolean")
    out = L.merge_update(base, patch.select("k", "s", "n"), "k", {"s": F.lit(True)}).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, None, 9), (2, "b", 6)]
    assert [r["k"] for r in L.missing(patch, base, "k").collect()] == [3]


def test_generator(spark):
    a, b = documents(spark, 50), documents(spark, 50)
    assert a.collect() == b.collect() and a.select("_id").distinct().count() == 50
    assert a.where("score between 0 and 99 and age between 20 and 64").count() == 50
