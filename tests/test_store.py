import random
import struct
import zlib

import duckdb
import pytest
from oracle import TABLES, compare
from pyspark.sql import functions as F

from stratalog import answers
from stratalog.errors import Conflict, CorruptLayer, CorruptLog, InvalidInput, Lagged
from stratalog.functions import hashing
from stratalog.functions.keys import has_prefix, successor, text_view
from stratalog.operators import bloom, read
from stratalog.operators.stats import benchmark_summary
from stratalog.plans.catalog import QUERIES, SQL
from stratalog.schema import DELETE, PUT
from stratalog.sources import snapshot, wal
from stratalog.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db")


def fill(store, *steps):
    """Each step is (key, value), (key,) for a delete, or None for a flush; neighbours go in one batch."""
    batch = []
    for s in [*steps, False]:
        if s:
            batch.append((len(batch) + 1, PUT if len(s) == 2 else DELETE, s[0], s[1] if len(s) == 2 else None))
        else:
            if batch:
                store.apply(store.spark.createDataFrame(batch, "seq long, op int, key string, value string"))
            batch = []
            if s is None:
                store.flush()


def pairs(df):
    return [tuple(r) for r in df.select("key", "value").collect()]


def test_memtable_reopen_and_tombstone(spark, store):
    fill(store, ("alpha", "one"), ("beta", "two"), ("alpha",))
    again = Store(spark, store.root)
    assert again.get("alpha") is None and again.get("beta") == "two" and again.get("none") is None
    assert {r["key"]: r["op"] for r in again.memtable().collect()} == {"alpha": 2, "beta": 1}


def test_flush_recover_and_shadow(spark, store):
    assert store.flush() == {"flushed": False, "layer_id": 0, "entries": 0}
    fill(store, ("alpha", "one"), ("beta", "two"), None)
    s = Store(spark, store.root).stats()
    assert (s["memtable_entries"], s["layer_count"], s["bloom_filter_count"], s["next_layer_id"]) == (0, 1, 1, 2)
    fill(store, ("alpha",), None)
    assert Store(spark, store.root).get("alpha") is None and store.stats()["layer_count"] == 2


def test_scan_merges_layers(store):
    fill(store, ("user:1", "alice"), None, ("user:2", "bob"), ("user:1",), None)
    assert pairs(store.scan("user:", 10)) == [("user:2", "bob")]


def test_compaction(store):
    fill(store, ("user:1", "alice-v1"), None, ("user:1", "alice-v2"), ("user:2", "bob"), None, ("user:2",), None)
    assert store.compact() == {"flushed_memtable": False, "input_layers": 3, "output_layers": 1, "input_entries": 4, "output_entries": 1, "dropped_entries": 3}
    assert store.get("user:1") == "alice-v2" and store.get("user:2") is None and store.stats()["layer_count"] == 1


def test_compaction_flushes_first_and_all_dead(store):
    assert store.compact()["input_layers"] == 0
    fill(store, ("alpha", "one"))
    r = store.compact()
    assert r["flushed_memtable"] and r["input_layers"] == r["output_layers"] == r["input_entries"] == r["output_entries"] == 1
    fill(store, ("alpha",), None)
    r = store.compact()
    assert (r["output_layers"], r["output_entries"], r["dropped_entries"]) == (0, 0, 2) and store.get("alpha") is None


def test_invalid_keys_and_conflict(store):
    for f in (lambda: store.get(""), lambda: store.put("", "x"), lambda: store.delete("")):
        with pytest.raises(InvalidInput):
            f()
    store.put("a", "")
    assert store.get("a") == ""
    old = store.manifest()
    store.put("b", "1")
    with pytest.raises(Conflict):
        store._commit(old, seq=99)


def test_automatic_flush(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/small", flush_bytes=8)
    s.put("k", "v")
    assert s.stats()["layer_count"] == 0
    s.put("key", "value")
    assert s.stats()["layer_count"] == 1 and s.get("k") == "v"


def test_random_operations_against_a_dict(store):
    rng, model = random.Random(7), {}
    steps = []
    for _ in range(60):
        k = f"k{rng.randrange(12)}"
        if rng.random() < 0.1:
            steps.append(None)
        elif rng.random() < 0.3:
            steps.append((k,))
            model.pop(k, None)
        else:
            model[k] = str(rng.random())
            steps.append((k, model[k]))
    fill(store, *steps)
    assert dict(pairs(store.scan())) == model
    store.compact()
    assert dict(pairs(store.scan())) == model


def test_limits():
    assert [read.rows_wanted(0, s) for s in ("engine", "cli", "http", "rpc")] == [0, 0, 0, None]
    assert read.rows_wanted(None, "http") == 100 and read.rows_wanted(501, "http") == 500 and read.rows_wanted(None, "cli") == 100


def test_raw_scan_counts_tombstones(spark):
    log = spark.createDataFrame([(1, 2, "a", None), (2, 1, "b", "x")], "seq long, op int, key string, value string")
    assert [r["key"] for r in read.raw_scan(log, "", 1).collect()] == ["a"]
    assert pairs(read.scan(log, "", 1)) == [("b", "x")]


def test_byte_keys(spark):
    keys = [b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    df = spark.createDataFrame([(bytearray(k),) for k in reversed(keys)], "key binary")
    assert [bytes(r[0]) for r in df.orderBy("key").collect()] == keys
    assert df.where(has_prefix(df["key"], b"\xff")).count() == 1 and successor(b"\xff") is None and successor(b"a\xff") == b"b"
    assert spark.createDataFrame([(bytearray(b"a\xffb"),)], "v binary").select(text_view(F.col("v"))).first()[0] == "a\ufffdb"


def test_bloom(spark):
    entries = spark.createDataFrame([(1, k) for k in ("alpha", "beta", "gamma")], "layer long, key string")
    filters = bloom.build(entries)
    data = bloom.serialise(filters).first()
    assert sorted(bloom.parse(data["bit_len"], data["hashes"], bytes(data["data"]))) == sorted({43, 6, 33, 60, 23, 50, 13, 39, 30, 21, 12, 3, 58, 49, 42, 37, 32, 27, 22, 17, 12})
    asked = spark.range(1000).selectExpr("1L AS layer", "concat('missing:', id) AS key").union(entries)
    got = {r["key"]: r["maybe"] for r in bloom.probe(filters, asked).collect()}
    assert got["alpha"] and got["beta"] and got["gamma"] and sum(got.values()) == 3 + 29 and not got["missing:0"]
    for bad in ((0, 7, b""), (64, 0, b"x" * 8), (64, 7, b"x")):
        with pytest.raises(CorruptLayer):
            bloom.parse(*bad)


def test_log_frames(spark, tmp_path):
    raw = wal.frame(PUT, b"alpha", b"one") + wal.frame(DELETE, b"alpha")
    assert list(wal.frames(raw)) == [(1, b"alpha", b"one"), (2, b"alpha", None)]
    assert len(list(wal.frames(raw[:-1]))) == 1
    broken = bytearray(raw)
    broken[6] ^= 1
    with pytest.raises(CorruptLog):
        list(wal.frames(bytes(broken)))
    with pytest.raises(CorruptLog):
        list(wal.frames(struct.pack("<I", 1 << 30)))
    body = struct.pack("<BII", 9, 1, 0) + b"k"
    with pytest.raises(CorruptLog):
        list(wal.frames(struct.pack("<I", len(body)) + body + struct.pack("<I", zlib.crc32(body))))
    for bad in ((PUT, b""), (DELETE, b"k", b"v")):
        with pytest.raises(InvalidInput):
            wal.frame(*bad)
    (tmp_path / "seg1").write_bytes(raw)
    assert [(r["pos"], r["op"], bytes(r["key"])) for r in wal.recover(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, 1, b"alpha"), (1, 2, b"alpha")]
    assert wal.recover(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "seg1").write_bytes(bytes(broken))
    with pytest.raises(Exception, match="checksum"):
        wal.recover(spark, str(tmp_path)).collect()
    log = spark.createDataFrame([(1, 1, "alpha", "one"), (2, 2, "alpha", None)], "seq long, op int, key string, value string")
    assert b"".join(bytes(r["frame"]) for r in wal.encode(log).orderBy("seq").collect()) == raw


def test_snapshots(spark):
    assert [tuple(r)[2:] for r in snapshot.load(spark, '[{"key":"a","value":"1"},{"key":""}]').collect()] == [("a", "1")]
    for bad in ('{"rows":[]}', "{", '[{"key":""}, 4]'):
        with pytest.raises(InvalidInput):
            snapshot.load(spark, bad)
    texts = {"0.0": "0", "-0.0": "0", "12.50": "12.5", "1e3": "1000", "1e20": "100000000000000000000", "1.5e21": "1.5e+21", "1e-6": "0.000001", "1.25e-7": "1.25e-7", "0.001": "0.001", "123456789012": "123456789012", "-1.5": "-1.5", "1e7": "10000000", "12345678.9": "12345678.9", "0.00123": "0.00123"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", snapshot.browser_text(F.try_parse_json("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == texts


def test_feed_gives_committed_batches_in_order(spark, store, monkeypatch):
    fill(store, ("user:1", "alice"), ("order:1", "x"), ("user:1",))
    got = []
    take = lambda rows, k: got.extend((r["event"], r["key"], r["value"]) for r in rows.collect())
    since = store.manifest()["version"]
    stale = store.manifest()
    store.put("user:2", "bob")
    with monkeypatch.context() as m:  # a writer that read the manifest before the last commit loses, and its batch is never seen
        m.setattr(store, "manifest", lambda: stale)
        with pytest.raises(Conflict):
            store.put("user:ghost", "boo")
    store.flush()
    store.feed(take, "user:", since=0, until_now=True).awaitTermination()
    assert got == [("put", "user:1", "alice"), ("delete", "user:1", ""), ("put", "user:2", "bob")]
    got.clear()
    store.feed(take, since=since, until_now=True).awaitTermination()
    assert got == [("put", "user:2", "bob")] and store.get("user:ghost") is None
    store.compact()
    store.vacuum()
    with pytest.raises(Lagged):
        store.changes(0)
    store.put("a", "1")
    version = store.manifest()["version"]
    store.flush()
    store._fs.delete(store._path(store.manifest(version)["added"][0]["path"]), True)
    with pytest.raises(Lagged, match="1 events"):
        store.changes(version - 1)


def test_the_log_goes_after_a_flush_and_open_readers_end(spark, store):
    fill(store, ("a", "1"), None, ("b", "2"))
    rows = store.scan()
    store.compact()
    assert pairs(rows) == [("a", "1"), ("b", "2")]  # made before the compaction, read after it
    folders = lambda kind: [s.getPath().getName() for s in store._fs.listStatus(store._path(kind))]
    assert len(folders("log")) == 2 and store.vacuum() == 4 and folders("log") == [] and folders("staged") == [] and len(folders("layers")) == 1
    assert dict(pairs(Store(spark, store.root).scan())) == {"a": "1", "b": "2"}
    again = Store(spark, store.root, keep=1)
    for k in range(4):
        again.put("c", str(k))
        again.flush()
    assert len(again.manifest()["retired"]) <= 2 and again.get("c") == "3"


def test_two_writers_race(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    def commit(other, old, k):
        try:
            return other._commit(old, seq=k)["seq"]
        except Conflict:
            return None

    others = [Store(spark, store.root) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        for _ in range(25):
            old = store.manifest()
            won = [x for x in pool.map(commit, others, [old] * 4, range(4)) if x is not None]
            assert len(won) == 1 and store.manifest()["seq"] == won[0] and store.manifest()["version"] == old["version"] + 1


def test_rows_are_numbered_on(spark, store):
    batch = lambda *rows: spark.createDataFrame(rows, "seq long, op int, key string, value string")
    store.apply(batch((100, 1, "a", "old"), (7, 1, "b", "x")))
    store.apply(batch((-5, 1, "a", "new"), (-4, 2, "b", None), (-3, 1, "b", "y")))
    assert dict(pairs(store.scan())) == {"a": "new", "b": "y"} and store.manifest()["seq"] == 5
    assert sorted(r["seq"] for r in store.changelog().collect()) == [1, 2, 3, 4, 5]
    for bad in (batch((None, 1, "a", "x")), batch((1, 1, "a", "x"), (1, 1, "b", "x")), batch((1, 3, "a", "x")), batch((1, 1, "", "x")), batch((1, 1, None, "x"))):
        with pytest.raises(InvalidInput):
            store.apply(bad)
    assert store.apply(batch((1, 1, "a", "x")).limit(0)) == 0 and store.manifest()["seq"] == 5
    big = spark.range(1000).selectExpr("-id AS seq", "1 AS op", "concat('k', id % 10) AS key", "string(id) AS value").repartition(7)
    assert store.apply(big) == 1000 and store.get("k3") == "3" and store.manifest()["seq"] == 1005


def test_open_and_verify_find_damage(spark, store):
    fill(store, ("a", "1"), ("b", "2"), None, ("c", "3"), None)
    assert store.verify() == 2
    old = store.manifest()
    wrong = store._write(store.layer(1).select("seq", "op", "key", "value", "layer").repartition(1).sortWithinPartitions(F.desc("key")), "layers")
    store._commit(old, layers=[old["layers"][0] | {"path": wrong}, old["layers"][1]])
    with pytest.raises(CorruptLayer, match="order"):
        store.verify()
    store._commit(store.manifest(), layers=[old["layers"][0] | {"entry_count": 3}])
    with pytest.raises(CorruptLayer, match="manifest says"):
        store.verify()
    store._commit(store.manifest(), layers=[old["layers"][0] | {"path": "layers/none"}])
    with pytest.raises(CorruptLayer, match="isn't there"):
        Store(spark, store.root)
    store._create(f"manifests/{store.manifest()['version'] + 1:020d}.json", b"{}")
    with pytest.raises(CorruptLayer, match="lacks"):
        Store(spark, store.root)


def test_answers(store):
    assert answers.put(store, "user:1", "alice") == {"success": True, "message": "stored user:1"}
    assert answers.get(store, "user:1") == {"found": True, "key": "user:1", "value": "alice"} and answers.get(store, "x") == {"found": False, "key": "x", "value": None}
    assert answers.get(store, "") == {"found": False, "key": "", "value": "error: keys must not be empty"} and not answers.put(store, "", "x")["success"] and not answers.delete(store, "")["success"]
    assert answers.scan(store, "user:") == {"rows": [{"key": "user:1", "value": "alice"}]} and answers.scan(store, limit=0) == {"rows": []} and answers.scan(store, limit=-1) == {"rows": []}
    assert answers.demo(store)["success"] and answers.stats(store)["memtable_entries"] == 6
    assert answers.flush(store)["message"].startswith("flushed") and answers.flush(store)["message"] == "nothing to flush" and answers.delete(store, "user:2")["success"] and answers.compact(store)["success"]
    assert answers.import_rows(store, '{"rows":[{"key":"z","value":1.50},{"key":""},{"key":"z2"}]}') == {"success": True, "imported": 2, "message": "imported 2 rows"} and store.get("z") == "1.5"
    assert not answers.import_rows(store, "no json")["success"] and not answers.import_rows(store, "[]")["success"] and not answers.import_rows(store, '{"rows": 3}')["success"]


def test_import_stops_at_the_first_row_that_cannot_be_stored(store, monkeypatch):
    monkeypatch.setattr("stratalog.sources.store.MAX_RECORD_BYTES", 20)
    got = store.import_json('[{"key":"a","value":"1"},{"key":"b","value":"' + "x" * 30 + '"},{"key":"c","value":"3"}]')
    assert not got["success"] and got["imported"] == 1 and dict(pairs(store.scan())) == {"a": "1"}


def test_hashes_of_any_length():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    keys = [b"", b"a", *(rng.randbytes(rng.randrange(1, 90)) for _ in range(300)), b"x" * 5000]

    def fold(key, h):
        for x in key:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h

    for bits in (64, 1000, 2**31 + 11, 10**10, 2**40, 2**62 + 1):
        got = hashing.positions(pa.array(keys).slice(1), pa.array(np.full(len(keys) - 1, bits)))
        want = [[(fold(k, 0xCBF29CE484222325) + i * (fold(k, 0x9E3779B97F4A7C15) | 1)) % 2**64 % bits for i in range(7)] for k in keys[1:]]
        assert got.tolist() == want
    assert hashing.positions(pa.array([], pa.binary()), pa.array([], pa.int64())).shape == (0, 7)


def test_benchmark_summary():
    assert benchmark_summary(100, 0, 500.0) == {"ops_per_s": 200, "avg_ms": 5.0, "errors": 0}


def test_binary_store(spark, tmp_path):
    db = Store(spark, f"file://{tmp_path}/bytes", kind="binary")
    for k in (b"\xff", b"\x7f", b"\x80", b"\x7f\x00"):
        db.put(k, b"a\xffb" + k)
    db.flush()
    db.delete(b"\x80")
    assert db.get(b"\xff") == b"a\xffb\xff" and db.get(b"\x80") is None and db.get(b"\x01") is None
    assert [bytes(r["key"]) for r in db.scan().collect()] == [b"\x7f", b"\x7f\x00", b"\xff"] and db.scan(b"\xff").count() == 1
    assert db.compact()["dropped_entries"] == 2


def test_a_crash_before_the_commit_changes_nothing(store):
    fill(store, ("a", "1"), None, ("b", "2"))
    old = store.manifest()
    store._layer(store.memtable().selectExpr("seq", "op", "key", "value", "2L AS layer"), 2)  # written, never committed
    again = Store(store.spark, store.root)
    assert again.manifest() == old and dict(pairs(again.scan())) == {"a": "1", "b": "2"}
    # the same records in a layer and in the log, as after a crash between the two: one answer
    both = store.changelog().unionByName(store.changelog())
    assert pairs(read.scan(both)) == [("a", "1"), ("b", "2")]


def test_command_line(store, tmp_path):
    from stratalog.__main__ import parser, run

    say = lambda *a: run(store, parser().parse_args(a))
    assert say("put", "user:1", "alice") == "OK" and say("get", "user:1") == "alice" and say("get", "user:2") == "(not found)"
    assert say("scan", "--prefix", "user:") == "user:1=alice" and say("scan", "--limit", "0") == ""
    assert say("flush") == "flushed: true\nlayer_id: 1\nentries: 1" and say("delete", "user:1") == "OK"
    assert "dropped_entries: 2" in say("compact") and "memtable_entries: 0" in say("stats") and say("verify") == "layers: 0"
    (tmp_path / "rows.json").write_text('[{"key":"k","value":2}]')
    assert "imported: 1" in say("import", str(tmp_path / "rows.json")) and '"prefix":"","rows":[{"key":"k","value":"2"}]' in say("export") and '"exported_at":"20' in say("export") and say("vacuum").startswith("folders: ")
    with pytest.raises(InvalidInput):
        say("put", "", "x")


def test_layers_taken_in_share_a_folder(spark, store):
    """Many small layers cost neither a file nor a Bloom filter of 1 MB each, and are read one by one, by key and by prefix."""
    entries = spark.range(600).selectExpr("id AS seq", "tinyint(if(id % 7 = 0, 2, 1)) AS op", "concat('k', id div 20, ':', id % 20) AS key", "if(id % 7 = 0, null, string(id)) AS value", "id div 20 AS layer")
    assert store.ingest(entries.repartition(5)) == 30
    folders = {p["path"] for p in store.manifest()["layers"]}
    files = [f for p in folders for f in store._fs.listStatus(store._path(p)) if f.getPath().getName().endswith(".parquet")]
    assert len(folders) == 1 and len(files) <= 4 and sum(f.getLen() for f in files) < 1 << 20
    again = Store(spark, store.root)
    assert again.verify() == 30 and again.layer(7).count() == 20 and {r["layer"] for r in again.layer(7).collect()} == {7}
    assert again.changelog(key="k7:3").count() == 20 and again.get("k7:3") == "143" and again.get("k7:0") is None
    assert [k for k, _ in pairs(again.scan("k7:1"))] == sorted(f"k7:{n}" for n in (1, *range(10, 20)) if (140 + n) % 7)
    again.put("k7:0", "new")
    assert again.get("k7:0") == "new" and again.compact()["output_entries"] == 600 - 86 + 1
    assert again.vacuum() == 3 and again.verify() == 1 and again.get("k7:3") == "143"  # the log, its layer and the shared folder


def test_verify_finds_damage_in_a_shared_folder(spark, store):
    store.ingest(spark.createDataFrame([(1, 1, "a", "1", 1), (2, 1, "b", "2", 1), (3, 1, "a", "3", 2)], store.schema))
    old = store.manifest()
    store._commit(old, layers=[old["layers"][0], old["layers"][1] | {"largest_hex": "62"}])
    with pytest.raises(CorruptLayer, match="layer 2 doesn't hold"):
        store.verify()
    rows = store._read(old["layers"]).repartition(1).sortWithinPartitions("layer", F.desc("key"))
    wrong = store._write(rows, "layers")
    store._commit(store.manifest(), layers=[p | {"path": wrong} for p in old["layers"]])
    with pytest.raises(CorruptLayer, match="layer 1 isn't in strict key order"):
        store.verify()


def test_layers_stand_in_order_on_disk(spark):
    """With many shuffle partitions a write dealt out by layer sorted again by layer only, which lost the order of keys."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        compare(spark, "verify_sorted", QUERIES["verify_sorted"], SQL["verify_sorted"], "/root/testdata/sf0.1")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_store_get_gives_a_key_once(spark, tmp_path):
    """Where user:1 is the least deleted key it is asked for twice, but is one key."""
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    rows = [(0, 0, "click"), (1, 1, "view"), (250, 1, "error"), (251, 2, "error")]
    events = ", ".join(f"({e}, TIMESTAMP '2024-01-01', {u}, '{k}', 1.0, '')" for e, u, k in rows)
    duckdb.sql(f"COPY (SELECT e::BIGINT AS event_id, t AS ts, u::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value, p AS props FROM (VALUES {events}) x(e, t, u, k, v, p)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert compare(spark, "store_get", QUERIES["store_get"], SQL["store_get"], str(tmp_path)) == 2


@pytest.mark.parametrize("rows", [
    [(0, 0, "click"), (1, 1, "view"), (250, 1, "error"), (1000, 2, "view"), (1001, 1, "click"), (1002, 3, "error")],
    [(0, 0, "click"), (1, 2, "view"), (2, 1, "error"), (3, 1, "view")],
], ids=["layers 0, 1 and 5", "layer 0 alone"])
def test_layers_keep_the_numbers_of_the_log(spark, tmp_path, rows):
    """The last layer's number isn't always one above the layer before, and there may be no layer before it."""
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    events = ", ".join(f"({e}, TIMESTAMP '2024-01-01', {u}, '{k}', 1.0, '')" for e, u, k in rows)
    duckdb.sql(f"COPY (SELECT e::BIGINT AS event_id, t AS ts, u::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value, p AS props FROM (VALUES {events}) x(e, t, u, k, v, p)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert compare(spark, "verify_sorted", QUERIES["verify_sorted"], SQL["verify_sorted"], str(tmp_path)) == 2
    for name in ("flush_layer", "store_compact"):
        compare(spark, name, QUERIES[name], SQL[name], str(tmp_path))


def test_taken_in_layers_stay_below_the_next(spark, store):
    with pytest.raises(InvalidInput, match="must be above"):
        store.ingest(spark.createDataFrame([(1, 1, "a", "1", 3)], store.schema), next_layer=3)
    assert not store.versions() and not store._fs.listStatus(store._path("layers"))
    assert store.ingest(spark.createDataFrame([(1, 1, "a", "1", 3)], store.schema), next_layer=7) == 1
    store.put("b", "2")
    assert store.flush()["layer_id"] == 7 and store.verify() == 2
