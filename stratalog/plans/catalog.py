"""The registered queries over the test tables, each beside its SQL for an independent engine."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.hashing import bloom_indices, bloom_length
from stratalog.functions.keys import heap_bytes, keyspace, valid
from stratalog.operators import bloom, merge, read, stats
from stratalog.sources import snapshot, wal
from stratalog.sources.adapters import EVENTS_PER_LAYER, conversations_log, entities, events_log, table, top_layer
from stratalog.sources.store import Store
from stratalog.sources.workspace import workspace
from stratalog.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOG_CTE = f"""WITH log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, 'user:' || user_id AS key,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type || ':' || event_id END AS value, event_id // {EVENTS_PER_LAYER} AS layer FROM events),
latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
entries AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY layer, key ORDER BY seq DESC) = 1),
top AS (SELECT max(layer) AS n FROM log), mem AS (SELECT entries.* FROM entries, top WHERE layer = n),
stored AS (SELECT entries.* FROM entries, top WHERE layer < n),
meta AS (SELECT layer, count(*) AS entry_count, min(key) AS smallest_key, max(key) AS largest_key FROM entries GROUP BY layer)
"""

ENTITY_CTE = """WITH e AS (SELECT 'customer:' || c_custkey AS key, c_mktsegment AS value FROM customer UNION ALL SELECT 'order:' || o_orderkey, o_orderstatus FROM orders
UNION ALL SELECT 'part:' || p_partkey, p_brand FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier)
"""

SAMPLES_CTE = LOG_CTE + ", samples AS (SELECT layer AS seq, sum(strlen(key) + coalesce(strlen(value), 0) + 1)::BIGINT AS bytes FROM entries GROUP BY layer), kept AS (SELECT * FROM samples ORDER BY seq DESC LIMIT 36)\n"

FNV = "list_reduce(list_prepend({seed}::HUGEINT, list_transform(range(1, strlen(key) + 1), lambda i: ascii(key[i])::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
INDICES = f"""SELECT layer, key, bit_len, unnest(list_transform(range(0, 7), lambda i: (((h1 + i * h2) % 18446744073709551616::HUGEINT) % bit_len)::BIGINT)) AS bit FROM (
  SELECT e.layer, e.key, l.bit_len, {FNV.format(seed="14695981039346656037")} AS h1,
  (h2raw + CASE WHEN h2raw % 2 = 0 THEN 1 ELSE 0 END) AS h2 FROM (SELECT *, {FNV.format(seed="11400714819323198485")} AS h2raw FROM entries) e
  JOIN (SELECT layer, greatest(64, 10 * count(*))::BIGINT AS bit_len FROM entries GROUP BY layer) l USING (layer))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _parts(spark, d):
    log = events_log(spark, d)
    return log, top_layer(log)


def _mem(spark, d):
    log, top = _parts(spark, d)
    return read.memtable(log, F.lit(top - 1))


def _plain(records, *names):
    """Some columns, op as a bigint."""
    return records.select(*(F.col(c).cast("bigint").alias(c) if c == "op" else c for c in names))


def _store(spark, d):
    """A store of the events, opened again: all layers but the last on disk, the last one's records as a log batch. Layers keep their numbers, which can have gaps."""
    log, top = _parts(spark, d)
    root = workspace(spark, "store")
    db = Store(spark, root)
    db.ingest(merge.per_layer(log.where(F.col("layer") < top)), next_layer=top)
    db.apply(log.where(F.col("layer") == top))
    return Store(spark, root)


# reads
@query("scan_prefix", LOG_CTE + "SELECT key, value FROM latest WHERE op = 1 AND starts_with(key, 'user:1') ORDER BY key LIMIT 10")
def _(spark, d):
    return read.scan(events_log(spark, d), "user:1", 10)


@query("scan_all", LOG_CTE + "SELECT key, value FROM latest WHERE op = 1 ORDER BY key")
def _(spark, d):
    return read.scan(events_log(spark, d))


@query("scan_limit", LOG_CTE + "SELECT key, value FROM latest WHERE op = 1 ORDER BY key LIMIT 25")
def _(spark, d):
    return read.scan(events_log(spark, d), "", 25)


@query("scan_limit_zero", LOG_CTE + "SELECT 'engine' AS surface, 0::BIGINT AS n UNION ALL SELECT 'http', 0 UNION ALL SELECT 'cli', 0 UNION ALL SELECT 'rpc', count(*) FROM latest WHERE op = 1")
def _(spark, d):
    log = events_log(spark, d)
    out = [read.scan(log, "", 0, s).agg(F.count("*").alias("n")).select(F.lit(s).alias("surface"), "n") for s in ("engine", "http", "cli", "rpc")]
    return merge.union_layers(*out)


@query("scan_http_cap", ENTITY_CTE + "SELECT * FROM (SELECT 'none' AS asked, least(100, count(*))::BIGINT AS n FROM e UNION ALL SELECT '501', least(500, count(*))::BIGINT FROM e)")
def _(spark, d):
    log = entities(spark, d).select(F.lit(1).cast("bigint").alias("seq"), F.lit(1).cast("tinyint").alias("op"), "key", "value")
    out = [read.scan(log, "", n, "http").agg(F.count("*").alias("n")).select(F.lit("none" if n is None else str(n)).alias("asked"), "n") for n in (None, 501)]
    return merge.union_layers(*out)


@query("scan_entities", ENTITY_CTE + "SELECT key, value FROM e WHERE starts_with(key, 'order:1') ORDER BY key LIMIT 200")
def _(spark, d):
    return read.scan(entities(spark, d).select(F.lit(1).cast("bigint").alias("seq"), F.lit(1).cast("tinyint").alias("op"), "key", "value"), "order:1", 200)


@query("scan_range_rewrite", LOG_CTE + "SELECT hex(key) AS key_hex, value FROM latest WHERE op = 1 AND key >= 'user:2' AND key < 'user:3'")
def _(spark, d):
    log = events_log(spark, d).withColumn("key", F.col("key").cast("binary"))
    return read.scan(log, b"user:2").select(F.hex("key").alias("key_hex"), "value")


@query("scan_lines", LOG_CTE + "SELECT key || '=' || value AS line FROM latest WHERE op = 1")
def _(spark, d):
    return read.lines(read.scan(events_log(spark, d)))


@query("get_found", LOG_CTE + "SELECT 'user:1' AS key, coalesce(max(op) = 1, false) AS found, max(CASE WHEN op = 1 THEN value END) AS value FROM latest WHERE key = 'user:1'")
def _(spark, d):
    return read.get(events_log(spark, d), "user:1")


@query("get_missing", "SELECT 'user:none' AS key, false AS found, NULL::VARCHAR AS value")
def _(spark, d):
    return read.get(events_log(spark, d), "user:none")


@query("get_deleted", LOG_CTE + "SELECT key, false AS found, NULL::VARCHAR AS value FROM latest WHERE op = 2 ORDER BY key LIMIT 1")
def _(spark, d):
    log = events_log(spark, d)
    hidden = merge.tombstones(merge.latest(log)).agg(F.min("key")).first()[0]
    return read.get(log, hidden)


@query("merge_latest", LOG_CTE + "SELECT seq, op::BIGINT AS op, key, value FROM latest")
def _(spark, d):
    return _plain(merge.latest(events_log(spark, d)), "seq", "op", "key", "value")


@query("conversation_latest", "SELECT 'conv:' || conv_id AS key, role AS value FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def _(spark, d):
    return read.scan(conversations_log(spark, d), "conv:")


@query("memtable_state", LOG_CTE + "SELECT key, op::BIGINT AS op, value FROM mem")
def _(spark, d):
    return _mem(spark, d).transform(_plain, "key", "op", "value").orderBy("key")


@query("memtable_live", LOG_CTE + "SELECT key, CASE WHEN op = 1 THEN value END AS value FROM mem")
def _(spark, d):
    return _mem(spark, d).select("key", F.when(F.col("op") == 1, F.col("value")).alias("value"))


@query("memtable_scan_raw", LOG_CTE + "SELECT key, op::BIGINT AS op, value FROM mem WHERE starts_with(key, 'user:1') ORDER BY key LIMIT 5")
def _(spark, d):
    return read.raw_scan(_mem(spark, d), "user:1", 5).transform(_plain, "key", "op", "value")


@query("memtable_reverse", LOG_CTE + "SELECT key, op::BIGINT AS op, value FROM mem ORDER BY key DESC LIMIT 7")
def _(spark, d):
    return _plain(read.iterate(_mem(spark, d), descending=True).limit(7), "key", "op", "value")


@query("keyspaces", ENTITY_CTE + "SELECT split_part(key, ':', 1) AS keyspace, count(*) AS n FROM e GROUP BY 1")
def _(spark, d):
    return entities(spark, d).groupBy(keyspace(F.col("key")).alias("keyspace")).agg(F.count("*").alias("n"))


@query("layer_get", LOG_CTE + "SELECT layer, key, op::BIGINT AS op, value FROM entries WHERE layer = 2 AND key = 'user:1'")
def _(spark, d):
    return read.layer_get(events_log(spark, d), 2, "user:1").transform(_plain, "layer", "key", "op", "value")


@query("layer_scan_raw", LOG_CTE + "SELECT key, op::BIGINT AS op, value FROM entries WHERE layer = 1 AND starts_with(key, 'user:1') ORDER BY key LIMIT 8")
def _(spark, d):
    return read.raw_scan(read.layer(events_log(spark, d), 1), "user:1", 8).transform(_plain, "key", "op", "value")


@query("layer_entries", LOG_CTE + "SELECT layer, key, op::BIGINT AS op, value FROM entries WHERE layer = 0")
def _(spark, d):
    return read.layer(events_log(spark, d), 0).transform(_plain, "layer", "key", "op", "value").orderBy("key")


@query("layer_metadata", LOG_CTE + "SELECT layer, entry_count, smallest_key, largest_key FROM meta")
def _(spark, d):
    return stats.layer_metadata(merge.per_layer(events_log(spark, d))).orderBy("layer")


@query("layers_pruned", LOG_CTE + "SELECT layer, smallest_key, largest_key FROM meta WHERE smallest_key <= 'user:98' AND largest_key >= 'user:98'")
def _(spark, d):
    return stats.layers_for_key(stats.layer_metadata(merge.per_layer(events_log(spark, d))), F.lit("user:98")).select("layer", "smallest_key", "largest_key")


@query("validate_keys", "SELECT (k IS NOT NULL AND strlen(k) > 0) AS ok, count(*) AS n FROM (SELECT c_mktsegment AS k FROM customer UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN '' END FROM customer) GROUP BY 1")
def _(spark, d):
    """Names, and as many empty and null keys."""
    customer = table(spark, d, "customer")
    keys = customer.select(F.col("c_mktsegment").alias("k")).unionByName(customer.select(F.when(F.col("c_custkey") % 2 == 0, "").alias("k")))
    return keys.groupBy(valid(F.col("k")).alias("ok")).agg(F.count("*").alias("n"))


# log
@query("wal_replay", LOG_CTE + "SELECT key, op::BIGINT AS op, value FROM latest")
def _(spark, d):
    """Frames in segment files, read back as bytes, checked, decoded and applied in order."""
    folder = workspace(spark, "wal")
    wal.write(events_log(spark, d), folder).collect()
    return _plain(wal.replay(wal.recover(spark, folder)).withColumns({c: F.col(c).cast("string") for c in ("key", "value")}), "key", "op", "value")


LITTLE = "(substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))"
U32 = lambda n: LITTLE.format(h=f"printf('%08X', {n})")
OCTETS = "list_transform(range(0, strlen({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)"
#: CRC-32 by its definition: a bit at a time, of the bytes in hex digits.
CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {OCTETS}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295)"


@query("wal_encode", LOG_CTE + f""", body AS (SELECT seq, printf('%02X', op) || {U32("strlen(key)")} || {U32("strlen(coalesce(value, ''))")} || hex(key) || hex(coalesce(value, '')) AS h FROM log)
SELECT seq, {U32("strlen(h) // 2")} || h || {U32(CRC.format(h="h"))} AS frame_hex FROM body""")
def _(spark, d):
    return wal.encode(events_log(spark, d)).select("seq", F.hex("frame").alias("frame_hex"))


@query("wal_verify", LOG_CTE + "SELECT seq, ['ok', 'corrupt', 'torn', 'oversize', 'torn'][1 + seq % 5] AS verdict FROM log")
def _(spark, d):
    """Frames as they are, with a flipped bit of the payload, without their last byte, with a length over the limit, and cut within the length."""
    octet = F.conv(F.hex(F.substring("frame", 6, 1)), 16, 10).cast("bigint").bitwiseXOR(F.lit(1).cast("bigint"))
    flipped = F.concat(F.substring("frame", 1, 5), F.unhex(F.lpad(F.hex(octet), 2, "0")), F.expr("substring(frame, 7)"))
    kind = F.col("seq") % 5
    damaged = F.when(kind == 0, F.col("frame")).when(kind == 1, flipped).when(kind == 2, F.expr("substring(frame, 1, octet_length(frame) - 1)")).when(kind == 3, F.concat(F.unhex(F.lit("01000008")), F.expr("substring(frame, 5)"))).otherwise(F.substring("frame", 1, 3))
    return wal.verify(wal.encode(events_log(spark, d)).withColumn("frame", damaged))


@query("apply_puts", LOG_CTE + "SELECT row_number() OVER (ORDER BY seq) AS seq, key, value FROM log WHERE op = 1")
def _(spark, d):
    """Written as one batch, numbered by the store, read back."""
    db = Store(spark, workspace(spark, "store"))
    db.apply(events_log(spark, d).where("op = 1"))
    return Store(spark, db.root).changelog().select("seq", "key", "value")


@query("apply_deletes", LOG_CTE + ", gone AS (SELECT DISTINCT key FROM log WHERE op = 2) SELECT key, gone.key IS NULL AS live FROM (SELECT DISTINCT key FROM log WHERE op = 1) p LEFT JOIN gone USING (key)")
def _(spark, d):
    """All puts as one batch, then all deletes: which of the keys put are live."""
    log = events_log(spark, d)
    db = Store(spark, workspace(spark, "store"))
    db.apply(log.where("op = 1"))
    db.apply(log.where("op = 2"))
    left = Store(spark, db.root).scan().select("key", F.lit(True).alias("live"))
    return log.where("op = 1").select("key").distinct().join(left, "key", "left").select("key", F.coalesce("live", F.lit(False)).alias("live"))


@query("flush_layer", LOG_CTE + "SELECT n AS layer, key, op::BIGINT AS op, value FROM mem, top")
def _(spark, d):
    """The MemTable flushed to a layer on disk, and that layer read."""
    db = _store(spark, d)
    return _plain(Store(spark, db.root).layer(db.flush()["layer_id"]), "layer", "key", "op", "value")


@query("store_scan", LOG_CTE + "SELECT key, value FROM latest WHERE op = 1 AND starts_with(key, 'user:1') ORDER BY key LIMIT 40")
def _(spark, d):
    return _store(spark, d).scan("user:1", 40)


@query("store_get", LOG_CTE + "SELECT k AS key, max(CASE WHEN op = 1 THEN value END) AS value FROM (SELECT 'user:1' AS k UNION ALL SELECT 'user:none' UNION ALL SELECT min(key) FROM latest WHERE op = 2) LEFT JOIN latest ON key = k WHERE k IS NOT NULL GROUP BY k")
def _(spark, d):
    db = _store(spark, d)
    hidden = merge.tombstones(merge.latest(db.changelog())).agg(F.min("key")).first()[0]
    keys = dict.fromkeys(["user:1", "user:none", *([hidden] if hidden else [])])  # the least deleted key can be user:1
    return spark.createDataFrame([(k, db.get(k)) for k in keys], "key string, value string")


@query("store_compact", LOG_CTE + "SELECT n + 1 AS layer, key, value FROM latest, top WHERE op = 1")
def _(spark, d):
    """Flush, then all layers as one: that layer as it is on disk, after a check of all that the manifest says of it."""
    db = _store(spark, d)
    db.compact()
    again = Store(spark, db.root)
    again.verify()
    return again.layer(again.manifest()["layers"][0]["layer"]).select("layer", "key", "value")


@query("store_feed", LOG_CTE + "SELECT 1 + max(seq) OVER () - count(*) OVER () + row_number() OVER (ORDER BY seq) - 1 AS seq, CASE op WHEN 1 THEN 'put' WHEN 2 THEN 'delete' END AS event, key, coalesce(value, '') AS value FROM (SELECT l.* FROM log l, top WHERE l.layer = n) QUALIFY starts_with(key, 'user:1')")
def _(spark, d):
    """What a feed from the first version on gives of the batches that were committed."""
    db, folder = _store(spark, d), workspace(spark, "feed")
    db.feed(lambda rows, k: rows.write.mode("overwrite").parquet(f"{folder}/batch={k}"), "user:1", since=0, until_now=True).awaitTermination()
    return spark.read.parquet(folder).drop("batch")


@query("flush_report", LOG_CTE + "SELECT count(*) > 0 AS flushed, max(n)::BIGINT AS layer_id, count(*) AS entries FROM mem, top")
def _(spark, d):
    log, top = _parts(spark, d)
    return stats.flush_report(read.memtable(log, F.lit(top - 1)), F.lit(top))


@query("stats", LOG_CTE + """, mb AS (SELECT count(*) AS memtable_entries, coalesce(sum(strlen(key) + coalesce(strlen(value), 0) + 1), 0)::BIGINT AS memtable_bytes FROM mem)
SELECT memtable_entries, memtable_bytes, memtable_bytes >= 67108864 AS should_flush, (SELECT count(DISTINCT layer) FROM stored) AS layer_count, (SELECT count(DISTINCT layer) FROM stored) AS bloom_filter_count, (SELECT coalesce(max(layer), 0) + 1 FROM stored)::BIGINT AS next_layer_id FROM mb""")
def _(spark, d):
    log, top = _parts(spark, d)
    return stats.store_stats(read.memtable(log, F.lit(top - 1)), stats.layer_metadata(merge.per_layer(log.where(F.col("layer") < top))))


@query("flush_pressure", LOG_CTE + "SELECT memtable_bytes, least(100, floor(100.0 * memtable_bytes / 4096 + 0.5))::BIGINT AS pressure FROM (SELECT coalesce(sum(strlen(key) + coalesce(strlen(value), 0) + 1), 0)::BIGINT AS memtable_bytes FROM mem)")
def _(spark, d):
    return stats.flush_pressure(stats.memtable_stats(_mem(spark, d), 4096), 4096).select("memtable_bytes", "pressure")


def _samples(spark, d):
    return merge.per_layer(events_log(spark, d)).groupBy(F.col("layer").alias("seq")).agg(F.sum(heap_bytes(F.col("key"), F.col("value"))).cast("bigint").alias("bytes"))


@query("stats_delta", SAMPLES_CTE + "SELECT seq, bytes, (bytes - coalesce(lag(bytes) OVER (ORDER BY seq), bytes))::BIGINT AS delta FROM kept")
def _(spark, d):
    return stats.deltas(_samples(spark, d), "bytes")


@query("stats_scaled", SAMPLES_CTE + "SELECT seq, (bytes - min(bytes) OVER ())::DOUBLE / greatest(1, max(bytes) OVER () - min(bytes) OVER ()) AS scaled FROM kept")
def _(spark, d):
    return stats.scaled(_samples(spark, d), "bytes").select("seq", "scaled")


@query("compact_output", LOG_CTE + "SELECT key, value FROM latest WHERE op = 1")
def _(spark, d):
    return stats.compact_output(merge.per_layer(events_log(spark, d))).select("key", "value").orderBy("key")


@query("compact_report", LOG_CTE + """SELECT true AS flushed_memtable, (SELECT count(DISTINCT layer) FROM log) AS input_layers, 1::BIGINT AS output_layers, (SELECT count(*) FROM entries) AS input_entries,
(SELECT count(*) FROM latest WHERE op = 1) AS output_entries, (SELECT count(*) FROM entries) - (SELECT count(*) FROM latest WHERE op = 1) AS dropped_entries""")
def _(spark, d):
    log, top = _parts(spark, d)
    return stats.compact_report(log, F.lit(top - 1))


@query("compact_dropped_rows", LOG_CTE + "SELECT layer, key, seq FROM entries WHERE seq NOT IN (SELECT seq FROM latest WHERE op = 1)")
def _(spark, d):
    return merge.dropped_versions(merge.per_layer(events_log(spark, d))).select("layer", "key", "seq")


@query("verify_sorted", LOG_CTE + "SELECT layer, key FROM mem WHERE key < (SELECT max(key) FROM mem)")
def _(spark, d):
    """Layers as they stand on disk: those of the store are in order, and one written from its last key to its first breaks the order at each key but the last."""
    db = _store(spark, d)
    names = [p["path"] for p in db.manifest()["layers"]]
    wrong = db._write(db.memtable().repartition(1).sortWithinPartitions(F.desc("key")), "layers")
    return stats.unsorted_neighbours(db.stored(*names, wrong))


# Bloom filters
@query("bloom_indices", LOG_CTE + f"SELECT * FROM ({INDICES})")
def _(spark, d):
    return bloom.indices(merge.per_layer(events_log(spark, d)))


@query("bloom_bits", LOG_CTE + f"SELECT layer, bit_len, bit // 8 AS byte_no, bit_or((1 << (bit % 8)::INT)::BIGINT) AS bits FROM ({INDICES}) GROUP BY ALL")
def _(spark, d):
    return bloom.build(merge.per_layer(events_log(spark, d)))


@query("bloom_probe", LOG_CTE + f""", asked AS (SELECT layer, key FROM entries UNION SELECT layer - 1, key FROM entries), own AS ({INDICES}), other AS ({INDICES.replace("FROM entries) e", "FROM asked) e")})
SELECT a.layer, a.key, bool_and(o.bit IS NOT NULL) AS maybe FROM other a LEFT JOIN (SELECT DISTINCT layer, bit FROM own) o ON a.layer = o.layer AND a.bit = o.bit GROUP BY a.layer, a.key""")
def _(spark, d):
    """Each key of all layers against its own layer and the one before, which lacks most of them."""
    entries = merge.per_layer(events_log(spark, d))
    return bloom.probe(bloom.build(entries), entries.select("layer", "key").unionByName(entries.select((F.col("layer") - 1).alias("layer"), "key")))


@query("bloom_golden", "SELECT * FROM (VALUES ('alpha', '43,6,33,60,23,50,13'), ('beta', '39,30,21,12,3,58,49'), ('gamma', '42,37,32,27,22,17,12')) t(key, bits)")
def _(spark, d):
    keys = spark.sql("SELECT * FROM VALUES ('alpha'), ('beta'), ('gamma') AS t(key)")
    return keys.select("key", F.array_join(bloom_indices(spark, F.col("key"), bloom_length(F.lit(3))).cast("array<string>"), ",").alias("bits"))


# snapshots
IMPORT = '{"rows":[{"key":"user:1","value":"alice"},{"key":"","value":"skipped"},{"key":"user:2","value":"bob"},{"key":"user:1","value":"alicia"}]}'


def _doc(spark, text=IMPORT):
    return spark.range(1).select(F.lit(text).alias("doc"))


@query("import_apply", "SELECT * FROM (VALUES ('user:1', 'alicia'), ('user:2', 'bob')) t(key, value)")
def _(spark, d):
    return read.scan(snapshot.import_log(_doc(spark)))


@query("import_count", "SELECT 3::BIGINT AS imported")
def _(spark, d):
    return snapshot.import_log(_doc(spark)).agg(F.count("*").alias("imported"))


ODD = '[{"key":"a","value":1},{"key":"b"},{"key":1.0,"value":true},{"key":"c","value":{"x":1}},{"key":"d","value":[1,null,"x",2.50]},{"value":"no key"},{"key":"e","value":null},{"key":"f","value":1e21},{"key":"g","value":0.0000001},{"key":"h","value":-123456789.125},{"key":"i","value":"1.0"}]'


@query("import_parse", """SELECT * FROM (VALUES (0::BIGINT, 'a', '1'), (1, 'b', ''), (2, '1', 'true'), (3, 'c', '[object Object]'), (4, 'd', '1,,x,2.5'), (5, '', 'no key'), (6, 'e', ''), (7, 'f', '1e+21'), (8, 'g', '1e-7'), (9, 'h', '-123456789.125'), (10, 'i', '1.0')) t(pos, key, value)""")
def _(spark, d):
    rows = _doc(spark, ODD).select(F.posexplode(snapshot.parse_rows(F.col("doc"))).alias("pos", "r"))
    return rows.select(F.col("pos").cast("bigint").alias("pos"), "r.key", "r.value")


@query("demo_seed", "SELECT * FROM (VALUES (1::BIGINT,'user:1','alice'),(2,'user:2','bob'),(3,'user:3','carol'),(4,'order:1001','paid'),(5,'order:1002','pending'),(6,'feature:bloom','enabled')) t(seq, key, value)")
def _(spark, d):
    return snapshot.demo(spark).select("seq", "key", "value")


@query("export_rows", LOG_CTE + """SELECT '{"exported_at":"2000-01-01T00:00:00.000Z","prefix":"user:1","rows":[' || string_agg('{"key":"' || key || '","value":"' || value || '"}', ',' ORDER BY key) || ']}' AS snapshot FROM (SELECT key, value FROM latest WHERE op = 1 AND starts_with(key, 'user:1') ORDER BY key LIMIT 50)""")
def _(spark, d):
    return snapshot.export_json(read.scan(events_log(spark, d), "user:1", 50), "user:1", F.lit("2000-01-01T00:00:00.000Z"))


# change feed
NAME = "CASE op WHEN 1 THEN 'put' WHEN 2 THEN 'delete' ELSE 'unknown' END"


@query("watch_events", LOG_CTE + f"SELECT seq, {NAME} AS event, key, coalesce(value, '') AS value FROM log")
def _(spark, d):
    return watch.events(events_log(spark, d))


@query("watch_prefix", LOG_CTE + f"SELECT seq, {NAME} AS event, key, coalesce(value, '') AS value FROM log WHERE starts_with(key, 'user:1')")
def _(spark, d):
    return watch.run_to_files(watch.watch(watch.event_stream(spark, d), "user:1"), workspace(spark, "watch"))


@query("watch_json", LOG_CTE + f"""SELECT seq, '{{"event":"' || {NAME} || '","key":"' || key || '","value":"' || coalesce(value, '') || '"}}' AS payload FROM log""")
def _(spark, d):
    return watch.as_json(watch.events(events_log(spark, d)))


@query("watch_lines", LOG_CTE + f"SELECT seq, upper({NAME}) || ' ' || key || CASE WHEN value IS NULL THEN '' ELSE '=' || value END AS line FROM log")
def _(spark, d):
    return watch.as_lines(watch.events(events_log(spark, d)))


@query("watch_recent", LOG_CTE + f"SELECT seq, {NAME} AS event, key FROM log ORDER BY seq DESC LIMIT 12")
def _(spark, d):
    return stats.recent(watch.events(events_log(spark, d)), 12).select("seq", "event", "key")


@query("stream_state", LOG_CTE + "SELECT seq, op::BIGINT AS op, key, value FROM latest")
def _(spark, d):
    return _plain(watch.run_to_files(watch.state(watch.event_stream(spark, d)), workspace(spark, "state"), "complete"), "seq", "op", "key", "value")
