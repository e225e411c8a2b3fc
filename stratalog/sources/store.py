"""A persistent store: log batches and layers as Parquet folders, one numbered manifest a commit.

A commit writes its data under a fresh folder name and then creates manifest number n+1 whole, in one step that fails if another writer was first. Readers see the highest manifest or the one before; nothing that a manifest names is overwritten. What a flush or a compaction replaces stays on disk for `keep` more commits, so that open readers and feeds come to their end, and is then deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.errors import Conflict, CorruptLayer, InvalidInput, Lagged
from stratalog.functions.keys import check_key, heap_bytes, octets, valid
from stratalog.operators import merge, read, stats
from stratalog.schema import DELETE, FLUSH_BYTES, MAX_RECORD_BYTES, PUT, layer_schema
from stratalog.sources import snapshot
from stratalog.sources.workspace import hadoop_path
from stratalog.streaming import watch

#: added: the batches that this commit brought, for feeds. retired: folders no longer named, with the version that dropped them.
EMPTY = {"version": 0, "seq": 0, "next_layer": 1, "batches": [], "layers": [], "added": [], "retired": []}
KEEP = 10
#: monotonically_increasing_id() has the partition above this bit and the row's place below it.
PLACE_BITS = 33


class Store:
    """get, scan, put, delete, flush, compact, stats, import and feed over one folder on any file system that Spark reaches.

    Keys and values are text, or bytes where `kind` is "binary"; both order by unsigned bytes.
    """

    def __init__(self, spark: SparkSession, root: str, flush_bytes: int = FLUSH_BYTES, kind: str = "string", keep: int = KEEP):
        if kind not in ("string", "binary"):
            raise InvalidInput(f"keys are string or binary, not {kind!r}")
        self.spark, self.root, self.flush_bytes, self.kind, self.keep = spark, root.rstrip("/"), flush_bytes, kind, keep
        self.schema = layer_schema(kind)
        self._jvm = spark.sparkContext._jvm
        self._fs, path = hadoop_path(spark, f"{self.root}/manifests")
        self._fs.mkdirs(path)
        m = self.manifest()
        for p in dict.fromkeys(p["path"] for p in (*m["layers"], *m["batches"])):
            if not self._fs.exists(self._path(p)):
                raise CorruptLayer(f"{p} is named by version {m['version']} but isn't there")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    # manifests
    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("manifests")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                return dict(EMPTY)
            version = known[-1]
        name = f"manifests/{version:020d}.json"
        stream = self._fs.open(self._path(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            m = json.loads(text)
        except ValueError as e:
            raise CorruptLayer(f"{name} isn't JSON") from e
        if not isinstance(m, dict) or not EMPTY.keys() <= m.keys():
            raise CorruptLayer(f"{name} lacks {sorted(EMPTY.keys() - set(m))}")
        return m

    def _create(self, name: str, data: bytes) -> bool:
        """Create a file with its whole content in one step; False if it is there already. On a local disk that is a hard link to a finished file, elsewhere a rename that doesn't overwrite, which HDFS and ABFS do in one step. Object stores without such a rename need a single writer."""
        temp, target = self._path(f"manifests/.{uuid.uuid4().hex}.tmp"), self._path(name)
        out = self._fs.create(temp, True)
        out.write(bytearray(data))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                disk = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(disk(target), disk(temp))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(temp, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self._fs.delete(temp, False)
        return True

    def _commit(self, old: dict, **change) -> dict:
        new = old | {"added": []} | change | {"version": old["version"] + 1}
        if not self._create(f"manifests/{new['version']:020d}.json", json.dumps(new).encode()):
            for p in new["added"]:  # a batch that lost is nobody's
                self._fs.delete(self._path(p["path"]), True)
            raise Conflict(f"version {new['version']} was committed by another writer")
        return new

    def _retire(self, old: dict, parts: list[dict]) -> list[dict]:
        return [*old["retired"], *({"path": p, "version": old["version"] + 1} for p in dict.fromkeys(p["path"] for p in parts))]

    def vacuum(self, keep: int = 0) -> int:
        """Delete the folders that were dropped more than `keep` versions ago, and older manifests; returns the number of folders. Readers and feeds that old then fail."""
        m = self.manifest()
        gone = [p for p in m["retired"] if p["version"] <= m["version"] - keep]
        for p in gone:
            self._fs.delete(self._path(p["path"]), True)
        if gone:
            m = self._commit(m, retired=[p for p in m["retired"] if p not in gone])
            for v in self.versions():
                if v < m["version"] - keep:
                    self._fs.delete(self._path(f"manifests/{v:020d}.json"), False)
        return len(gone)

    def _tidy(self) -> None:
        try:
            self.vacuum(self.keep)
        except Conflict:  # the next flush tries again
            pass

    def _write(self, df: DataFrame, kind: str, name: str = "") -> str:
        name = f"{kind}/{name or uuid.uuid4().hex}"
        # without the adaptive size a filter takes 1 MB a file, however few its keys
        bloom = {} if kind == "staged" else {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        df.write.options(**bloom).parquet(f"{self.root}/{name}")
        return name

    def _read(self, parts: list[dict]) -> DataFrame:
        """All parts as one scan. A folder that layers share is read by layer number where only some of them are wanted."""
        folders: dict[str, list[dict]] = {}
        for p in parts:
            folders.setdefault(p["path"], []).append(p)
        scan = lambda names: self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{n}" for n in names))
        some = {n: ps for n, ps in folders.items() if len(ps) < ps[0].get("sharing", 1)}
        whole = [n for n in folders if n not in some]
        frames = [scan([n]).where(f"layer IN ({', '.join(str(p['layer']) for p in ps)})") for n, ps in some.items()]
        if whole:
            frames.append(scan(whole))
        return merge.union_layers(*frames) if frames else self.spark.createDataFrame([], self.schema)

    # writes
    def apply(self, changes: DataFrame) -> int:
        """Commit (op, key, value) rows as one batch; returns their number. All or none become visible.

        `seq` gives the order within the batch only: rows are numbered on from the store's last number. So a null or repeated `seq` is InvalidInput, as are empty keys, unknown ops and records over the size limit. The rows are evaluated once: what was written is checked, then numbered.
        """
        old = self.manifest()
        value = F.when(F.col("op") == PUT, F.coalesce("value", F.lit("").cast(self.kind)))
        rows = changes.select(F.col("seq").cast("bigint").alias("seq"), F.col("op").cast("tinyint").alias("op"), "key", value.alias("value"))
        staged = self._write(rows.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("place", F.monotonically_increasing_id()), "staged")
        try:
            rows = self.spark.read.parquet(f"{self.root}/{staged}")
            size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 9
            part = F.shiftright("place", PLACE_BITS)
            bad = [F.count_if(F.col("seq").isNull()), F.count("seq") - F.count_distinct("seq"), F.count_if(~valid(F.col("key"))), F.count_if(size > MAX_RECORD_BYTES), F.count_if(~F.col("op").isin(PUT, DELETE) | F.col("op").isNull())]
            n, weight, *wrong = rows.agg(F.count("*"), F.sum(heap_bytes(F.col("key"), F.col("value"))), *bad).first()
            for count, what in zip(wrong, ("seq must not be null", "seq must not repeat", "keys must not be empty", f"records must not be over {MAX_RECORD_BYTES} bytes", "op must be put or delete"), strict=True):
                if count:
                    raise InvalidInput(what)
            if not n:
                return 0
            pieces = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first")).withColumn("shift", F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("first")).select("part", "shift")
            numbered = rows.withColumn("part", part).join(pieces, "part").select((F.col("place") + F.col("shift") + (old["seq"] + 1)).cast("bigint").alias("seq"), "op", "key", "value", F.lit(old["next_layer"]).cast("bigint").alias("layer"))
            self._batch(old, numbered, n, weight)
        finally:
            self._fs.delete(self._path(staged), True)
        return n

    def _batch(self, old: dict, numbered: DataFrame, n: int, weight: int) -> None:
        part = {"path": self._write(numbered, "log"), "entries": n, "bytes": weight}
        new = self._commit(old, seq=old["seq"] + n, batches=[*old["batches"], part], added=[part])
        # the batches' own bytes are what the MemTable has at most
        if sum(p["bytes"] for p in new["batches"]) >= self.flush_bytes and self.memtable_stats().first()["should_flush"]:
            self.flush()

    def put(self, key: str | bytes, value: str | bytes) -> None:
        self._one(PUT, key, value)

    def delete(self, key: str | bytes) -> None:
        self._one(DELETE, key, None)

    def _one(self, op: int, key: str | bytes, value: str | bytes | None) -> None:
        size = len(octets(check_key(key))) + len(octets(value))
        if size + 9 > MAX_RECORD_BYTES:
            raise InvalidInput(f"records must not be over {MAX_RECORD_BYTES} bytes")
        old = self.manifest()
        raw = lambda x: bytearray(x) if isinstance(x, bytes) else x
        row = (old["seq"] + 1, op, raw(key), raw(value), old["next_layer"])
        self._batch(old, self.spark.createDataFrame([row], self.schema).coalesce(1), 1, size + 1)

    def flush(self) -> dict:
        """The MemTable as a new layer, sorted by key; tombstones stay, because older layers may hold what they hide."""
        old = self.manifest()
        if not old["batches"]:
            return {"flushed": False, "layer_id": 0, "entries": 0}
        layer = old["next_layer"]
        mem = merge.latest(self._read(old["batches"])).withColumn("layer", F.lit(layer).cast("bigint"))
        part = self._layer(mem, layer)
        self._commit(old, batches=[], layers=[*old["layers"], part], next_layer=layer + 1, retired=self._retire(old, old["batches"]))
        self._tidy()
        return {"flushed": True, "layer_id": layer, "entries": part["entry_count"]}

    def _layer(self, records: DataFrame, layer: int) -> dict:
        name = self._write(records.repartitionByRange("key").sortWithinPartitions("key"), "layers")
        meta = stats.layer_metadata(self._read([{"path": name}])).first()
        return {"path": name, "layer": layer, "entry_count": 0} | (self._range(meta) if meta else {})

    @staticmethod
    def _range(meta) -> dict:
        return {"entry_count": meta["entry_count"], "smallest_hex": octets(meta["smallest_key"]).hex(), "largest_hex": octets(meta["largest_key"]).hex()}

    def ingest(self, entries: DataFrame, next_layer: int | None = None) -> int:
        """Commit whole layers, oldest first by `layer`: (seq, op, key, value, layer) with one record for a key in a layer. For a store without data; returns the number of layers. They share one folder, in the order of layer and key, so that small layers don't cost a file each. The next flush gets the number `next_layer`, or one above the last."""
        old = self.manifest()
        if old["layers"] or old["batches"]:
            raise InvalidInput("layers can be taken in by an empty store only")
        # no partitionBy here: Spark would sort again by the partition column, which loses the order of keys
        name = self._write(entries.select(*self.schema.names).repartitionByRange("layer", "key").sortWithinPartitions("layer", "key"), "layers")
        meta = self._read([{"path": name}])
        rows = stats.layer_metadata(meta).orderBy("layer").collect()
        layers = [{"path": name, "layer": r["layer"], "sharing": len(rows)} | self._range(r) for r in rows]
        least = layers[-1]["layer"] + 1 if layers else None
        if layers and next_layer is not None and next_layer < least:
            self._fs.delete(self._path(name), True)
            raise InvalidInput("the next layer's number must be above all others")
        if layers or next_layer is not None:
            self._commit(old, layers=layers, next_layer=least if next_layer is None else next_layer, seq=meta.agg(F.max("seq")).first()[0] if layers else old["seq"])
        return len(layers)

    def compact(self) -> dict:
        """All layers as one without tombstones. The old ones are retired, not deleted, so open readers end."""
        flushed = self.flush()["flushed"]
        old = self.manifest()
        report = {"flushed_memtable": flushed, "input_layers": len(old["layers"]), "output_layers": 0, "input_entries": sum(p["entry_count"] for p in old["layers"]), "output_entries": 0}
        if old["layers"]:
            layer = old["next_layer"]
            part = self._layer(stats.compact_output(self._read(old["layers"])).withColumn("layer", F.lit(layer).cast("bigint")), layer)
            dead = not part["entry_count"]
            self._commit(old, layers=[] if dead else [part], next_layer=layer + (not dead), retired=self._retire(old, old["layers"]))
            report |= {"output_layers": int(not dead), "output_entries": part["entry_count"]}
            self._tidy()
        return report | {"dropped_entries": max(0, report["input_entries"] - report["output_entries"])}

    def import_json(self, text: str) -> dict:
        """Put the rows of a JSON snapshot in order; rows without a key are skipped. A row that can't be stored ends the import: those before it are in, and counted."""
        rows = snapshot.load(self.spark, text)
        size = F.octet_length("key") + F.octet_length("value") + 9
        stop = rows.where(size > MAX_RECORD_BYTES).agg(F.min("seq")).first()[0]
        n = self.apply(rows if stop is None else rows.where(F.col("seq") < stop))
        return {"success": stop is None, "imported": n, "message": f"imported {n} rows" if stop is None else f"records must not be over {MAX_RECORD_BYTES} bytes"}

    def export_json(self, prefix: str = "", limit: int | None = None) -> str:
        return snapshot.export_json(self.scan(prefix, limit), prefix).first()["snapshot"]

    # reads
    def changelog(self, key: str | bytes | None = None, prefix: str | bytes | None = None) -> DataFrame:
        """All versions that can matter; layers whose key range can't hold the key or prefix aren't read."""
        m = self.manifest()

        def wanted(p: dict) -> bool:
            small, large = bytes.fromhex(p["smallest_hex"]), bytes.fromhex(p["largest_hex"])
            if key is not None:
                return small <= octets(key) <= large
            low = octets(prefix)
            return large >= low and (small <= low or small.startswith(low))

        return self._read([*(p for p in m["layers"] if wanted(p)), *m["batches"]])

    def get(self, key: str | bytes) -> str | bytes | None:
        row = read.get(self.changelog(key=check_key(key)), key).first()
        value = row["value"] if row["found"] else None
        return bytes(value) if isinstance(value, bytearray) else value

    def scan(self, prefix: str | bytes = "", limit: int | None = None, surface: str = "engine") -> DataFrame:
        if self.kind == "binary" and isinstance(prefix, str):
            prefix = prefix.encode()
        return read.scan(self.changelog(prefix=prefix), prefix, limit, surface)

    def layer(self, number: int) -> DataFrame:
        """The records of one layer with `file` and `row`, their place in it."""
        part = next((p for p in self.manifest()["layers"] if p["layer"] == number), None)
        if part is None:
            raise InvalidInput(f"there is no layer {number}")
        rows = self.stored(part["path"])
        return rows.where(F.col("layer") == number) if "sharing" in part else rows

    def stored(self, *paths: str) -> DataFrame:
        rows = self._read([{"path": p} for p in paths])
        return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))

    def memtable(self) -> DataFrame:
        return merge.latest(self._read(self.manifest()["batches"]))

    def memtable_stats(self) -> DataFrame:
        return stats.memtable_stats(self.memtable(), self.flush_bytes)

    def stats(self) -> dict:
        m = self.manifest()
        return self.memtable_stats().first().asDict() | {"layer_count": len(m["layers"]), "bloom_filter_count": len(m["layers"]), "next_layer_id": m["next_layer"]}

    def verify(self) -> int:
        """Read every layer and hold it against the manifest: count, key range, layer number and strict key order. Returns the number of layers, or raises CorruptLayer."""
        parts = self.manifest()["layers"]
        named: dict[str, dict[int, dict]] = {}
        for p in parts:
            named.setdefault(p["path"], {})[p["layer"]] = {k: p[k] for k in ("entry_count", "smallest_hex", "largest_hex")}
        for path, want in named.items():
            rows = self.stored(path)
            found = {r["layer"]: self._range(r) for r in stats.layer_metadata(rows).collect()}
            wrong = [n for n in sorted(want.keys() | found.keys()) if want.get(n) != found.get(n)]
            if wrong:
                raise CorruptLayer(f"layer {wrong[0]} doesn't hold what the manifest says")
            wrong = stats.unsorted_neighbours(rows).first()
            if wrong:
                raise CorruptLayer(f"layer {wrong['layer']} isn't in strict key order")
        return len(parts)

    # the change feed
    def changes(self, since: int, prefix: str = "", upto: int | None = None) -> DataFrame:
        """(seq, event, key, value) of the batches committed after version `since`. Lagged if some of them are deleted already."""
        known = [v for v in self.versions() if v > since and (upto is None or v <= upto)]
        if (known or [since + 1])[0] > since + 1:
            raise Lagged(f"versions {since + 1} to {known[0] - 1} are gone")
        return self._changes([self.manifest(v) for v in known], prefix)

    def _changes(self, manifests: list[dict], prefix: str) -> DataFrame:
        parts = [p for m in manifests for p in m["added"]]
        lost = [p for p in parts if not self._fs.exists(self._path(p["path"]))]
        if lost:
            raise Lagged(f"watch lagged by {sum(p['entries'] for p in lost)} events")
        return watch.watch(self._read(parts), prefix)

    def feed(self, sink: Callable[[DataFrame, int], None], prefix: str = "", since: int | None = None, checkpoint: str | None = None, at_once: int = 1024, until_now: bool = False) -> StreamingQuery:
        """Call sink(events, id) for committed changes, from now on or from after version `since`: a stream over the manifests, so what wasn't committed is never seen. Events are in commit order, at most `at_once` commits go to the sink together, and with a checkpoint each commit is delivered once. A feed that is so late that batches were deleted ends with Lagged."""
        start = self.manifest()["version"] if since is None else since
        versions = self.spark.readStream.option("maxFilesPerTrigger", at_once).text(f"{self.root}/manifests", wholetext=True)
        # a manifest grows with the layers, so only what a commit added comes to the driver
        commit = F.from_json("value", "version BIGINT, added ARRAY<STRUCT<path: STRING, entries: BIGINT, bytes: BIGINT>>", {"mode": "FAILFAST"})
        added = versions.select(commit.alias("m")).select("m.version", "m.added").where((F.col("version") > start) & (F.size("added") > 0))

        def batch(rows: DataFrame, k: int) -> None:
            new = sorted((r.asDict(recursive=True) for r in rows.collect()), key=lambda m: m["version"])
            if new:
                sink(self._changes(new, prefix).orderBy("seq"), k)

        out = added.writeStream.foreachBatch(batch)
        if checkpoint:
            out = out.option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if until_now else out.trigger(processingTime="1 second")).start()

