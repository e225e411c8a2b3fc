"""Layer metadata, store statistics and the reports of flush and compaction, each as a DataFrame."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.keys import has_prefix, heap_bytes
from stratalog.operators.merge import latest, live, per_layer
from stratalog.schema import FLUSH_BYTES


def layer_metadata(entries: DataFrame) -> DataFrame:
    """(layer, entry_count, smallest_key, largest_key) of stored layers."""
    return entries.groupBy("layer").agg(F.count("*").alias("entry_count"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"))


def layers_for_key(metadata: DataFrame, key: Column) -> DataFrame:
    """The layers whose key range can hold the key; the others needn't be read."""
    return metadata.where((F.col("smallest_key") <= key) & (F.col("largest_key") >= key))


def layers_for_prefix(metadata: DataFrame, prefix: str) -> DataFrame:
    return metadata.where((F.col("largest_key") >= F.lit(prefix)) & ((F.col("smallest_key") <= F.lit(prefix)) | has_prefix(F.col("smallest_key"), prefix)))


def memtable_stats(mem: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    size = F.coalesce(F.sum(heap_bytes(F.col("key"), F.col("value"))), F.lit(0)).cast("bigint")
    return mem.agg(F.count("*").alias("memtable_entries"), size.alias("memtable_bytes")).withColumn("should_flush", F.col("memtable_bytes") >= threshold)


def store_stats(mem: DataFrame, metadata: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """One row. Every layer has a Bloom filter; the next id is one above the highest layer, or 1. The two sides' sums meet in one aggregate."""
    none = F.lit(0).cast("bigint")
    left = mem.agg(F.count("*").alias("n"), F.sum(heap_bytes(F.col("key"), F.col("value"))).cast("bigint").alias("bytes")).select("n", "bytes", none.alias("layers"), none.alias("top"))
    right = metadata.agg(F.count("*").alias("layers"), F.max("layer").cast("bigint").alias("top")).select(none.alias("n"), none.alias("bytes"), "layers", "top")
    s = left.unionByName(right).agg(*(F.coalesce(F.sum(c), none).cast("bigint").alias(c) for c in ("n", "bytes", "layers", "top")))
    return s.select(F.col("n").alias("memtable_entries"), F.col("bytes").alias("memtable_bytes"), (F.col("bytes") >= threshold).alias("should_flush"), F.col("layers").alias("layer_count"), F.col("layers").alias("bloom_filter_count"), (F.col("top") + 1).alias("next_layer_id"))


def flush_report(mem: DataFrame, next_id: int | Column) -> DataFrame:
    n = F.count("*")
    return mem.agg((n > 0).alias("flushed"), F.when(n > 0, next_id).otherwise(0).cast("bigint").alias("layer_id"), n.alias("entries"))


def compact_output(entries: DataFrame) -> DataFrame:
    """What a full compaction writes: the newest live record of each key. All tombstones go, because no older layer stays."""
    return live(latest(entries))


def compact_report(log: DataFrame, flushed: Column) -> DataFrame:
    """One row: the MemTable is flushed first, then all layers become one."""
    per_key = per_layer(log).groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("seq", "op")).alias("r"))
    none, no = F.lit(0).cast("bigint"), F.lit(False)
    left = per_key.agg(F.sum("n").alias("n"), F.count_if(F.col("r.op") == 1).alias("live")).select(F.coalesce("n", none).alias("n"), "live", none.alias("layers"), no.alias("fresh"))
    right = log.agg(F.count_distinct("layer").alias("layers"), F.coalesce(F.max(F.col("layer") > flushed), no).alias("fresh")).select(none.alias("n"), none.alias("live"), "layers", "fresh")
    s = left.unionByName(right).agg(F.sum("n").alias("n"), F.sum("live").alias("live"), F.sum("layers").alias("layers"), F.max("fresh").alias("fresh"))
    return s.select(F.col("fresh").alias("flushed_memtable"), F.col("layers").alias("input_layers"), F.when(F.col("live") > 0, 1).otherwise(0).cast("bigint").alias("output_layers"), F.col("n").alias("input_entries"), F.col("live").alias("output_entries"), F.greatest(none, F.col("n") - F.col("live")).alias("dropped_entries"))


def flush_pressure(stats: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """Percent of the threshold in use, halves rounded up, at most 100."""
    share = F.floor(F.lit(100.0) * F.col("memtable_bytes") / max(1, threshold) + 0.5)
    return stats.withColumn("pressure", F.least(F.lit(100), share).cast("bigint"))


def recent(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("seq")).limit(n)


def deltas(samples: DataFrame, value: str, keep: int = 36) -> DataFrame:
    """The last `keep` samples (a fixed display window) with the change from the sample before."""
    kept = recent(samples, keep)
    return kept.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.orderBy("seq")), F.col(value)))


def scaled(samples: DataFrame, value: str, keep: int = 36) -> DataFrame:
    """The last `keep` samples on a scale from 0 to 1."""
    kept, w = recent(samples, keep), Window.partitionBy()
    low, high = F.min(value).over(w), F.max(value).over(w)
    return kept.withColumn("scaled", (F.col(value) - low) / F.greatest(F.lit(1), high - low))


def benchmark_summary(completed: int, errors: int, elapsed_ms: float) -> dict:
    """The figures a load run shows; latency is elapsed time over operations, not a per-request figure."""
    return {"ops_per_s": round(completed / max(1.0, elapsed_ms) * 1000), "avg_ms": elapsed_ms / completed if completed else 0.0, "errors": errors}


def unsorted_neighbours(entries: DataFrame) -> DataFrame:
    """(layer, key) that don't stand strictly above the key before them, where `file` and `row` are the place in storage. Files are compared within themselves; only their first and last keys meet by layer."""
    place = Window.partitionBy("layer", "file").orderBy("row")
    inside = entries.withColumn("before", F.lag("key").over(place)).where(F.col("before") >= F.col("key")).select("layer", "key")
    ends = entries.groupBy("layer", "file").agg(F.min_by("key", "row").alias("first"), F.max_by("key", "row").alias("last"))
    border = ends.withColumn("before", F.lag("last").over(Window.partitionBy("layer").orderBy("file"))).where(F.col("before") >= F.col("first")).select("layer", F.col("first").alias("key"))
    return inside.unionByName(border)
