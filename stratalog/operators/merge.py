"""Newest version wins. Every read is this merge, and tombstones are filtered only above it."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.schema import DELETE, PUT


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """One record for each key: that with the highest seq. A hash aggregate with map-side partials: a hot key reaches the shuffle once per task."""
    keys = keys or ("key",)
    rest = [c for c in log.columns if c not in keys and c != "seq"]
    best = log.groupBy(*keys).agg(F.max(F.struct("seq", *rest)).alias("r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"r.{c}") for c in log.columns))


def live(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("op") == PUT)


def tombstones(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("op") == DELETE)


def union_layers(*layers: DataFrame) -> DataFrame:
    """Layers and the recent log as one changelog; seq decides, so the order of arguments doesn't matter."""
    return reduce(DataFrame.unionByName, layers)


def per_layer(log: DataFrame) -> DataFrame:
    """Each layer as it is stored: one record for a key in a layer."""
    return latest(log, "layer", "key")


def dropped_versions(entries: DataFrame) -> DataFrame:
    """The layer entries that a full compaction leaves out: shadowed versions and tombstones."""
    keep = live(latest(entries)).select("key", "seq")
    return entries.join(keep, ["key", "seq"], "left_anti")
