"""Point lookups, ordered prefix scans and the raw views of the MemTable and of single layers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.errors import InvalidInput
from stratalog.functions.keys import check_key, has_prefix
from stratalog.operators.merge import latest, live, per_layer
from stratalog.schema import PUT

# The default limit of the command line and of HTTP, and the most rows HTTP gives.
DEFAULT_LIMIT, HTTP_CAP = 100, 500


def rows_wanted(limit: int | None, surface: str = "engine") -> int | None:
    """How many rows a surface gives for a requested limit; None is unlimited."""
    if limit is not None and limit < 0:
        raise InvalidInput("limit must not be negative")
    if surface == "rpc":
        return limit or None
    if surface == "http":
        return min(DEFAULT_LIMIT if limit is None else limit, HTTP_CAP)
    if surface == "cli":
        return DEFAULT_LIMIT if limit is None else limit
    if surface == "engine":
        return limit
    raise InvalidInput(f"unknown surface {surface!r}")


def get(log: DataFrame, key: str | bytes) -> DataFrame:
    """One row (key, found, value). The key filter is below the merge, so it reaches the scan."""
    return lookup(log.where(F.col("key") == F.lit(check_key(key))), F.lit(key))


def lookup(versions: DataFrame, key: Column) -> DataFrame:
    """get() over the versions of one key already filtered. No version at all still gives the row found = false."""
    newest = versions.agg(F.max(F.struct("seq", "op", "value")).alias("r"))
    found = F.coalesce(F.col("r.op") == PUT, F.lit(False))
    return newest.select(key.alias("key"), found.alias("found"), F.when(found, F.col("r.value")).alias("value"))


def scan(log: DataFrame, prefix: str | bytes = "", limit: int | None = None, surface: str = "engine") -> DataFrame:
    """(key, value) of live keys that start with prefix, in key order; the limit counts live rows only."""
    out = live(latest(log.where(has_prefix(F.col("key"), prefix)))).select("key", "value").orderBy("key")
    n = rows_wanted(limit, surface)
    return out if n is None else out.limit(n)


def lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("=", "key", "value").alias("line"))


def memtable(log: DataFrame, flushed: Column) -> DataFrame:
    """The newest records above the flushed layers, tombstones included."""
    return latest(log.where(F.col("layer") > flushed))


def raw_scan(records: DataFrame, prefix: str | bytes, limit: int | None = None) -> DataFrame:
    """A scan of one MemTable or layer: tombstones are returned and count towards the limit."""
    out = records.where(has_prefix(F.col("key"), prefix)).orderBy("key")
    return out if limit is None else out.limit(limit)


def iterate(records: DataFrame, descending: bool = False) -> DataFrame:
    """All records of a MemTable or layer in key order, from either end."""
    return records.orderBy(F.desc("key") if descending else "key")


def layer(log: DataFrame, number: int) -> DataFrame:
    return per_layer(log.where(F.col("layer") == number))


def layer_get(log: DataFrame, number: int, key: str | bytes) -> DataFrame:
    return layer(log.where(F.col("key") == F.lit(check_key(key))), number)
