"""Predicates and views on keys. Keys order by unsigned bytes, as Spark's strings and binaries do."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.errors import InvalidInput


def check_key(key: str | bytes) -> str | bytes:
    if not key:
        raise InvalidInput("keys must not be empty")
    return key


def octets(x: str | bytes | None) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x or b"")


def valid(key: Column) -> Column:
    """Whether a key may be stored: not null and at least one byte."""
    return F.coalesce(F.octet_length(key) > 0, F.lit(False))


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above everything that starts with prefix; None if there is no bound."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def has_prefix(key: Column, prefix: str | bytes) -> Column:
    """key starts with prefix. Text uses startswith and bytes a range, because those are what reach the Parquet scan."""
    if isinstance(prefix, str):
        return key.startswith(prefix) if prefix else F.lit(True)
    if not prefix:
        return F.lit(True)
    low, high = F.lit(prefix), successor(prefix)
    return (key >= low) & (key < F.lit(high)) if high else key >= low


def text_view(raw: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def keyspace(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def heap_bytes(key: Column, value: Column) -> Column:
    """What a record counts in the MemTable: key, value (none for a tombstone) and one byte."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 1
