"""Bloom filters over the keys of a layer, as rows of (layer, byte_no, bits)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.errors import CorruptLayer
from stratalog.functions.hashing import HASHES, LEAST_BITS, bloom_indices, bloom_length


def lengths(entries: DataFrame) -> DataFrame:
    return entries.groupBy("layer").agg(bloom_length(F.count("*")).alias("bit_len"))


def _bits(sized: DataFrame) -> DataFrame:
    at = sized.select("layer", "key", "bit_len", bloom_indices(sized.sparkSession, F.col("key"), F.col("bit_len")).alias("at"))
    return at.select("layer", "key", "bit_len", F.explode("at").alias("bit"))


def indices(entries: DataFrame) -> DataFrame:
    """(layer, key, bit_len, bit) with a row for each of the hashes of each key."""
    return _bits(entries.select("layer", "key").join(lengths(entries), "layer"))


def build(entries: DataFrame) -> DataFrame:
    """The filter's bytes that have a bit set: byte bit div 8, least significant bit first."""
    bit = F.col("bit")
    return indices(entries).groupBy("layer", "bit_len", F.expr("bit div 8").alias("byte_no")).agg(F.bit_or(F.expr("cast(shiftleft(1, cast(bit % 8 as int)) as bigint)")).alias("bits"))


def probe(filters: DataFrame, asked: DataFrame) -> DataFrame:
    """(layer, key, maybe) for the (layer, key) pairs asked; `filters` is what build() gives."""
    bits = _bits(asked.select("layer", "key").distinct().join(filters.select("layer", "bit_len").distinct(), "layer")).withColumn("byte_no", F.expr("bit div 8"))
    seen = bits.join(filters.select("layer", "byte_no", "bits"), ["layer", "byte_no"], "left")
    hit = F.coalesce(F.expr("bits & cast(shiftleft(1, cast(bit % 8 as int)) as bigint)"), F.lit(0)) != 0
    return seen.groupBy("layer", "key").agg(F.every(hit).alias("maybe"))


def serialise(filters: DataFrame) -> DataFrame:
    """(layer, bit_len, hashes, data): the filter as one binary a layer. A filter is 10 bits a key, so this is for layers whose filter fits a row."""
    pairs = filters.groupBy("layer", "bit_len").agg(F.map_from_entries(F.collect_list(F.struct("byte_no", "bits"))).alias("m"))
    octets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("bit_len") / 8) - 1), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))), 2, "0"))
    return pairs.select("layer", "bit_len", F.lit(HASHES).alias("hashes"), F.unhex(F.array_join(octets, "")).alias("data"))


def parse(bit_len: int, hashes: int, data: bytes) -> list[int]:
    """The set bit positions of a serialised filter, or CorruptLayer."""
    if bit_len < 1 or hashes < 1 or len(data) != -(-bit_len // 8):
        raise CorruptLayer(f"a Bloom filter of {bit_len} bits and {hashes} hashes can't have {len(data)} bytes")
    return [8 * k + b for k, octet in enumerate(data) for b in range(8) if octet >> b & 1]


__all__ = ["LEAST_BITS", "build", "indices", "lengths", "parse", "probe", "serialise"]
