"""Unsigned 64-bit FNV-1a and the bit positions of a Bloom filter, for whole Arrow columns at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.sources.workspace import ship_package

# Fixed values of the Bloom filter: bits a key, hashes, least size, the two seeds and the FNV prime.
BITS_PER_KEY = 10
HASHES = 7
LEAST_BITS = 64
SEED_1 = 0xCBF29CE484222325
SEED_2 = 0x9E3779B97F4A7C15
PRIME = 0x100000001B3


def fnv64(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The FNV-1a folds of a binary column from both seeds; nulls count as empty. Keys stand by falling length, so that each step folds a byte of all keys that have one."""
    keys = keys.cast(pa.large_binary())
    lengths = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, 8 * keys.offset) if len(keys) else np.zeros(1, np.int64)
    starts, lengths = lengths[:-1], np.diff(lengths)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    start, remaining = starts[order], len(keys) - np.cumsum(np.bincount(lengths, minlength=1))  # keys longer than 0, 1, ...
    a, b = (np.full(len(keys), seed, np.uint64) for seed in (SEED_1, SEED_2))
    prime = np.uint64(PRIME)
    for place, n in enumerate(remaining[:-1].tolist()):
        octet = data[start[:n] + place].astype(np.uint64)
        for h in (a, b):
            h[:n] = (h[:n] ^ octet) * prime
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return a[out], b[out]


def positions(keys: pa.Array, lengths: pa.Array) -> np.ndarray:
    """(keys, hashes): (h1 + i * h2) mod 2^64 mod length, exact for filters of any length up to 2^63."""
    h1, h2 = fnv64(keys)
    bits = lengths.to_numpy(zero_copy_only=False).astype(np.uint64)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((h1[:, None] + steps * (h2 | np.uint64(1))[:, None]) % bits[:, None]).astype(np.int64)


def bloom_length(n: Column) -> Column:
    return F.greatest(F.lit(LEAST_BITS).cast("bigint"), n.cast("bigint") * BITS_PER_KEY)


def bloom_indices(spark, key: Column, length: Column) -> Column:
    """The array of bit positions of a key in a filter of `length` bits."""
    ship_package(spark)

    @F.arrow_udf("array<bigint>")
    def run(keys: pa.Array, lengths: pa.Array) -> pa.Array:
        flat = positions(keys, lengths)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, HASHES, dtype=np.int32)), pa.array(flat.ravel()))

    return run(key.cast("binary"), length)
