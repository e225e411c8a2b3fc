"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. Built-in functions only.

Each shard stands on the ring at `vnodes` points. A row belongs to the shard of the next point clockwise of its key's hash; a shard is full at its capacity, and the keys that a full shard can't take continue clockwise to the next shard that has room. Capacities are the row count dealt out to within one row, so loads are bounded at once from above and from below: every shard ends full.
"""

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.ranks import ranked
from stratalog.llm.scratch import Scratch

RING_BITS = 62
CELL_BITS = 12


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) in ring order. A shard's points don't depend on how many shards there are."""
    point = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big") >> (64 - RING_BITS)
    return sorted((point(s, v), s) for s in range(shards) for v in range(vnodes))


def clockwise(points: list[tuple[int, int]], arc: int) -> list[int]:
    """The shards met from an arc's end on, each once."""
    return list(dict.fromkeys(points[(arc + k) % len(points)][1] for k in range(len(points))))


def fill(counts: dict[int, int], points: list[tuple[int, int]], capacity: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each arc its (shard, rows) in the order of the arc's ranks. First all arcs give to their own shard, in ring order; then what overflows goes on clockwise."""
    room, plan, over = list(capacity), {}, {}
    for arc in sorted(counts):
        home = points[arc][1]
        take = min(counts[arc], room[home])
        room[home] -= take
        plan[arc], over[arc] = [(home, take)] if take else [], counts[arc] - take
    for arc, left in over.items():
        for shard in clockwise(points, arc) if left else ():
            take = min(left, room[shard])
            if take:
                room[shard] -= take
                left -= take
                plan[arc].append((shard, take))
    return plan


def arc_of(key_hash: Column, points: list[tuple[int, int]]) -> Column:
    """The index of the first point at or after the hash, by a table of equal cells and the few points within one."""
    shift = RING_BITS - CELL_BITS
    cells: list[list[int]] = [[] for _ in range(1 << CELL_BITS)]
    for p, _ in points:
        cells[p >> shift].append(p)
    bases, seen = [], 0
    for c in cells:
        bases.append(seen)
        seen += len(c)
    at = F.shiftright(key_hash, shift).cast("int")
    inside = F.size(F.filter(F.get(_literal(cells, "array<array<bigint>>"), at), lambda p: p < key_hash))
    return ((F.get(_literal(bases, "array<int>"), at) + inside) % len(points)).cast("int")


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def shard(docs: DataFrame, scratch: Scratch, shards: int = 8, vnodes: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row, by the law `rows`: shard sizes differ by one row at most.

    size is the text's UTF-8 bytes plus 1. Null texts count as empty; null keys share one ring point, and overflow like any hot key; repeated rows each get a slot of their own. An empty table gives no rows. Columns other than key and text aren't read. Only row counts by arc (shards * vnodes numbers) come to the driver.
    """
    points = ring(shards, vnodes)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("crc"))
    rows = rows.withColumn("arc", arc_of(F.shiftrightunsigned(F.xxhash64("k"), 64 - RING_BITS), points)).withColumn("h", F.xxhash64("k", "crc", "size"))
    rows = ranked(scratch.save(rows, "keys"), "arc", ["h", "k", "crc", "size"], scratch)
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}
    n = sum(counts.values())
    plan = fill(counts, points, [n // shards + (s < n % shards) for s in range(shards)])
    used, pieces = [0] * shards, [[] for _ in points]
    for arc in sorted(plan):
        start = 0
        for s, take in plan[arc]:
            pieces[arc].append([start + take, s, used[s] - start])  # ranks below the first number go to shard s, at rank plus the third
            start, used[s] = start + take, used[s] + take
    mine = F.get(_literal(pieces, "array<array<array<bigint>>>"), F.col("arc"))
    hit = F.get(F.filter(mine, lambda p: F.col("rank") < F.get(p, F.lit(0))), F.lit(0))
    rows = rows.withColumn("hit", hit)
    return rows.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.get("hit", F.lit(1)).cast("int").alias("shard"), (F.col("rank") + F.get("hit", F.lit(2))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
