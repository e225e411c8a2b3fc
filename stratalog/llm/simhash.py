"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints only find candidates where a similarity is asked for: pairs are then linked by the exact Jaccard similarity of their sets of shingles. The 64 bits are dealt into m groups with correlated bits together. If group thresholds t_i (from -1) add up to k - m + 1, then two fingerprints that differ in k bits or fewer differ in at most t_i bits of some group i. Each group is probed with all values within its own threshold, and what shares a value is verified on all 64 bits. m and the thresholds come from a dynamic programme over estimated numbers of probes and candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.graph import components, split_join
from stratalog.llm.scratch import Scratch

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
#: A probed value costs a shuffled row, a candidate one comparison within a join.
PROBE_COST = 20
GROUP_COUNTS = (2, 3, 4, 5)


def shingle_hashes(raw: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included. A-Z count as a-z; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number; a text without words has 0."""
    hashes = shingle_hashes(raw, shingle)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, fp): th is a hash of the text that tells rows of one key apart."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = [fingerprint(x.as_py(), shingle) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["k", "th", "fp"])

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, th long, fp long").withColumnRenamed("k", key)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both: 64 x 64 numbers, added up over all rows by the executors."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            values = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False))
            for k in range(0, len(values), 4096):
                bits = np.unpackbits(values[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel().astype(np.int64)) for x in (i, j, total)], ["i", "j", "n"])

    both = np.zeros((BITS, BITS), np.int64)
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = r["n"]
    return fps.count(), both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size: each starts with the two most correlated bits left and takes the bit most correlated with it until full."""
    p = both.diagonal() / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, -1)
    left, groups = list(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        sub = corr[np.ix_(left, left)]
        own = [left[k] for k in np.unravel_index(int(sub.argmax()), sub.shape)]
        left = [b for b in left if b not in own]
        while len(own) < size:
            best = max(left, key=lambda b: corr[b, own].sum())
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def within(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two random fingerprints differ in at most 0..most of the bits, where bit i is set with chance p[i]."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """costs[i][t + 1] for t = -1, 0, ...; the thresholds that add up to total at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, more in enumerate(row, -1):
                if s + t not in step or c + more < step[s + t][0]:
                    step[s + t] = (c + more, [*ts, t])
        best = step
    return best[total][1]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _costs(n: int, widths: list[int], exact: list[float], ratio: list[np.ndarray], k: int) -> list[list[float]]:
    n = max(1, n)  # so that probes cost something for an empty table too, and few are taken
    return [[0.0, *(n * sum(comb(w, x) for x in range(t + 1)) * PROBE_COST + same * r[t] for t in range(k + 1))] for w, same, r in zip(widths, exact, ratio, strict=True)]


def plan(fps: DataFrame, k: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) for each group. Bit statistics and value counts are taken over all fingerprints."""
    n, both = bit_counts(fps)
    p = both.diagonal() / max(1, n)

    def ratios(groups):
        w = [within(p[g], k) for g in groups]
        return [x / max(x[0], 1e-18) for x in w], [n * n * x[0] / 2 for x in w]

    def price(m: int) -> float:
        groups = group_bits(n, both, m)
        r, same = ratios(groups)
        costs = _costs(n, list(map(len, groups)), same, r, k)
        return sum(row[t + 1] for row, t in zip(costs, allocate(costs, k - m + 1), strict=True))

    groups = group_bits(n, both, min((m for m in GROUP_COUNTS if m <= k + 1), key=price))
    values = fps.select(F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_mask(g))) for g in groups))).alias("i", "v"))
    pairs = values.groupBy("i", "v").agg(F.count("*").cast("double").alias("c")).groupBy("i").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    same = {r["i"]: r["pairs"] for r in pairs}
    r, _ = ratios(groups)
    costs = _costs(n, list(map(len, groups)), [same.get(i, 0.0) for i in range(len(groups))], r, k)
    return list(zip(groups, allocate(costs, k - len(groups) + 1), strict=True))


def _flips(bits: list[int], t: int) -> list[int]:
    """Masks that flip at most t of the bits."""
    out = [[]]
    for _ in range(t):
        out += [[*f, b] for f in out for b in bits if not f or b > f[-1]]
    return sorted({_mask(f) for f in out})


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _centres(members: DataFrame, voted: bool) -> DataFrame:
    """(i, v, centre, fc) of each group value that several nodes have: the node of most rows, or, if voted, that nearest to the fingerprint whose bits most of them have, which near copies of one text have in common with it."""
    if not voted:
        best = members.groupBy("i", "v").agg(F.max(F.struct("n", "id", "fp")).alias("c"), F.count("*").alias("size"))
        return best.where("size > 1").select("i", "v", F.col("c.id").alias("centre"), F.col("c.fp").alias("fc"))
    votes = members.groupBy("i", "v").agg(F.count("*").alias("size"), *(F.sum(F.expr(f"shiftright(fp, {b}) & 1L")).alias(f"b{b}") for b in range(BITS))).where("size > 1")
    common = reduce(Column.bitwiseOR, (F.when(2 * F.col(f"b{b}") > F.col("size"), F.lit(_mask([b])).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for b in range(BITS)))
    near = split_join(members, votes.select("i", "v", common.alias("common")), ["i", "v"])
    best = near.groupBy("i", "v").agg(F.min(F.struct(_differ("fp", "common").alias("d"), "id", "fp")).alias("c"))
    return best.select("i", "v", F.col("c.id").alias("centre"), F.col("c.fp").alias("fc"))


def link(nodes: DataFrame, scratch: Scratch, k: int = DISTANCE, confirm: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, fp, n) of different ids to (id, root): the least id reached over links, for each id. A link is two fingerprints of k bits or fewer between them and, with `confirm`, that this keeps their row of (a, b, la, lb).

    First every group value's nodes link to its centre: a dense cluster then is one component by few edges. The full probe and verification follow for pairs of different components only, so that no cluster's pairs are all written out.
    """
    groups = plan(nodes, k)
    keyed = lambda df, extra: _union([df.select(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v"), *extra) for i, (g, _) in enumerate(groups)])
    members = scratch.save(keyed(nodes, ["id", "fp", "n"]), "members")
    star = split_join(members, _centres(members, confirm is not None), ["i", "v"]).where((F.col("id") != F.col("centre")) & (_differ("fp", "fc") <= k))
    star = star.select(F.col("id").alias("a"), F.col("centre").alias("b"), F.col("id").alias("la"), F.col("centre").alias("lb")).distinct()
    first = components((confirm(star) if confirm else star).select("a", "b"), scratch)
    labelled = scratch.save(split_join(nodes.select("id", "fp"), first.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id")).select("id", "fp", "label"), "labels")

    used = [(i, g, t) for i, (g, t) in enumerate(groups) if t >= 0]
    stored = _union([labelled.select(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v"), F.col("id").alias("a"), F.col("fp").alias("x"), F.col("label").alias("la")) for i, g, _ in used])
    flips = lambda g, t: F.explode(F.array(*(F.lit(f).cast("bigint") for f in _flips(g, t))))
    probes = _union([labelled.select(F.lit(i).alias("i"), "id", "fp", "label", F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("own"), flips(g, t).alias("flip")).select("i", F.col("own").bitwiseXOR(F.col("flip")).alias("v"), F.col("id").alias("b"), F.col("fp").alias("y"), F.col("label").alias("lb")) for i, g, t in used])
    same = (stored["i"] == probes["i"]) & (stored["v"] == probes["v"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (_differ("x", "y") <= k)
    # a pair comes from the first group that finds it and from no other, so it comes once
    found = [F.bit_count(F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit(_mask(g)))) <= t for _, g, t in used]
    for j in range(1, len(used)):
        same &= ~((stored["i"] == used[j][0]) & reduce(Column.__or__, found[:j]))
    across = stored.join(probes, same)
    across = confirm(across.select("a", "b", "la", "lb")) if confirm else across
    second = components(across.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), scratch).select(F.col("node").alias("label"), "root")
    return split_join(labelled, second, "label", "left").select("id", F.coalesce("root", "label").alias("root"))


def _similar(docs: DataFrame, scratch: Scratch, shingle: int, similarity: float, text: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps pairs (a, b, ...) of text hashes whose sets of shingles have that Jaccard similarity. Sets are made for the texts of the pairs only."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([np.unique(shingle_hashes(b.column(1)[k].as_py(), shingle)).view(np.int64)], pa.list_(pa.int64()))], ["th", "s"])

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs, "pairs")
        # written, so that its size is known before the texts are dealt out: below Spark's broadcast threshold they stay where they are
        wanted = scratch.save(pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct(), "wanted")
        texts = split_join(docs.select(F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t")), wanted, "th", "left_semi").dropDuplicates(["th"])
        sets = scratch.save(texts.mapInArrow(run, "th long, s array<long>"), "sets")
        for end in ("a", "b"):
            pairs = split_join(pairs, sets.select(F.col("th").alias(end), F.col("s").alias(f"s{end}")), end)
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.where(both >= similarity * (F.size("sa") + F.size("sb") - both)).drop("sa", "sb")

    return confirm


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = DISTANCE, shingle: int = SHINGLE, similarity: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, fp, root, component_id, rep) for every row: component_id is the least key reached, rep the (null, key, th) of the one row that stands for the component.

    Fingerprints of at most k bits between them are linked, or, with a similarity, those of them whose sets of shingles have at least that Jaccard similarity. Null and empty texts and texts without words have fingerprint 0 and no shingles; they link with each other, and by fingerprint with any other. Equal fingerprints (with a similarity: equal texts) are one node with a count, so groups of copies cost one row each. Rows with a null key never give a component its id unless it has no other. Repeated rows give repeated results. An empty table gives no rows. Other columns aren't read.
    """
    rows = scratch.save(fingerprints(docs, shingle, key, text), "fingerprints")
    mine = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("th").alias("th"))
    ident = "fp" if similarity is None else "th"
    nodes = scratch.save(rows.groupBy(F.col(ident).alias("id")).agg(F.min("fp").alias("fp"), F.count("*").alias("n"), F.min(mine).alias("head")), "nodes")
    roots = link(nodes.select("id", "fp", "n"), scratch, k, None if similarity is None else _similar(docs, scratch, shingle, similarity, text))
    rooted = scratch.save(split_join(nodes.select("id", "head"), roots, "id"), "roots")
    reps = rooted.groupBy("root").agg(F.min("head").alias("rep"))
    rooted = split_join(rooted.select(F.col("id").alias(ident), "root"), reps, "root")
    return split_join(rows, rooted, ident).withColumn("component_id", F.col("rep.key"))


def keep_one(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each near-duplicate group of near_duplicates(): that of the least key (null keys last), then of the least text hash, then of the least hash of all columns; of equal rows one. All columns stay, whatever their names. An empty table gives no rows."""
    found = near_duplicates(docs, scratch, key=key, text=text, **how)
    reps = found.select(F.xxhash64("rep.key").alias("_kh"), F.col("rep.th").alias("_th")).distinct()
    both = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("_all"), F.xxhash64(key).alias("_kh"), F.xxhash64(text).alias("_th"))
    # the rows of a key and text become one first, in part before the shuffle, and the join then finds them dealt out by its keys
    return both.groupBy("_kh", "_th").agg(F.min_by("row", "_all").alias("row")).join(reps, ["_kh", "_th"], "left_semi").select("row.*")
