"""Near-duplicate vectors by an inverted multi-index over two halves.

Each half of the dimensions has its own codebook; a vector's cell is the pair of its nearest codewords. For a query, every codeword of a half has a distance: how far the query must at least move before that codeword is its nearest, which is its distance from the plane between that codeword and its own. A link's ends differ by at most r = sqrt(2 - 2 cos), so its two distances' squares add up to at most r^2. The multi-sequence traversal takes cells in the order of that sum and stops beyond r^2 times `reach`. At 1 every link is in a visited cell, but most cells are visited. So reach is measured: blocks of queries are compared with all rows until enough of them are linked, and the traversal goes as far as its target recall of their links needs, times a margin. Where links are too rare to measure that, reach is 1, and cells are as large as a block. What shares a cell is verified in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.graph import components, split_join
from stratalog.llm.scratch import Scratch

COSINE = 0.9
#: Bounds of the codebooks: vectors they are fitted on (by least hash) and codewords a half, enough for 16 vectors a cell of 268 million.
SAMPLE, CODEWORDS = 20_000, 4096
PER_CELL = 16
#: Queries compared with all rows at once to measure reach, the share of links that it must find, what it is multiplied by then, and its least value.
QUERIES, TARGET, MARGIN, LEAST_REACH = 1000, 0.995, 4, 0.025
#: Linked queries without which nothing is measured (of fewer, one would be more than what the target leaves out), and most blocks of queries.
LINKED, QUERY_BLOCKS = 200, 10
BINS = 1000
ROUNDS = 8
#: Vectors of a cell, and queries that visit it, in one block.
INDEX_BLOCK, QUERY_BLOCK = 512, 1024


def kmeans(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty codeword keeps its place."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([((c**2).sum(1) - 2 * x[k : k + 2048] @ c.T).argmin(1) for k in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def margins(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and each codeword's squared distance in the sense above."""
    d = ((x**2).sum(1)[:, None] - 2 * x @ c.T) + (c**2).sum(1)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(((c[own] ** 2).sum(1)[:, None] - 2 * c[own] @ c.T) + (c**2).sum(1), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        h = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart)
    return own, np.where(apart > 1e-9, np.maximum(h, 0), 0) ** 2


def multi_sequence(first: list[float], second: list[float], stop: float) -> Iterator[tuple[int, int]]:
    """Index pairs of two ascending lists in the order of their sums, as long as those are at most stop."""
    if not first or not second or first[0] + second[0] > stop:
        return
    heap, seen = [(first[0] + second[0], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield i, j
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(first) and b < len(second) and (a, b) not in seen and first[a] + second[b] <= stop:
                seen.add((a, b))
                heapq.heappush(heap, (first[a] + second[b], a, b))


def visited(h1: np.ndarray, h2: np.ndarray, stop: float) -> list[list[int]]:
    """The cells (i * codewords + j) that each row visits, nearest first."""
    out = []
    for a, b in zip(h1, h2, strict=True):
        i, j = np.flatnonzero(a <= stop), np.flatnonzero(b <= stop)
        i, j = i[np.argsort(a[i], kind="stable")], j[np.argsort(b[j], kind="stable")]
        out.append([int(i[x]) * len(b) + int(j[y]) for x, y in multi_sequence(a[i].tolist(), b[j].tolist(), stop)])
    return out


def _matrix(column, dim: int) -> np.ndarray:
    """Unit rows in double precision of an Arrow list column."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares can't overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _link_bins(classes: DataFrame, books: tuple[np.ndarray, np.ndarray], dim: int, cosine: float, cids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of the queries x (of class ids cids) that has links, how many of them each bin of reach finds."""
    half, limit = dim // 2, 2 - 2 * cosine
    h1, h2 = margins(x[:, :half], books[0])[1], margins(x[:, half:], books[1])[1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                y, own = _matrix(part.column(1), dim), part.column(0).to_numpy()
                q, r = np.nonzero((x @ y.T >= cosine) & (cids[:, None] != own[None, :]))
                i, j = margins(y[r, :half], books[0])[0], margins(y[r, half:], books[1])[0]
                bins = np.minimum(BINS, np.ceil((h1[q, i] + h2[q, j]) / limit * BINS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(bins)], ["q", "bin"])

    seen = np.zeros((len(x), BINS + 1))
    for r in classes.select("cid", "v").mapInArrow(run, "q long, bin long").groupBy("q", "bin").count().collect():
        seen[r["q"], r["bin"]] += r["count"]
    return seen[seen.sum(1) > 0]


def measured_reach(classes: DataFrame, books: tuple[np.ndarray, np.ndarray], dim: int, cosine: float, cids: np.ndarray, x: np.ndarray) -> float:
    """The reach at which the queries x (of class ids cids), taken in blocks until enough are linked, find the target share of their links, as a mean over queries and over links, with its margin. 1 if too few are linked."""
    seen = np.zeros((0, BINS + 1))
    for at in range(0, min(len(x), QUERIES * QUERY_BLOCKS), QUERIES):
        seen = np.concatenate((seen, _link_bins(classes, books, dim, cosine, cids[at : at + QUERIES], x[at : at + QUERIES])))
        if len(seen) >= LINKED:
            break
    else:
        return 1.0
    seen = seen.cumsum(axis=1)
    enough = np.minimum((seen / seen[:, -1:]).mean(axis=0), seen.sum(axis=0) / seen[:, -1].sum()) >= TARGET
    return float(min(1.0, max(LEAST_REACH, MARGIN * enough.argmax() / BINS)))


def _cells(classes: DataFrame, books: tuple[np.ndarray, np.ndarray], dim: int, stop: float) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = _matrix(part.column(1), dim)
                (o1, h1), (o2, h2) = (margins(v, c) for v, c in zip((x[:, : dim // 2], x[:, dim // 2 :]), books, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(o1 * len(books[1]) + o2, pa.int64()), pa.array(visited(h1, h2, stop), pa.list_(pa.int64()))], ["cid", "v", "n", "cell", "visits"])

    return classes.select("cid", "v", "n").mapInArrow(run, f"cid long, v {dict(classes.dtypes)['v']}, n long, cell long, visits array<long>")


def _verify(blocks: DataFrame, books: tuple[np.ndarray, np.ndarray], dim: int, cosine: float, stop: float) -> DataFrame:
    """Blocks of (q, cid, v, n, own), q true for queries and own the vector's cell, to (cid, links, root): rows linked to, counted with their copies, and a member of the cid's component within the block. One row a linked vector, not one a pair. The known end of a link counts it here if its own visits don't reach the query's cell, and in that cell's block otherwise."""
    half = dim // 2

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        def side(q):
            t = table.filter(pc.equal(table["q"], q)).combine_chunks()
            return (t["cid"].to_numpy(), _matrix(t["v"].combine_chunks(), dim), t["n"].to_numpy(), t["own"].to_numpy()) if t.num_rows else None

        ask, known = side(True), side(False)
        if not ask or not known:
            return pa.table({k: pa.array([], pa.int64()) for k in ("cid", "links", "root")})
        hit = (ask[1] @ known[1].T >= cosine) & (ask[0][:, None] != known[0][None, :])
        rows, cols = hit.any(1), hit.any(0)
        m, a, b = hit[rows][:, cols], ask[0][rows], known[0][cols]
        la, lb, before = a.copy(), b.copy(), None
        far = np.iinfo(np.int64).max
        while len(a) and (before is None or before != (la.sum(), lb.sum())):
            before = (la.sum(), lb.sum())
            la = np.minimum(la, np.where(m, lb[None, :], far).min(1))
            lb = np.minimum(lb, np.where(m, la[:, None], far).min(0))
        links, back = a, b
        if len(a):
            i, j = np.divmod(ask[3][rows], len(books[1]))
            h1, h2 = margins(known[1][cols, :half], books[0])[1], margins(known[1][cols, half:], books[1])[1]
            links = m.astype(np.int64) @ known[2][cols]
            back = (m.T & (h1[:, i] + h2[:, j] > stop)).astype(np.int64) @ ask[2][rows]
        return pa.table({"cid": np.concatenate((a, b)), "links": np.concatenate((links, back)), "root": np.concatenate((la, lb))})

    return blocks.groupBy("cell", "bi", "bq").applyInArrow(run, "cid long, links long, root long")


def near_vectors(rows: DataFrame, scratch: Scratch, cosine: float = COSINE, reach: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different lengths not with each other: each length has an index of its own, so the lengths come to the driver. Equal vectors are one class with a count: they link with each other and share their links, at the cost of one. component_id is the least key reachable; null keys give it only where there is no other. Repeated rows count as vectors of their own. An empty table gives no rows. Other columns aren't read.

    Cells of many vectors or many visitors are split into blocks, of which each pair of a vector's and a visitor's meets once, so no task holds a whole cell.
    """
    v = F.col(vector)
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.select(F.col(key).alias("k"), F.when(good, v).alias("v"))
    lone = rows.where("v IS NULL").select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    lengths = [r["d"] for r in rows.where("v IS NOT NULL").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()]
    found = [_near_of_length(rows.where((F.col("v").isNotNull()) & (F.size("v") == d)), d, scratch, cosine, reach, key) for d in lengths]
    return reduce(DataFrame.unionByName, found, lone)


def _near_of_length(linked: DataFrame, dim: int, scratch: Scratch, cosine: float, reach: float | None, key: str) -> DataFrame:
    """near_vectors() for rows (k, v) of sound vectors of one length."""
    if dim < 2:  # without two halves there is only the sign
        linked = linked.withColumn("v", F.concat("v", F.array(F.lit(0.0).cast(linked.schema["v"].dataType.elementType))))
        dim = 2
    classes = scratch.save(linked.groupBy("v").agg(F.count("*").alias("n"), F.min("k").alias("head")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    sample = classes.select("cid", "v").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toArrow()
    x = _matrix(sample["v"].combine_chunks(), dim)
    n = classes.count()

    def codebooks(per_cell):
        k = int(min(CODEWORDS, max(4, np.ceil(np.sqrt(n / per_cell))), len(x)))
        return kmeans(x[:, : dim // 2], k), kmeans(x[:, dim // 2 :], k)

    books = codebooks(PER_CELL)
    if reach is None:
        reach = measured_reach(classes, books, dim, cosine, sample["cid"].to_numpy(), x)
    if reach >= 1:  # most cells are visited, so small ones would only multiply the rows
        books = codebooks(INDEX_BLOCK)
    stop = (2 - 2 * cosine) * reach + 1e-9
    placed = scratch.save(_cells(classes, books, dim, stop), "cells")

    visits = placed.select("cid", "v", "n", F.col("cell").alias("own"), F.explode("visits").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("ni")).join(placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("nq")), "cell")
    sizes = scratch.save(sizes.select("cell", F.ceil(F.col("ni") / INDEX_BLOCK).cast("int").alias("ci"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("cq")), "sizes")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    known = split_join(placed.select("cid", "v", "n", "cell"), sizes, "cell").select("cell", part("ci").alias("bi"), upto("cq").alias("bq"), F.lit(False).alias("q"), "cid", "v", "n", F.col("cell").alias("own"))
    asked = split_join(visits, sizes, "cell").select("cell", upto("ci").alias("bi"), part("cq").alias("bq"), F.lit(True).alias("q"), "cid", "v", "n", "own")
    found = scratch.save(_verify(known.unionByName(asked), books, dim, cosine, stop), "found")

    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch).select(F.col("node").alias("cid"), "root")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    whole = classes.select("cid", "v", "n", "head").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    whole = scratch.save(whole, "whole")
    least = whole.groupBy("root").agg(F.min("head").alias("component_id"))
    whole = split_join(whole, least, "root").select(F.xxhash64("v").alias("h"), F.col("v").alias("w"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    twin = F.pmod(F.hash("h"), F.lit(1 << 20))
    out = linked.withColumn("h", F.xxhash64("v")).withColumn("t", twin).join(whole.withColumn("t", twin), ["h", "t"]).where(F.col("v") == F.col("w"))
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
