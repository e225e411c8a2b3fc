"""Substring deduplication by prefix-partitioned suffix trees.

A window is `window` consecutive words, and a repeat is a run of words of at least that length that several documents have. Suffixes that can't be in one are sorted out first: every window has an anchor, the least hash of the short word runs (grams) in it, so equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs. A stretch is the windows of one anchor, and only stretches whose anchor stands in two documents go on. Equal stretches are one leaf with its least document, at which all others have a repeat, so copies of any number cost one row in a tree.

What is left are leaves of one anchor with different words around it. The anchor's gram is the prefix by which their suffixes are dealt out; each group's suffix array, its common prefixes word by word and its internal nodes are built in memory, and the nodes at least a window deep are the repeats: a node's least document keeps its copy. A prefix of too many leaves is made longer on both sides: a leaf is cut into pieces, of the windows that have the gram at 0 to 15 words from their start, at 16 to 31, and so on, so that all windows of a piece share more words around the gram, by which the pieces are dealt out. Equal pieces are one again, and the pieces of a prefix that still has too many are halved, down to single windows, which are equal where their prefixes are.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.graph import split_join
from stratalog.llm.scratch import Scratch

WINDOW = 50
GRAM = 8
#: Leaves of a group and of one anchor; windows of pieces of a group and of one prefix before it grows longer.
LEAVES, ANCHOR = 1_000, 500
GROUP, PREFIX = 20_000, 5_000

_B = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i below n at least."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, b in enumerate((_B, pow(_B, -1, 1 << 64))):
            _powers[k] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))))
    return _powers[0], _powers[1]


class Words:
    """Hashes of a text's words and of any stretch of them."""

    def __init__(self, raw: bytes | None):
        from xxhash import xxh64_intdigest

        words = raw.split() if raw else []
        self.n = len(words)
        self._sum(np.fromiter(map(xxh64_intdigest, words), np.uint64, self.n))

    @classmethod
    def of(cls, hashes: np.ndarray) -> Words:
        w = cls.__new__(cls)
        w.n = len(hashes)
        w._sum(hashes)
        return w

    def _sum(self, hashes: np.ndarray) -> None:
        self.hash = hashes
        up, self.down = powers(self.n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: self.n])))

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words from start up to end, wherever they stand."""
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def stretches(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, content, start, count) of each stretch of windows with one anchor: count windows from word `start` on."""
    n, w = words.n - window + 1, window - gram + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    at = np.arange(words.n - gram + 1)
    grams = words.stretch(at, at + gram)
    view = np.lib.stride_tricks.sliding_window_view(grams, w)
    least = np.concatenate([view[k : k + 4096].argmin(axis=1) + np.arange(k, min(k + 4096, n)) for k in range(0, n, 4096)])
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.concatenate((start, [n])))
    content = words.stretch(start, start + count + window - 1) + _mix((least[start] - start).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64))
    return grams[least[start]].view(np.int64), content.view(np.int64), start.astype(np.int32), count.astype(np.int32)


def suffix_array(words: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): all suffixes of a row of sequences, each up to the end of its own (ends[i] is that of place i), in the order of their first `depth` words, and how many words each shares with the one before it, up to `depth`. Ranks of 1, 2, 4, ... words are made from pairs of those before."""
    n = len(words)
    at = np.arange(n)
    left = ends - at
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1]  # 0 stands for what is beyond the end

    def beyond(r: np.ndarray, k: int) -> np.ndarray:
        return np.where(left > k, r[np.minimum(at + k, n - 1)], 0)

    while 2 ** len(ranks) <= depth:
        k = 2 ** (len(ranks) - 1)
        ranks.append(np.unique(ranks[-1] * (n + 1) + beyond(ranks[-1], k), return_inverse=True)[1].astype(np.int64) + 1)
    k = depth - 2 ** (len(ranks) - 1)
    whole = ranks[-1] * (n + 1) + beyond(ranks[-1], k) if k else ranks[-1]
    order = np.argsort(whole, kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if j == len(ranks) - 1 else 1):
            step, x, y = 1 << j, a + common, b + common
            fits = (common + step <= depth) & (common + step <= left[a]) & (common + step <= left[b])
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            common += step * (fits & (ranks[j][x] == ranks[j][y]))
    return order, np.concatenate(([0], common))[:n]


def internal_nodes(common: np.ndarray, depth: int = 1) -> list[tuple[int, int, int]]:
    """(depth, first, end) of the tree's internal nodes of at least that depth over the sorted suffixes, deepest first in each place."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for k, d in enumerate([*common.tolist(), 0]):
        first = k - 1
        while stack and stack[-1][0] > d:
            deep, first = stack.pop()
            out.append((deep, first, k))
        if d >= depth and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return out


def least_in_deep_nodes(order: np.ndarray, common: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the least document of its internal nodes of at least that depth, its own if it is in none."""
    out, sorted_docs = doc.copy(), doc[order]
    for _, first, end in internal_nodes(np.minimum(common, depth), depth):  # nodes below one of that depth have no smaller documents
        out[order[first:end]] = sorted_docs[first:end].min()
    return out


def leaf_repeats(leaves: list[np.ndarray], doc: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(leaf, first, count): runs of windows of a leaf that a leaf of a smaller document has too, from a suffix tree over all leaves. A run's words are its maximal repeat within the leaf: count + window - 1 of them."""
    sizes = np.array([len(x) for x in leaves])
    close = np.cumsum(sizes)
    leaf = np.repeat(np.arange(len(leaves)), sizes)
    order, common = suffix_array(np.concatenate(leaves), np.repeat(close, sizes), window)
    least = least_in_deep_nodes(order, common, doc[leaf], window)
    hit = np.flatnonzero(least < doc[leaf])
    if not len(hit):
        return []
    new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (leaf[hit[1:]] != leaf[hit[:-1]])))
    first = hit[new]
    count = np.diff(np.concatenate((np.flatnonzero(new), [len(hit)])))
    return list(zip(leaf[first].tolist(), (first - (close - sizes)[leaf[first]]).tolist(), count.tolist(), strict=True))


def _ranked(keys) -> np.ndarray:
    """Keys of any orderable type as whole numbers in their order."""
    import pyarrow as pa

    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    values = keys.to_numpy(zero_copy_only=False)
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t"))


def _stretch_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[], [], [], []]
                sizes = []
                for t in part.column(2):
                    got = stretches(Words(t.as_py()), window, gram)
                    sizes.append(len(got[0]))
                    for c, g in zip(cols, got, strict=True):
                        c.append(g)
                repeat = np.repeat(np.arange(part.num_rows), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(repeat)), part.column(1).take(pa.array(repeat)), *(pa.array(np.concatenate(c)) for c in cols)], ["doc", "th", "anchor", "content", "start", "count"])

    return docs.where("doc IS NOT NULL").mapInArrow(run, f"doc {dict(docs.dtypes)['doc']}, th long, anchor long, content long, start int, count int")


def _leaf_rows(picked: DataFrame, window: int) -> DataFrame:
    """picked is (doc, th, t, places), places an array of (start, count, anchor, hot); gives each place with the hashes of its words."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                places = b.column(3)[k].values
                words = Words(b.column(2)[k].as_py())
                start, count = (places.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                for at in range(0, len(start), 2048):
                    some = slice(at, at + 2048)
                    hashes = [words.hash[a : a + n + window - 1].view(np.int64) for a, n in zip(start[some].tolist(), count[some].tolist(), strict=True)]
                    same = [b.column(c).take(pa.array([k] * len(hashes))) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, *(places.field(c).slice(at, len(hashes)) for c in (0, 2, 3)), pa.array(hashes, pa.list_(pa.int64()))], ["doc", "th", "start", "anchor", "hot", "words"])

    return picked.mapInArrow(run, f"doc {dict(picked.dtypes)['doc']}, th long, start int, anchor long, hot boolean, words array<long>")


def _piece_rows(leaves: DataFrame, window: int, gram: int, width: int) -> DataFrame:
    """Each leaf, or piece of one, cut by the place of the anchor's gram in its windows: a piece's windows have it at `width` neighbouring places. `prefix` is a hash of the words that such windows have in common, the gram among them."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[], [], [], []]
                words, sizes = [], []
                for start, anchor, raw in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), strict=True):
                    leaf = Words.of(raw.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    n, grams = leaf.n - window + 1, np.arange(leaf.n - gram + 1)
                    place = int(np.argmax(leaf.stretch(grams, grams + gram).view(np.int64) == anchor))  # the first, as in stretches()
                    side = (place - np.arange(n)) // width
                    first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
                    count = np.diff(np.concatenate((first, [n])))
                    low = side[first] * width
                    high = np.minimum(low + width - 1, window - gram)
                    prefix = leaf.stretch(place - low, place - high + window) + _mix(low.astype(np.uint64) + np.uint64(1))
                    content = leaf.stretch(first, first + count + window - 1) + _mix((place - first).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64))
                    for c, g in zip(cols, ((first + start).astype(np.int32), count.astype(np.int32), prefix.view(np.int64), content.view(np.int64)), strict=True):
                        c.append(g)
                    words += [leaf.hash[x : x + y + window - 1].view(np.int64) for x, y in zip(first.tolist(), count.tolist(), strict=True)]
                    sizes.append(len(first))
                same = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(same) for c in (0, 1, 3)), *(pa.array(np.concatenate(c)) for c in cols), pa.array(words, pa.list_(pa.int64()))], ["doc", "th", "anchor", "start", "count", "prefix", "content", "words"])

    return leaves.select("doc", "th", "start", "anchor", "words").mapInArrow(run, f"doc {dict(leaves.dtypes)['doc']}, th long, anchor long, start int, count int, prefix long, content long, words array<long>")


def _trees(leaves: DataFrame, window: int, by: str, buckets: int) -> DataFrame:
    """(doc, th, start, count) of the repeats in groups of whole anchors or prefixes (`by`): one tree a group, as windows of different ones differ."""

    def run(table):
        import pyarrow as pa

        if not table.num_rows:
            return pa.table({"doc": table["doc"], "th": table["th"], "start": table["start"], "count": table["start"]})
        table = table.combine_chunks()
        words, offsets = (x.to_numpy(zero_copy_only=False) for x in (table["words"].chunk(0).values, table["words"].chunk(0).offsets))
        leaves = [words[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        found = leaf_repeats(leaves, _ranked(table["doc"]), window)
        rows = [leaf for leaf, _, _ in found]
        firsts = table["start"].to_numpy()[rows] + np.array([first for _, first, _ in found], np.int32) if found else []
        counts = [count for _, _, count in found]
        got = table.select(["doc", "th"]).take(pa.array(rows, pa.int64()))
        return got.append_column("start", pa.array(firsts, pa.int32())).append_column("count", pa.array(counts, pa.int32()))

    dealt = leaves.select("doc", "th", "start", "words", F.pmod(F.xxhash64(by), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(run, f"doc {dict(leaves.dtypes)['doc']}, th long, start int, count int")


def _piece_trees(leaves: DataFrame, scratch: Scratch, window: int, gram: int, group: int, limit: int) -> DataFrame:
    """(doc, th, start, count) of the repeats of leaves whose anchors have too many of them, from trees of pieces under longer prefixes. Equal windows have equal prefixes at every width, so they stay together."""
    width, found = 1 << max(0, (window - gram + 1).bit_length() - 2), []
    while True:
        cut = scratch.save(_piece_rows(leaves, window, gram, width), "pieces")
        owners = cut.groupBy("prefix", "content").agg(F.min("doc").alias("owner"))
        cut = scratch.save(split_join(cut, owners, ["prefix", "content"]), "pieces")
        found.append(cut.where("doc > owner").select("doc", "th", "start", "count"))
        if width == 1:  # such a prefix is a whole window, so its pieces are equal: no tree is needed
            break
        own = cut.where("doc = owner")
        sizes = own.groupBy("prefix").agg((F.sum("count") > limit).alias("hot"))
        own = scratch.save(split_join(own, sizes, "prefix"), "pieces")
        n = own.where("NOT hot").agg(F.sum("count")).first()[0] or 0
        found.append(_trees(own.where("NOT hot"), window, "prefix", max(1, -(-n // group))))
        leaves, width = own.where("hot"), width // 2
        if leaves.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, leaves: int = LEAVES, anchor: int = ANCHOR, group: int = GROUP, limit: int = PREFIX, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, places): for each document (its key and text hash) the windows that a document of a smaller key has too, as (start, count) runs of window starts. Keys are of any type with an order; null keys, and documents of fewer words than a window, have none. An empty table gives no rows."""
    work, base = Scratch(docs.sparkSession), _rows(docs, key, text)
    found = work.save(_stretch_rows(base, window, gram), "stretches")
    shared = found.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("low < high").select("anchor", (F.col("c0") != F.col("c1")).alias("mixed"))
    near = work.save(split_join(found, shared, "anchor").distinct(), "shared")
    owners = near.groupBy("anchor", "content").agg(F.min("doc").alias("owner"))
    near = work.save(split_join(near, owners, ["anchor", "content"]).select("doc", "th", "anchor", "start", "count", "mixed", "owner"), "owned")

    # a leaf's other documents have it whole from its least one, whose own windows can be in other leaves
    own = near.where("mixed AND doc = owner").select("doc", "th", "anchor", "start", "count")
    sizes = own.groupBy("anchor").agg((F.count("*") > anchor).alias("hot"))
    places = split_join(own, sizes, "anchor").groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct("start", "count", "anchor", "hot"))).alias("places"))
    picked = base.join(places, ["doc", "th"]).dropDuplicates(["doc", "th"]).select("doc", "th", "t", "places")
    rows = work.save(_leaf_rows(picked, window), "leaves")
    n = rows.where("NOT hot").count()
    marks = _trees(rows.where("NOT hot"), window, "anchor", max(1, -(-n // leaves)))
    if not rows.where("hot").isEmpty():
        marks = marks.unionByName(_piece_trees(rows.where("hot"), work, window, gram, group, limit))
    whole = near.where("doc > owner").select("doc", "th", "start", "count")
    out = scratch.save(whole.unionByName(marks).groupBy("doc", "th").agg(F.collect_set(F.struct("start", "count")).alias("places")), "repeats")
    work.delete()
    return out


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the runs."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + counts + window - 1, -1)
    return np.cumsum(step[:n]) > 0


def deduplicate(docs: DataFrame, scratch: Scratch, window: int = WINDOW, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with text less its repeats, and columns n_words, n_removed and kept_sha256.

    A word goes if it lies in a window whose words also start in a document of a smaller key; windows are judged on the input. What stays of a text that loses words is joined by one space; other texts stay as they are. kept_sha256 is that of the kept words joined by one space. Null texts have no words and stay null. Rows of a null key keep all and take nothing from others; rows of one key don't take from each other, so repeated rows end alike. Texts of fewer words than a window have none; texts of any length are taken whole. Keys are of any type with an order. Columns of the new names are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    marks = repeats(docs, scratch, window, key=key, text=text, **how)
    kind = docs.schema[text].dataType.simpleString()
    names = docs.columns
    left = docs.withColumns({text: F.col(text).cast("binary"), "_th": F.xxhash64(text), "_doc": F.col(key)})
    right = marks.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("places").alias("_places"))
    joined = split_join(left, right, ["_doc", "_th"], "left").select(*names, "_places")
    at = names.index(text)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts, sizes, removed, shas = [], [], [], []
                for t, p in zip(part.column(at), part.column(len(names)), strict=True):
                    raw = t.as_py()
                    words = raw.split() if raw else []
                    n = len(words)
                    if p.is_valid and n:
                        first, count = (p.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                        gone = covered(n, first, count, window)
                        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                        raw = b" ".join(words)
                        shas.append(hashlib.sha256(raw).hexdigest())
                    else:
                        shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    texts.append(raw)
                    sizes.append(n)
                    removed.append(n - len(words))
                cols = [part.column(c) for c in range(len(names))]
                cols[at] = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], [*names, "n_words", "n_removed", "kept_sha256"])

    schema = ", ".join([*(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in docs.schema), "n_words long, n_removed long, kept_sha256 string"])
    return joined.mapInArrow(run, schema).withColumn(text, F.col(text).cast(kind))
