import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import substrings
from stratalog.llm.catalog import QUERIES
from stratalog.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, window=50):
    """Counter of (doc_id, n_words, n_removed, sha256) by the definition."""
    words = [(k, (t or "").encode().split()) for k, t in docs]
    least = {}
    for k, ws in words:
        if k is not None:
            for p in range(len(ws) - window + 1):
                w = tuple(ws[p : p + window])
                least[w] = min(least.get(w, k), k)
    out = Counter()
    for k, ws in words:
        gone = set()
        for p in range(len(ws) - window + 1):
            if k is not None and least[tuple(ws[p : p + window])] < k:
                gone.update(range(p, p + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out[k, len(ws), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op10_substrings"](spark, SF)) == brute(docs)


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"leaves": 20, "anchor": 12, "group": 300, "limit": 40}), (3, {"anchor": 0, "group": 300, "limit": 3})])
def test_random_documents(spark, seed, how):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    passages = [[word() for _ in range(rng.randrange(40, 140))] for _ in range(6)]
    data = []
    for k in range(70):
        ws = []
        for _ in range(rng.randrange(1, 6)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = word()
            a = rng.randrange(len(p))
            ws += p[a:] + p[:a] if rng.random() < 0.3 else p
            ws += [word() for _ in range(rng.randrange(30))]
        data.append((rng.randrange(60), " ".join(ws)))
    data += data[:5] + [(200 + k, data[0][1]) for k in range(5)] + [(None, data[0][1]), (None, None), (7, None), (8, ""), (9, "\n \t"), (3, "a " * 400), (4, "a " * 300 + "b"), (5, data[1][1].replace(" ", "\n\n"))]
    docs = spark.createDataFrame([(k, t, "x", "s", 0) for k, t in data], DOCS).withColumns({"th": F.lit(1), "doc": F.lit("x"), "places": F.lit(2), "n_words": F.lit(3)})
    out = substrings.deduplicate(docs, Scratch(spark), **how)
    assert got(out) == brute(data)
    for r in out.collect():
        if r["n_removed"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
    assert sorted(str(r["text"]) for r in out.where("n_removed = 0").collect()) == sorted(str(t) for t in _unchanged(data))
    if seed == 1:
        assert substrings.deduplicate(docs.limit(0), Scratch(spark)).count() == 0


def _unchanged(data):
    rest = Counter()
    for (k, _, removed, sha), n in brute(data).items():
        if not removed:
            rest[k, sha] += n
    for k, t in data:
        key = k, hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
        if rest[key] > 0:
            rest[key] -= 1
            yield t


@pytest.mark.parametrize("copies", [40, 80])
def test_near_copies_cost_few_rows(spark, monkeypatch, copies):
    """Leaves of an anchor that too many near copies share are cut into a few pieces each, not into a row for each window."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    data = []
    for k in range(copies):
        ws = list(base)
        for _ in range(3):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        data.append((k, " ".join(ws)))
    rows, save = {}, Scratch.save

    def counted(self, df, name="t"):
        out = save(self, df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    docs = spark.createDataFrame([(k, t, "x", "s", 0) for k, t in data], DOCS)
    assert got(substrings.deduplicate(docs, Scratch(spark), anchor=5, group=400, limit=100)) == brute(data)
    assert max(n for name in rows if name not in ("stretches", "shared", "owned", "leaves") for n in rows[name]) <= 4 * rows["leaves"][0], rows


def test_keys_of_other_types(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([("b", text), ("a", text + " end"), ("", "x " + text), (None, text)], "doc_id string, text string")
    rows = {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(docs, Scratch(spark)).collect()}
    assert rows == {"b": 80, "a": 80, "": 0, None: 0}


def test_internal_nodes():
    common = np.array([0, 2, 1, 0, 3, 3])
    assert sorted(substrings.internal_nodes(common)) == [(1, 0, 3), (2, 0, 2), (3, 3, 6)] and substrings.internal_nodes(common, 2) == [(2, 0, 2), (3, 3, 6)]
    order = np.array([3, 0, 5, 1, 2, 4])
    assert substrings.least_in_deep_nodes(order, common, np.array([5, 3, 9, 1, 8, 7]), 2).tolist() == [1, 3, 3, 1, 3, 7]


@pytest.mark.parametrize("depth", [1, 2, 3, 7, 8])
def test_suffix_array(depth):
    rng = random.Random(depth)
    rows = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    words, ends = np.array(sum(rows, []), np.int64), np.repeat(np.cumsum([len(r) for r in rows]), [len(r) for r in rows])
    order, common = substrings.suffix_array(words, ends, depth)
    heads = [words[k : min(k + depth, ends[k])].tolist() for k in order]
    assert heads == sorted(heads) and sorted(order) == list(range(len(words)))
    for k in range(1, len(heads)):
        want = next((j for j, (x, y) in enumerate(zip(heads[k - 1], heads[k], strict=False)) if x != y), min(len(heads[k - 1]), len(heads[k])))
        assert common[k] == want


def test_leaf_repeats_are_maximal():
    a, b = list(range(100, 160)), list(range(300, 340))
    leaves = [np.array(x) for x in (a + b, [1, 2] + a[5:] + [7] + b, a[:52], [9, 9])]
    assert sorted(substrings.leaf_repeats(leaves, np.array([4, 6, 5, 1]), 50)) == [(1, 2, 6), (2, 0, 3)]
    assert substrings.leaf_repeats(leaves[:1] * 2, np.array([3, 3]), 50) == []
