import random
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from stratalog.llm import simhash
from stratalog.llm.catalog import QUERIES
from stratalog.llm.graph import components
from stratalog.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs):
    """(doc_id, fingerprint, component_id) of rows with a doc_id, all pairs compared."""
    fps = {}
    for k, text in docs:
        fps.setdefault(brute_fingerprint(text), []).append(k)
    roots = brute_roots([(a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 4], fps)
    least = {}
    for fp, ks in fps.items():
        least[roots[fp]] = min([least.get(roots[fp], 1 << 62), *(k for k in ks if k is not None)])
    return Counter((k, f"{fp:016x}", least[roots[fp]]) for fp, ks in fps.items() for k in ks)


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, SF).collect())
    assert got == brute(docs)


def test_edges_and_clusters(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    data = [(None, None), (5, None), (4, ""), (6, " \n\t "), (9, "One two"), (8, "one TWO"), (7, "one two three four"), (7, "one two three four"), (3, "x " * 50_000)]
    for k in range(100, 220):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(300)] = rng.choice(words)
        data.append((k, " ".join(t)))
    data += [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(300, 360)]
    docs = spark.createDataFrame([(k, t, "x", "s", 0) for k, t in data], DOCS).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(docs, Scratch(spark)).collect()
    assert Counter((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got) == brute(data)
    kept = simhash.keep_one(docs, Scratch(spark)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in brute(data)}) and kept[0]["fp"] == "clash"
    assert simhash.near_duplicates(docs.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_every_pair_is_probed(m):
    rng = random.Random(m)
    groups = [list(range(g, 64, m)) for g in range(m)]
    costs = [[0.0] + [rng.random() * 10**t for t in range(5)] for _ in range(m)]
    t = simhash.allocate(costs, 5 - m)
    assert sum(t) == 5 - m
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any((x & sum(1 << b for b in g)).bit_count() <= k for g, k in zip(groups, t, strict=True))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark)).collect()}
    want = brute_roots(edges, {x for e in edges for x in e})
    assert got == {n: r for n, r in want.items() if n != r}


def test_candidate_pairs_come_once(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)})
    near = {(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 9}
    asked = []

    def refuse(pairs):
        asked.append([(r["a"], r["b"]) for r in pairs.collect()])
        return pairs.where("false")

    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(i, f, 1) for i, f in enumerate(signed)], "id long, fp long, n long")
    roots = simhash.link(nodes, Scratch(spark), 9, refuse)
    assert {r["id"]: r["root"] for r in roots.collect()} == {i: i for i in range(len(fps))}
    assert sorted(asked[-1]) == sorted(near)
