import numpy as np
from oracle import compare
from pyspark.sql import functions as F

from stratalog.llm import embeddings
from stratalog.llm.catalog import QUERIES, SQL
from stratalog.llm.scratch import Scratch


def brute(keys, vectors, cosine=0.9):
    ok = [k for k, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(keys), list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit = {k: np.array(vectors[k], np.float32).astype(float) for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(keys)):
        least[find(k)] = min(least.get(find(k), keys[k]), keys[k])
    return {keys[k]: (links[k], least[find(k)]) for k in range(len(keys))}


def clustered(n=900, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.3, 1.0], (n, 1))
    x[:150] = x[0]
    x[150:160] = 2 * x[0]
    return x


def test_query_equals_sql(spark):
    compare(spark, "op2", QUERIES["op2_embeddings"], SQL["op2_embeddings"], "/root/testdata/sf0.001")


def test_links_and_recall_against_brute_force(spark):
    x = clustered().astype(np.float32)
    vectors = [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [2.0, -4.0], [], [1.0, 0.0, 0.0, 2.0, 0.0], [1e-30] * 16, [1e30] * 16]
    keys = list(range(1000, 1000 + len(vectors)))[::-1]
    df = spark.createDataFrame(list(zip(keys, vectors, strict=True)), "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "cell": F.lit("x"), "root": F.lit(2)})
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, Scratch(spark), reach=1.0).collect()}
    want = brute(keys, vectors)
    assert {k: (r["n_links"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert embeddings.near_vectors(df.limit(0), Scratch(spark)).count() == 0
    # the measured reach finds nearly all links, none of them wrong
    some = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df, Scratch(spark)).collect()}
    assert all(some[k] <= want[k][0] for k in want) and sum(some.values()) >= 0.99 * sum(n for n, _ in want.values())


def test_null_keys_repeats_and_one_dimension(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embeddings.near_vectors(df, Scratch(spark)).collect())
    assert got == [(0, 0, 0, True), (0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]
    one = spark.createDataFrame([(1, [2.0]), (2, [5.0]), (3, [-1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["component_id"]) for r in embeddings.near_vectors(one, Scratch(spark)).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_multi_sequence_is_in_order():
    a, b = [0.0, 0.1, 0.5], [0.0, 0.2, 0.3, 0.9]
    got = [a[i] + b[j] for i, j in embeddings.multi_sequence(a, b, 0.65)]
    assert got == sorted(got) == sorted(x + y for x in a for y in b if x + y <= 0.65)


def test_rare_links_near_the_threshold_are_found(spark, monkeypatch):
    """As in a table of a million: few of the vectors that are asked have links, and a half has many codewords."""
    monkeypatch.setattr(embeddings, "QUERIES", 1)
    monkeypatch.setattr(embeddings, "PER_CELL", 1)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(60, 64))
    side -= (side * x[:60]).sum(1)[:, None] * x[:60]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[60:120] = 0.902 * x[:60] + np.sqrt(1 - 0.902**2) * side  # 60 pairs among 20,000 vectors
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df, Scratch(spark)).where("n_links > 0 OR NOT kept").collect()}
    assert got == {k: (1, k % 60) for k in range(120)}, len(got)


def test_a_link_found_from_one_side_counts_for_both(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_CELL", 1)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x[200:400] = x[:200] + 0.45 * rng.normal(size=(200, 64))  # pairs near the threshold
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, Scratch(spark), reach=0.02).collect()}
    found = [k for k in range(200) if got[k + 200]["component_id"] == k]
    assert 20 < len(found) < 200
    assert all(got[k]["n_links"] == got[k + 200]["n_links"] == 1 for k in found)
    assert sum(r["n_links"] for r in got.values()) == 2 * len(found)
