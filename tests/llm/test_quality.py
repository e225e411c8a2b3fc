import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import quality
from stratalog.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op9_quality"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x, rows=60) for x in (labels, flipped))
    assert a.weights.any()
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string"
    rows = [(None, None, None, None, None, "x", "y"), (1, "", "en", "s", 0, "x", "y"), (2, " \n", "en", "s", 0, "x", "y"), (3, "é" * 2_500_000, "en", "s", 0, "x", "y"), (3, "a b " * 700_000, "en", "s", 0, "x", "y"), (4, "same", "en", "s", 0, "x", "y"), (5, "same", "en", "s", 0, "x", "y")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 0), (4, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 7 and len({r["score"] for r in got if r["text"] == "same"}) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0


def plain_features(raw):
    """The definition, a byte and a word at a time."""
    word, base, mult = 1 << 64, 0x100000001B3, 0x9E3779B97F4A7C15

    def bucket(h, salt):
        x = (h + salt) * mult % word
        return ((x ^ x >> 29) * mult % word) >> (64 - quality.HASH_BITS)

    data = b" " + raw + b" "
    space = [x in b" \t\n\x0b\x0c\r" for x in data]
    c, out = [32 if s else x for s, x in zip(space, data, strict=True)], []
    for n in (3, 4):
        out += [bucket(sum(c[k + j] << 8 * j for j in range(n)), n) for k in range(len(c) - n + 1) if not any(space[k + 1 : k + n - 1])]
    words = [sum((x + 1) * pow(base, k, word) for k, x in enumerate(w)) % word for w in raw.split()]
    out += [bucket(w, 1) for w in words] + [bucket(7 if a == b else (3 * b + a) % word, 2) for a, b in zip(words, words[1:], strict=False)]
    return sorted(out) if words else [0]


@pytest.mark.parametrize("chunk", [1 << 20, 3, 4, 7, 64])
def test_features_do_not_depend_on_chunks(monkeypatch, chunk):
    rng = random.Random(chunk)
    texts = [b"", b" \t", b"abc", b"abc abc", b"a\tb\n\nc ", b"  lead", "é日本 x".encode() * 20, b"x" * 300 + b" y", bytes(rng.choice(b"ab  c\n") for _ in range(500))]
    monkeypatch.setattr(quality, "CHUNK", chunk)
    for t in texts:
        assert sorted(quality.features(t).tolist()) == plain_features(t)
    assert quality.features(None).tolist() == [0]


def test_training_against_plain_python():
    """The same steps without numpy's vectors, on whole buckets' lists."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("good", "fine", "text") if k % 2 else ("spam", "buy", "text")) for _ in range(rng.randrange(1, 9))).encode() for k in range(30)]
    labels, dim = [k % 2 for k in range(30)], quality.DIM
    model = quality.train([quality.pack(*quality.bag(t)) for t in texts], labels)
    draw = np.random.default_rng(1)
    start = draw.uniform(-1 / dim, 1 / dim, (quality.BUCKETS, dim)).astype(np.float32)
    vectors, layer, bias, steps, done = {}, [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0], quality.EPOCHS * len(texts), 0
    for _ in range(quality.EPOCHS):
        for k in draw.permutation(len(texts)):
            bag = Counter(plain_features(texts[k]))
            total = sum(bag.values())
            own = {i: vectors.setdefault(i, start[i].astype(float).tolist()) for i in bag}
            h = [sum(n / total * own[i][d] for i, n in bag.items()) for d in range(dim)]
            z = [sum(h[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            g = [quality.RATE * (1 - done / steps) * (e[c] / sum(e) - (c == labels[k])) for c in (0, 1)]
            back = [layer[d][0] * g[0] + layer[d][1] * g[1] for d in range(dim)]
            for d in range(dim):
                for c in (0, 1):
                    layer[d][c] -= h[d] * g[c]
            bias = [bias[c] - g[c] for c in (0, 1)]
            for i, n in bag.items():
                for d in range(dim):
                    own[i][d] -= n / total * len(bag) ** 0.5 * back[d]
            done += 1
    for t in texts:
        bag = Counter(plain_features(t))
        z = sum(n / sum(bag.values()) * sum(vectors[i][d] * (layer[d][1] - layer[d][0]) for d in range(dim)) for i, n in bag.items()) + bias[1] - bias[0]
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)
    assert all((model.score(t) > 0.5) == bool(y) for t, y in zip(texts, labels, strict=True) if set(t.split()) != {b"text"})


def test_long_texts_are_learnt_from_and_the_limit_counts_documents(spark):
    long = [(k, " ".join(["good fine", "spam buy"][k % 2] for _ in range(6000)), 1 - k % 2) for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in long], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in long] + [(k, 0) for k in range(1000, 3000)], "doc_id long, quality int")
    model = quality.fit(docs, labels, rows=20)  # labels without a document don't use up the sample
    assert model.score(b"good fine good fine") > 0.8 and model.score(b"spam buy spam buy") < 0.2
