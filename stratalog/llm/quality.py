"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of hashed features: its words, the byte 3- and 4-grams of its words with their edges, and pairs of neighbouring words, where a repeated word is one feature of its own. A linear layer and a softmax follow. Vectors and layer are trained together by stochastic gradient descent in numpy. As mean and layer are linear, scoring needs only each feature's vector times the layer, so the executors get one float a bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import prepare

HASH_BITS = 18
BUCKETS = 1 << HASH_BITS
DIM = 8
EPOCHS = 6
RATE = 0.5
#: Bound of the training sample: labelled documents, those of the least key hashes.
SAMPLE_ROWS = 5000
THRESHOLD = 0.7
#: Bytes of a text that are looked at at once. Features don't depend on it.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE, _WORD = 0x100000001B3, 1 << 64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64."""
    return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, v, np.uint64)))) for v in (_BASE, pow(_BASE, -1, _WORD)))


_UP, _DOWN = _powers(CHUNK + 64)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h + np.uint64(salt)) * _MULT
    x ^= x >> np.uint64(29)
    return ((x * _MULT) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def features(raw: bytes | None) -> np.ndarray:
    """The buckets of all features of a text in UTF-8, repeats included; one constant feature if it has no words.

    A word's hash is the sum of (byte + 1) * B^place. A chunk hands on what the next one needs: its last three bytes, the hash and length of a word that isn't at its end, and the hash of the last whole word.
    """
    data, out = b" " + (raw or b"") + b" ", []
    open_hash, open_size, last = 0, 0, None
    for at in range(0, len(data), CHUNK):
        back = min(at, 3)
        b = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at) + back, at - back)
        space = _SPACE[b]
        c = np.where(space, 32, b).astype(np.uint64)
        # an n-gram has white space at its ends only, as the edge of a word; those that end before the chunk are in the last one
        small, inner = c.astype(np.uint32), ~space[1:-1]
        three = small[:-2] | small[1:-1] << np.uint32(8) | small[2:] << np.uint32(16)
        new = max(0, back - 2)
        out.append(_bucket(three[new:][inner[new:]].astype(np.uint64), 3))
        four = three[:-1].astype(np.uint64) | c[3:] << np.uint64(24)
        out.append(_bucket(four[inner[:-1] & inner[1:]], 4))
        space, c = space[back:], c[back:]
        before = np.concatenate(([open_size == 0], space[:-1]))
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * _UP[: len(c)])))
        if open_size:
            upto = int(ends[0]) if len(ends) else len(c)
            open_hash = (open_hash + pow(_BASE, open_size, _WORD) * int(sums[upto])) % _WORD
            open_size += upto
        words = []
        if open_size and len(ends):
            words, ends = [np.array([open_hash], np.uint64)], ends[1:]
            open_size = 0
        whole = starts[: len(ends)]
        words.append((sums[ends] - sums[whole]) * _DOWN[whole])
        if len(starts) > len(ends):
            k = int(starts[-1])
            open_hash, open_size = int(((sums[-1:] - sums[k : k + 1]) * _DOWN[k])[0]), len(c) - k
        words = np.concatenate(words)
        if len(words):
            out.append(_bucket(words, 1))
            line = words if last is None else np.concatenate((last, words))
            again = line[1:] == line[:-1]
            out.append(_bucket(np.where(again, np.uint64(7), line[1:] * np.uint64(3) + line[:-1]), 2))
            last = words[-1:]
    return np.concatenate(out) if last is not None else np.zeros(1, np.int32)


def bag(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The different features of a text, at most one a bucket, and how often it has each."""
    ids, n = np.unique(features(raw), return_counts=True)
    return ids, n.astype(np.int32)


def pack(ids: np.ndarray, n: np.ndarray) -> bytes:
    """A bag in little space: the steps between its ids and its counts, by byte planes, compressed."""
    both = np.concatenate((np.diff(ids, prepend=0), n)).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half]).astype(np.int32), both[half:].astype(np.int32)


class Model:
    """One float a bucket and a bias: a document's logit is the mean of its features' floats plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, raw: bytes | None) -> float:
        z = float(self.weights[features(raw)].mean(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


def train(bags: list[bytes], labels: list[int], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Vectors and a two-class softmax by stochastic gradient descent over packed bags, one document a step, at a falling rate. Classes weigh the same in sum. Without both classes the score is constant."""
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, n = unpack(bags[k])
            share = (n / n.sum()).astype(np.float32)
            h = share @ vectors[ids]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = (rate * weight[y[k]] * (1 - done / steps) * p).astype(np.float32)
            back = layer @ g
            layer -= np.outer(h, g)
            bias -= g
            vectors[ids] -= (share * len(ids) ** 0.5)[:, None] * back
            done += 1
    direction = layer[:, 1] - layer[:, 0]
    return Model((vectors @ direction).astype(np.float32), float(bias[1] - bias[0]))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; null keys count as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


HELD_OUT = 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Train on the whole texts of at most `rows` labelled documents outside the held-out fold: those with the least key hashes among the labelled keys that have a document. Keys with contradicting labels and rows with a null label or key are left out; of several texts of a key one is taken. Texts become bags of features on the executors, so what comes to the driver, packed, is bounded by `rows` and the buckets, however long texts are. Null texts count as empty."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & (fold(F.col(key)) != HELD_OUT)).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select("_k", "_y")
    raw = docs.select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("_t")).where("_k IS NOT NULL")
    hashed = raw.select("_k", F.xxhash64("_t").alias("_th")).join(known, "_k").groupBy("_k").agg(F.min("_th").alias("_th"), F.min("_y").alias("_y"))
    picked = hashed.withColumn("_h", F.xxhash64("_k")).orderBy("_h", "_k").limit(rows).collect()
    if not picked:
        return train([], [])
    place = docs.sparkSession.createDataFrame([(r["_k"], r["_th"], k) for k, r in enumerate(picked)], f"_k {dict(raw.dtypes)['_k']}, _th long, _place int")
    sample = raw.withColumn("_th", F.xxhash64("_t")).join(F.broadcast(place), ["_k", "_th"]).select("_place", "_t").dropDuplicates(["_place"])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([pack(*bag(b.column(1)[k].as_py()))], pa.binary())], ["place", "bag"])

    got = sorted((r["place"], bytes(r["bag"])) for r in sample.mapInArrow(run, "place int, bag binary").collect())
    return train([b for _, b in got], [picked[p]["_y"] for p, _ in got])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column `score`, from 0 to 1: how likely label 1 is, from the whole text alone. Null and empty texts have the score of a text without words; equal texts have equal scores; an empty table stays empty. A column `score` of docs is replaced."""
    weights, bias = model.weights, model.bias
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = Model(weights, bias)
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", run(F.col(text).cast("binary")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score and predicted (1 from the threshold up), for every row.

    Null and empty texts score as a text without words. Equal texts get equal scores. Rows of a null key count as the fold of an empty text. Columns of docs with the new names are replaced. An empty table gives no rows; without labels of both kinds the score is the same for all.
    """
    model = fit(docs, labels, key, text)
    out = score(docs.drop("score", "held_out", "predicted"), model, text)
    return out.withColumns({"held_out": fold(F.col(key)) == HELD_OUT, "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that score `threshold` or more, as they are: all their columns, whatever their names, and all repeats. Rows with a null key or text are scored like others."""
    bare = docs.select(F.col(text).alias("t"), F.struct(*docs.columns).alias("row"))
    return score(bare, fit(docs, labels, key, text), "t").where(F.col("score") >= threshold).select("row.*")
