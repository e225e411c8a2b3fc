import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from stratalog.llm import pieces
from stratalog.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "   ", "a", " a", "a  b", "a" * 500, "hello   world " + " " * 40 + "x", "日本語テスト", "naïve café ▁ mark▁▁x", "\n\n\t tab", "😀 emoji 😀😀", "\x00nul", "...... ======== --------", "<s> </s> <unk> <0x41>", "é" * 100, " " * 333, "x" + " " * 100 + "y  "]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_edge_texts_equal_the_library(model, library):
    p = pieces.Pieces(model)
    for t in TEXTS:
        assert p.encode(t) == library.encode(t), t
        if "▁" not in t and "\x00" not in t:
            assert p.decode(p.encode(t)) == t


def test_random_texts_equal_the_library(model, library):
    rng, p = random.Random(5), pieces.Pieces(model)
    letters = "aeiou tnrs  thingdéöß.,!?-1234567890\n日本😀"
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert p.encode(t) == library.encode(t), t
        assert p.encode(t) == p.merge("▁" + t.replace(" ", "▁")) if t else True


def number(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def unigram_model(pieces_, byte_fallback):
    """A unigram model file with given pieces and scores; nothing is trained."""
    field = lambda n, v: number(n << 3 | 2) + number(len(v)) + v if isinstance(v, bytes) else number(n << 3) + number(v)
    piece = lambda t, score, kind: field(1, field(1, t.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + field(3, kind))
    special = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    octets = [(f"<0x{k:02X}>", 0.0, pieces.BYTE) for k in range(256)] if byte_fallback else []
    trainer = field(3, pieces.UNIGRAM) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2)
    normaliser = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return b"".join(piece(*p) for p in [*special, *octets, *((t, s, pieces.NORMAL) for t, s in pieces_)]) + field(2, trainer) + field(3, normaliser)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_viterbi_of_a_unigram_model_equals_the_library(byte_fallback):
    rng = random.Random(6)
    letters = "aeinthrs\u2581"
    found = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(700)}
    found = sorted({t for t in found if "\u2581" not in t[1:]} | set("aeinth\u2581"))  # r and s within longer pieces only
    data = unigram_model([(t, -rng.random() * 4 - 2 * len(t) ** 0.5) for t in found], byte_fallback)
    ours, library = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for k in range(2000):
        t = "".join(rng.choice("aeinthrs  " if k % 2 else "aeinthrs  é日xq") for _ in range(rng.randrange(1, 40)))
        ids = ours.encode(t)
        assert ids == library.encode(t), t
        assert not byte_fallback or ours.decode(ids) == t


def test_query_equals_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_pieces"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["ids"] == library.encode(docs[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "a b"), (2, "a b"), (3, "long " * 100_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = pieces.encode(docs).collect()
    assert len(got) == 5 and all(r["round_trip"] for r in got) and [r["n_tokens"] for r in got if not r["doc_id"] or r["doc_id"] == 1] == [0, 0]
    assert pieces.encode(docs.limit(0)).count() == 0
