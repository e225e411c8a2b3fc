import random
from collections import Counter
from itertools import combinations

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_simhash import brute_roots
from test_substrings import brute as brute_repeats

import corpus_pipeline
from stratalog.llm import pieces, quality, simhash
from stratalog.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows after each stage, as a caller gets them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        got = stage(spark, docs, SF)
        assert k == 4 or got.columns == docs.columns
        got.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_quality_stage(spark, kept):
    model = quality.fit(spark.createDataFrame(kept[0]), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))
    want = [r for r in kept[0] if model.score(r["text"].encode()) >= quality.THRESHOLD]
    assert sorted(map(tuple, kept[1])) == sorted(map(tuple, want)) and 0 < len(want) < len(kept[0])


def five_words(text):
    words = text.encode().lower().split()
    return [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []


def test_similarity_decides_not_the_fingerprint(spark):
    """Near copies of one text, of which some are below the similarity, and fingerprints that alone would link them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(300)], {}
    for k in range(160):
        ws = list(base)
        for _ in range(rng.randrange(16)):
            ws[rng.randrange(300)] = word()
        texts[k] = " ".join(ws)
    texts |= {k + 1000: texts[k].upper() + " \n" for k in range(5)} | {k + 2000: " ".join(word() for _ in range(50)) for k in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, Scratch(spark), k=corpus_pipeline.DISTANCE, shingle=5, similarity=0.8).collect()}
    fps, sets = ({k: f(t) for k, t in texts.items()} for f in (lambda t: simhash.fingerprint(t.encode(), 5) % (1 << 64), lambda t: set(five_words(t))))
    near = [(a, b) for a, b in combinations(sorted(texts), 2) if (fps[a] ^ fps[b]).bit_count() <= corpus_pipeline.DISTANCE]
    links = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == brute_roots(links, texts) and 100 < len(links) < len(near)


def test_near_duplicate_stage(kept):
    fps = {r["doc_id"]: simhash.fingerprint(r["text"].encode(), 5) % (1 << 64) for r in kept[1]}
    sets = {r["doc_id"]: set(five_words(r["text"])) for r in kept[1]}
    near = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= corpus_pipeline.DISTANCE]
    roots = brute_roots([(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], fps)
    assert sorted(r["doc_id"] for r in kept[2]) == sorted(set(roots.values())) and len(kept[2]) < len(kept[1])
    assert {tuple(r) for r in kept[2]} <= {tuple(r) for r in kept[1]}


def test_repeats_stage(kept):
    import hashlib

    want = brute_repeats([(r["doc_id"], r["text"]) for r in kept[2]])
    removed = {k: (n, sha) for k, _, n, sha in want}
    before = {r["doc_id"]: r for r in kept[2]}
    assert len(kept[3]) == len(kept[2])
    for r in kept[3]:
        n, sha = removed[r["doc_id"]]
        assert hashlib.sha256(" ".join(r["text"].split()).encode()).hexdigest() == sha if n else r == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])


def test_mixture_and_encoding_stages(spark, kept):
    copies, texts = Counter(r["doc_id"] for r in kept[4]), {r["doc_id"]: r for r in kept[3]}
    assert max(copies.values()) <= 3 and all(r == texts[r["doc_id"]] for r in kept[4])
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert Counter(r["doc_id"] for r in kept[5]) == copies
    for r in kept[5][:200]:
        assert r["ids"] == library.encode(texts[r["doc_id"]]["text"]) and r["round_trip"]


def test_run_equals_the_stages(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in kept[5])


def test_edges(spark):
    """Nulls in every column, repeated rows, an empty table and columns more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (9001, " ", None, "src1", None)], docs.schema)
    start = docs.unionByName(docs.limit(3)).unionByName(odd).withColumn("size", F.lit("clash")).withColumn("score", F.lit("x"))
    model = quality.fit(start, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))
    good = [r for r in start.collect() if model.score((r["text"] or "").encode()) >= quality.THRESHOLD]
    d, kept = corpus_pipeline.keep_quality(spark, start, SF), []
    assert sorted(map(str, d.collect())) == sorted(map(str, good))
    for _, stage in corpus_pipeline.STAGES[1:4]:  # on all rows, the odd ones too
        before, out = start if not kept else spark.createDataFrame(kept[-1], start.schema), None
        out = stage(spark, before, SF)
        assert out.schema.names == start.schema.names
        kept.append(out.collect())
    one, cut, mixed = kept
    assert sum(not (r["text"] or "").split() for r in one) == 1 and len({r["doc_id"] for r in one}) == len(one) and all(r["size"] == "clash" and r["score"] == "x" for r in one)
    assert sorted(str(r["doc_id"]) for r in cut) == sorted(str(r["doc_id"]) for r in one)
    assert mixed and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in cut} and max(Counter(map(str, mixed)).values()) <= 3
    rows = corpus_pipeline.encode(spark, start, SF).collect()
    assert len(rows) == start.count() and sum(r["n_tokens"] == 0 for r in rows) >= 2
    empty = docs.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
