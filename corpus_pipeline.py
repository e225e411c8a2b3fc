"""From documents to piece ids: quality, near-duplicates, repeated passages, mixture, encoding.

Each stage works on all that the one before it kept, and its result is written and read again as the next one's input. What a stage writes on its way has a folder of its own, so pipelines don't meet; it goes as the driver ends. run() deletes a stage's result when the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import mixing, pieces, quality, simhash, substrings
from stratalog.llm.scratch import Scratch

#: Near-duplicates in the pipeline: sets of five-word shingles of a Jaccard similarity of 0.8, searched for among fingerprints of at most nine differing bits.
SHINGLE, SIMILARITY, DISTANCE = 5, 0.8, 9


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, all their columns and repeats. It learns from a bounded sample of labelled documents. Null and empty texts are scored as texts without words; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id (null last, then by text and other columns). Texts without words are one group; an empty table stays empty."""
    return simhash.keep_one(docs, Scratch(spark), k=DISTANCE, shingle=SHINGLE, similarity=SIMILARITY)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages that a document of a smaller doc_id has too, and n_chars of what is left. Emptied documents stay, with an empty text; null texts and rows of a null doc_id stay as they are, repeated rows end alike, an empty table stays empty."""
    out = substrings.deduplicate(docs, Scratch(spark))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it, at most three times. Null texts and texts without words count no words and can be taken like others, but not from sources without any words; null sources are one source; repeated rows are interchangeable; an empty table stays empty."""
    return mixing.emit(docs, Scratch(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each row, repeats included. Null and empty texts have no ids; null doc_ids stay; an empty table gives no rows."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-duplicates", drop_near_duplicates),
    ("substring deduplication", drop_repeats),
    ("mixture of sources", mix),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last is written and read again, and the one before it deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        between = Scratch(spark)
        docs = between.save(out, "stage")
        if last:
            last.delete()
        last = between
    return docs
