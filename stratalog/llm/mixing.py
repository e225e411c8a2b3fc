"""Mixing sources to target weights by systematic sampling. Built-in functions only."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.ranks import count_words, ranked
from stratalog.llm.scratch import Scratch

WEIGHTS = (1, 2, 3)
MOST = 3  # copies of a document, and a target over its source's size


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes is (source, source_size); gives (source, source_size, target).

    Sources in code point order, null last, weigh `weights` repeating, and share the total. A target stops at `most` times its source; what is above is shared again by weight. That fixed point is one level L with target = least(most * size, L * weight), where L is the largest of (total - caps before) / (weights from here on) with sources ordered by cap over weight. One row a source is all that meets in one task here.
    """
    w = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    ahead = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - before("cap")) / (F.sum("w").over(whole) - before("w")))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("w")).alias("target"))


def _decide(docs: DataFrame, scratch: Scratch, seed: int, key: str, text: str, source: str, also: dict[str, Column] | None = None) -> DataFrame:
    """_k, _s, _size, source_size, target and copies of each row, and the columns `also`. Only these narrow rows are sorted; each text is counted once."""
    tag = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), count_words(F.col(text)).alias("_size"), tag.alias("_tag"), *(c.alias(n) for n, c in (also or {}).items()))
    rows = ranked(scratch.save(rows, "sizes"), "_s", ["_size", "_tag", "_k"], scratch)
    aims = targets(rows.groupBy(F.col("_s").alias("source")).agg(F.sum("_size").alias("source_size"))).withColumnRenamed("source", "_t")
    rows = rows.join(aims, F.col("_s").eqNullSafe(F.col("_t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("_s", F.lit("")))), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    copies = F.floor((F.col("rank") + 1) * rate + start) - F.floor(F.col("rank") * rate + start)
    return rows.withColumn("copies", F.least(copies, F.lit(MOST)).cast("bigint"))


def mix(docs: DataFrame, scratch: Scratch, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, copies) for every row; a document enters the mix `copies` times.

    Each row expects target / source_size copies. Within a source the rows stand by size and then by a seeded hash; the running sum of expectations starts at one random offset a source, and a row is emitted once for each whole number that its step crosses. Neighbours have like sizes, so a source's words come near its target. No row has more than 3 copies. Null texts have no words; null sources are one source; ties and repeated rows are interchangeable; the result depends on the seed and the rows only. An empty table gives no rows. Sources of no words get no copies. Other columns aren't read.
    """
    rows = _decide(docs, scratch, seed, key, text, source)
    return rows.select(F.col("_k").alias(key), F.col("_s").alias(source), F.col("_size").alias("size"), "source_size", "target", "copies")


def _placed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with _file and _row, the place that each row is read from. What isn't read from files is written first."""
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return scratch.save(docs, "docs").select("*", *place)


def emit(docs: DataFrame, scratch: Scratch, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs, with all its columns, `copies` times. Rows are as in mix(): texts without words can be taken, but not from sources without any words, ties and repeated rows are interchangeable, other columns may have any name, an empty table gives no rows.

    Numbers of copies are decided on narrow rows and joined back by the place that a row was read from, so whole texts move once, and are dealt evenly whatever their sizes.
    """
    placed = _placed(docs, scratch)
    taken = _decide(placed, scratch, seed, key, text, source, {"_file": F.col("_file"), "_row": F.col("_row")}).where("copies > 0").select("_file", "_row", "copies")
    rows = placed.select(F.struct(*docs.columns).alias("row"), "_file", "_row").join(taken, ["_file", "_row"])
    return rows.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
