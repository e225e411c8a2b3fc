"""Exact ranks within groups of any size, by a range sort and a prefix sum over its partitions. Built-in functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.scratch import Scratch

#: monotonically_increasing_id() has the partition above this bit and the row's place below it.
PLACE_BITS = 33


def ranked(df: DataFrame, group: str, order: list[str], scratch: Scratch, out: str = "rank") -> DataFrame:
    """df with the rank from 0 of each row in its group (null is a group) by `order`, which decides alone: rows equal in it are interchangeable.

    No task holds a group: rows are range-partitioned by (group, order), sorted and numbered in place, and written. A group's earlier partitions add their counts, one row for each partition and group.
    """
    place = F.monotonically_increasing_id()
    placed = scratch.save(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_place", place), "ranked")
    part = F.shiftright("_place", PLACE_BITS)
    pieces = placed.groupBy(part.alias("_part"), group).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    pieces = pieces.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (before - F.col("_first")).alias("_shift"))
    joined = placed.join(pieces, (part == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(out, F.col("_place") + F.col("_shift")).drop("_place", "_p", "_g", "_shift")


WORDS = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")
