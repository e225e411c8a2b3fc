"""Connected components of edge lists too large for one machine, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.scratch import Scratch


def split_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys on the left can be split at run time. `right` has one row a key. Null keys meet nothing.

    Adaptive execution splits a skewed partition only where both inputs are shuffled for the join itself; a second key that follows from the first makes it so, even if one input comes partitioned by key from an aggregate.
    """
    keys = [key] if isinstance(key, str) else key
    twin = F.pmod(F.hash(*keys), F.lit(1 << 20))
    return left.withColumn("_twin", twin).join(right.withColumn("_twin", twin), [*keys, "_twin"], how).drop("_twin")


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return split_join(both.where(F.col("b") > F.col("a")), least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Each edge has its larger end in a."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = split_join(e, least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge to a root, and no root has one: stars are the only trees left."""
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    ends = e.select(F.col("a").alias("node"), one.alias("up"), none.alias("down")).unionByName(e.select(F.col("b").alias("node"), none.alias("up"), one.alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) edges of any orderable type to (node, root): root is the least node reached. Nodes that are their own root aren't listed. Loops and repeated edges do no harm.

    Each round is written to the shared folder, so a lost executor costs a task and no round. A round keeps components and moves nodes only to smaller ones, so rounds end, and they do when all trees are stars.
    """
    e = scratch.save(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(e):
        e = scratch.save(_small_star(_large_star(e)), "stars")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
