"""The test tables as changelogs and keyspaces."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.schema import DELETE, PUT

EVENTS_PER_LAYER = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    dead = F.col("event_type") == "error"
    return events.select(F.col("event_id").alias("seq"), F.when(dead, DELETE).otherwise(PUT).cast("tinyint").alias("op"), F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.when(~dead, F.concat_ws(":", "event_type", "event_id")).alias("value"), F.expr(f"event_id div {EVENTS_PER_LAYER}").alias("layer"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value) of four keyspaces."""
    parts = [("customer", "customer", "c_custkey", "c_mktsegment"), ("orders", "order", "o_orderkey", "o_orderstatus"), ("part", "part", "p_partkey", "p_brand"), ("supplier", "supplier", "s_suppkey", "s_name")]
    frames = [table(spark, sf_dir, t).select(F.concat(F.lit(f"{space}:"), F.col(k)).alias("key"), F.col(v).alias("value")) for t, space, k, v in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq is conv_id * 2^20 + turn: unique and in order without a global window, as turns are few."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * (1 << 20) + F.col("turn")).alias("seq"), F.lit(PUT).cast("tinyint").alias("op"), F.concat(F.lit("conv:"), F.col("conv_id")).alias("key"), F.col("role").alias("value"), F.lit(0).cast("bigint").alias("layer"))


def top_layer(log: DataFrame) -> int:
    """The highest layer, which stands for the MemTable; one number from column statistics or a scan of one column."""
    return log.agg(F.max("layer")).first()[0] or 0


__all__ = ["EVENTS_PER_LAYER", "conversations_log", "entities", "events_log", "from_events", "table", "top_layer"]
