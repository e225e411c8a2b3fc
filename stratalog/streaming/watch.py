"""The change feed. Each function works on a batch or a streaming DataFrame of log records alike."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.keys import has_prefix
from stratalog.operators.merge import latest
from stratalog.schema import DELETE, PUT
from stratalog.sources.adapters import from_events


def event_name(op: Column) -> Column:
    return F.when(op == PUT, "put").when(op == DELETE, "delete").otherwise("unknown")


def events(log: DataFrame) -> DataFrame:
    """(seq, event, key, value): an event for every committed record, none for flush or compaction."""
    return log.select("seq", event_name(F.col("op")).alias("event"), "key", F.coalesce("value", F.lit("").cast(log.schema["value"].dataType)).alias("value"))


def watch(log: DataFrame, prefix: str | bytes = "") -> DataFrame:
    return events(log.where(has_prefix(F.col("key"), prefix)))


def as_json(feed: DataFrame) -> DataFrame:
    return feed.select("seq", F.to_json(F.struct("event", "key", "value")).alias("payload"))


def as_lines(feed: DataFrame) -> DataFrame:
    """EVENT key=value, or EVENT key when there is no value."""
    what = F.concat_ws(" ", F.upper("event"), "key")
    return feed.select("seq", F.when(F.col("value") == "", what).otherwise(F.concat_ws("=", what, "value")).alias("line"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of log records."""
    path = f"{sf_dir}/events.parquet"
    return from_events(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))  # a stream takes one file only as a pattern


def state(log: DataFrame) -> DataFrame:
    """The newest record of each key; over a stream this is a stateful aggregate for update or complete mode."""
    return latest(log)


def run_to_files(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is there now into Parquet files in a shared folder, and read them. In complete mode each batch is a whole result in a folder of its own, and the last is read."""
    spark, schema = stream.sparkSession, stream.schema
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{folder}/rows")
    done = []

    def whole(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{k}")
        done.append(k)

    out.foreachBatch(whole).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/batch-{done[-1]}") if done else spark.createDataFrame([], schema)
