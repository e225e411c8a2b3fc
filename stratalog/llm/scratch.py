"""Tables written on the way, in the folder that all executors and the driver share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalog.sources.workspace import remove, ship_package, workspace

#: Rows and bytes of a batch that goes to Python at once. Texts have no bound, and Spark's own limit of 10,000 rows does.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Where a table's input has fewer bytes than this for each of its tasks, the tasks are joined, down to so many a core.
TASK_BYTES, TASKS_A_CORE = 512 << 10, 4


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to sizes fit for whole texts, unless they are smaller already. The setting stays, because results are lazy: it must hold when they are computed."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key, str(most + 1)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def prepare(spark: SparkSession) -> None:
    """What any operator with Python code on executors needs of a session."""
    bounded_batches(spark)
    ship_package(spark)


def _inputs(df: DataFrame) -> int:
    """Bytes that the plan's leaves have, by Spark's statistics: of files their size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


class Scratch:
    """One folder of written tables. A written table is read again after the loss of any executor, and cuts the lineage. The folder goes with delete(), or else as the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        prepare(spark)
        self.path = workspace(spark, "scratch")
        # without native code Hadoop starts a process for each local folder, file and checksum file it makes, which shares the executor's whole memory until it runs; Parquet's pages have checksums of their own
        own = spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl")
        self.options = {"compression": "zstd"} | ({} if own else {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"})

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        most = max(TASKS_A_CORE * self.spark.sparkContext.defaultParallelism, _inputs(df) // TASK_BYTES)
        df.coalesce(min(most, (1 << 31) - 1)).write.options(**self.options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        remove(self.spark, self.path)
