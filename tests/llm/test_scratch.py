from pathlib import Path

from stratalog.llm import scratch
from stratalog.llm.scratch import Scratch


def files(s, pattern):
    return list(Path(s.path.removeprefix("file:")).rglob(pattern))


def test_tiny_partitions_share_files(spark):
    s = Scratch(spark)
    got = s.save(spark.range(0, 2110, 1, 211))
    assert len(files(s, "*.parquet")) <= scratch.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in got.collect()) == list(range(2110))
    s.delete()


def test_no_checksum_files(spark):
    s = Scratch(spark)
    s.save(spark.range(100))
    assert files(s, "*.parquet") and not files(s, ".*.crc")
    s.delete()


def test_partitions_stay_where_the_input_is_large(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_BYTES", 64)
    s = Scratch(spark)
    got = s.save(spark.range(0, 2110, 1, 211))
    assert len(files(s, "*.parquet")) == 211 and got.count() == 2110
    s.delete()
