from oracle import compare
from pyspark.sql import functions as F

from stratalog.operators import bloom, merge
from stratalog.plans.catalog import QUERIES, SQL
from stratalog.sources.adapters import events_log

SF = "/root/testdata/sf0.01"


def test_all_layers_and_absent_keys_are_probed(spark):
    compare(spark, "bloom_probe", QUERIES["bloom_probe"], SQL["bloom_probe"], SF)
    entries = {(r["layer"], r["key"]) for r in merge.per_layer(events_log(spark, SF)).select("layer", "key").collect()}
    got = {(r["layer"], r["key"]): r["maybe"] for r in QUERIES["bloom_probe"](spark, SF).collect()}
    assert entries <= got.keys() and all(got[x] for x in entries) and {n for n, _ in got} == {n for n, _ in entries} and max(got)[0] > 10
    absent = got.keys() - entries
    assert absent and sum(got[x] for x in absent) < 0.03 * len(absent)  # ten bits a key


def test_a_filter_of_another_layer_says_no(spark):
    entries = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "gamma")], "layer long, key string")
    asked = entries.withColumn("layer", F.lit(3) - F.col("layer"))
    assert not any(r["maybe"] for r in bloom.probe(bloom.build(entries), asked).collect())
