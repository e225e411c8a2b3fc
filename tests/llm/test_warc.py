import gzip
import os

import pytest
from oracle import compare
from pyspark.sql import functions as F

from stratalog.llm import warc
from stratalog.llm.catalog import QUERIES, SQL
from stratalog.llm.scratch import Scratch

PAGES = [(5, "http://b", "same"), (3, "http://a b\r\nX: y", "same"), (9, None, "same"), (3, "http://a", "same"), (7, "u", None), (8, "u", ""), (1, "é", "<p>é\r\n\r\nWARC/1.1"), (None, "n", "only null"), (None, "n", "same"), (11, "long", "x" * 3_000_000), (12, "w", " ")]


def test_query_equals_sql(spark):
    compare(spark, "op1_warc", QUERIES["op1_warc"], SQL["op1_warc"], "/root/testdata/sf0.001")


def test_edges(spark):
    scratch = Scratch(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "payload": F.lit("x"), "file": F.lit("y")})
    index, folder = warc.archive(pages, scratch)
    rows = index.collect()
    assert len(rows) == len(PAGES)
    got = warc.read(index, folder, "long", with_payload=True).collect()
    kind = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in got}
    assert kind[3, 4] == ("response", None) and kind[5, 4] == kind[9, 4] == kind[None, 4] == ("revisit", 3)
    assert kind[7, 0] == ("response", None) and kind[8, 0] == ("revisit", 7) and kind[None, 9] == ("response", None)
    payloads = {(k, len((h or "").encode())): (h or "").encode() for k, _, h in PAGES}
    for r in got:
        raw = payloads[r["page_id"], r["payload_bytes"]]
        assert r["payload_digest"] == warc.base32_sha1(raw) and (r["record_type"] == "revisit" or bytes(r["payload"]) == raw)
    # a selection reads the selected records only
    some = warc.read(warc.select(index, F.col("url") == "u"), folder, "long").collect()
    assert sorted(r["page_id"] for r in some) == [7, 8]
    # each archive is a plain gzip file of whole records, at the places of the index
    path = folder.removeprefix("file:")
    path = "/" + path.lstrip("/")
    for name in {r["file"] for r in rows}:
        with gzip.open(f"{path}/{name}") as f:
            assert f.read().count(b"WARC/1.1\r\nWARC-Type") == sum(r["file"] == name for r in rows)
    index0, folder0 = warc.archive(pages.limit(0), Scratch(spark))
    assert index0.count() == 0 and warc.read(index0, folder0, "long").count() == 0
    # damage is found
    r = next(r for r in rows if r["page_id"] == 11)
    with open(os.path.join(path, r["file"]), "r+b") as f:
        f.seek(r["offset"] + r["length"] - 6)
        f.write(b"\0\1\2\3")
    with pytest.raises(Exception, match="DamagedArchive"):
        warc.read(index, folder, "long").collect()


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("a", 5000, 1), ("b", 0, 9)]
    assert [len(g) for g in warc._ranges(rows, 100, 1000)] == [3, 1, 1] and [len(g) for g in warc._ranges(rows, 100, 50)] == [2, 1, 1, 1]


def test_keys_of_other_types(spark):
    from decimal import Decimal

    for kind, keys in (("string", ["b", "", "a c\r\nX: 1", "ü", None]), ("decimal(20,2)", [Decimal("1.50"), Decimal("-3.00"), None])):
        pages = spark.createDataFrame([(k, "u", "same") for k in keys] + [(keys[0], "u", "other")], f"page_id {kind}, url string, html string")
        index, folder = warc.archive(pages, Scratch(spark))
        got = warc.read(index, folder, kind).collect()
        least = min(k for k in keys if k is not None)
        assert sorted((str(r["page_id"]), str(r["refers_to"])) for r in got if r["payload_bytes"] == 4) == sorted((str(k), "None" if k == least else str(least)) for k in keys)
