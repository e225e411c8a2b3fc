"""Media columns: payloads stored as progressive JPEG, read back as RGB tensors."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import jpeg
from stratalog.llm.scratch import Scratch, prepare

BLOCK = 64


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text's UTF-8 as a JPEG that holds it without loss. Null texts count as empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([jpeg.store(padded(x)) for x in raw], pa.binary())], ["k", "n_bytes", "media"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, n_bytes long, media binary").withColumnRenamed("k", key)


def tensors(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, height, width, tensor): the full-resolution RGB samples of stored media, row by row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                t = jpeg.rgb(jpeg.decode(b.column(1)[k].as_py()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([t.shape[0]], pa.int32()), pa.array([t.shape[1]], pa.int32()), pa.array([t.tobytes()], pa.binary())], ["k", "height", "width", "tensor"])

    return stored.select(F.col(key).alias("k"), "media").mapInArrow(run, f"k {dict(stored.dtypes)[key]}, height int, width int, tensor binary").withColumnRenamed("k", key)


def read_back(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from stored media alone. Every scan is decoded, the payload taken from the coefficients and the feature from the RGB tensor."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[] for _ in range(6)]
                for x in part.column(2):
                    media = x.as_py()
                    img = jpeg.decode(media)
                    raw = jpeg.payload(img)
                    for to, v in zip(cols, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), jpeg.feature(jpeg.rgb(img))), strict=True):
                        to.append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = stored.select(F.col(key).alias("k"), "n_bytes", "media")
    return rows.mapInArrow(run, f"k {dict(stored.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("k", key)


def media_features(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """read_back() of the written media of every row. Null keys, empty texts and repeated rows stay; equal texts give equal values; an empty table gives no rows. Columns other than key and text aren't read. A text is one image at any length: a row of the widest images has 1.5 MB, and more text makes them higher."""
    return read_back(scratch.save(store(docs, key, text), "media"), key)
