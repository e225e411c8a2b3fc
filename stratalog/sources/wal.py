"""The log's byte format: frames of a length, a payload and its CRC-32, all numbers little-endian.

frame = payload length u32, payload, crc32(payload) u32; payload = op u8, key length u32, value length u32, key, value.
"""

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.errors import CorruptLog, InvalidInput
from stratalog.operators import merge
from stratalog.schema import DELETE, MAX_RECORD_BYTES, PUT
from stratalog.sources.workspace import arrow_folder, hadoop_path, ship_package


def _u32(n: Column) -> Column:
    """Four bytes, least first, as a binary column."""
    octet = lambda k: F.lpad(F.hex(F.shiftright(n.cast("bigint"), 8 * k).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0")
    return F.unhex(F.concat(*(octet(k) for k in range(4))))


def payload(op: Column, key: Column, value: Column) -> Column:
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(F.unhex(F.lpad(F.hex(op.cast("bigint")), 2, "0")), _u32(F.octet_length(key)), _u32(F.octet_length(value)), key, value)


def encode(log: DataFrame) -> DataFrame:
    """(seq, frame): the bytes of each record, made by built-in expressions."""
    body = log.select("seq", payload(F.col("op"), F.col("key"), F.col("value")).alias("p"))
    return body.select("seq", F.concat(_u32(F.octet_length("p")), F.col("p"), _u32(F.crc32("p"))).alias("frame"))


def frame(op: int, key: bytes, value: bytes = b"") -> bytes:
    if not key:
        raise InvalidInput("keys must not be empty")
    if op == DELETE and value:
        raise InvalidInput("a tombstone has no value")
    body = struct.pack("<BII", op, len(key), len(value)) + key + value
    if len(body) > MAX_RECORD_BYTES:
        raise InvalidInput(f"a record of {len(body)} bytes is over the limit of {MAX_RECORD_BYTES}")
    return struct.pack("<I", len(body)) + body + struct.pack("<I", zlib.crc32(body))


def frames(raw: bytes | memoryview) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(op, key, value or None) in order, from bytes or any buffer. A tail that ends early is ignored; anything else that is wrong is CorruptLog."""
    raw, at = memoryview(raw), 0
    while at + 4 <= len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        if n > MAX_RECORD_BYTES:
            raise CorruptLog(f"record length {n} at byte {at} is over the limit")
        if at + 8 + n > len(raw):
            return
        body = bytes(raw[at + 4 : at + 4 + n])
        if zlib.crc32(body) != struct.unpack_from("<I", raw, at + 4 + n)[0]:
            raise CorruptLog(f"checksum mismatch at byte {at}")
        yield _record(body, at)
        at += 8 + n


def _record(body: bytes, at: int) -> tuple[int, bytes, bytes | None]:
    if len(body) < 9:
        raise CorruptLog(f"record at byte {at} is too short")
    op, keys, values = struct.unpack_from("<BII", body)
    if op not in (PUT, DELETE) or 9 + keys + values != len(body) or not keys or (op == DELETE and values):
        raise CorruptLog(f"record at byte {at} is malformed")
    return op, body[9 : 9 + keys], body[9 + keys :] if op == PUT else None


def write(log: DataFrame, folder: str) -> DataFrame:
    """Write a log's frames in order of seq to segment files; gives (file, first, records, bytes) and writes as it is read. A file has the number of its first record as its name, so that names order files; a task that runs again writes the same file again."""
    ship_package(log.sparkSession)

    def run(batches):
        import pyarrow as pa

        files, path = arrow_folder(folder)
        out, first, n, size = None, 0, 0, 0
        for b in batches:
            for seq, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    files.create_dir(path, recursive=True)
                    first, out = seq, files.open_output_stream(f"{path}/{seq:020d}.wal", compression=None)
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{first:020d}.wal"], "first": [first], "records": [n], "bytes": [size]})

    ordered = encode(log.repartitionByRange("seq")).sortWithinPartitions("seq")
    return ordered.mapInArrow(run, "file string, first long, records long, bytes long")


#: Records of a file that are decoded at once.
DECODED = 4096


def recover(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, op, key, value) of log files, in order of their names and of pos. Each file is a segment of up to 2 GB, so files are decoded in parallel, a bounded number of records at a time. A missing folder is an empty log."""
    schema = "file string, pos long, op int, key binary, value binary"
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    ship_package(spark)

    def decode(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for b in batches:
            for k in range(b.num_rows):
                name, records, at = b.column(0)[k].as_py(), frames(b.column(1)[k].as_buffer()), 0
                while got := list(islice(records, DECODED)):
                    ops, keys, values = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([name] * len(got), range(at, at + len(got)), ops, keys, values), kinds, strict=True)], ["file", "pos", "op", "key", "value"])
                    at += len(got)

    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content").mapInArrow(decode, schema)


def replay(records: DataFrame) -> DataFrame:
    """The state after all recovered records are applied in order: the last record of each key."""
    return merge.latest(records.select(F.struct("file", "pos").alias("seq"), "op", "key", "value"))


def verify(encoded: DataFrame) -> DataFrame:
    """(seq, verdict) of single frames: ok; torn, if the frame ends early, as a last write may; oversize or corrupt otherwise."""
    n = F.octet_length("frame")
    head = F.hex(F.substring("frame", 1, 4))
    declared = F.conv(F.concat(*(F.substring(head, 2 * k + 1, 2) for k in (3, 2, 1, 0))), 16, 10).cast("bigint")
    body = F.expr("substring(frame, 5, octet_length(frame) - 8)")
    sound = F.hex(_u32(F.crc32(body))) == F.expr("right(hex(frame), 8)")
    verdict = F.when(n < 4, "torn").when(declared > MAX_RECORD_BYTES, "oversize").when(n < declared + 8, "torn").when((n == declared + 8) & sound, "ok").otherwise("corrupt")
    return encoded.select("seq", verdict.alias("verdict"))
