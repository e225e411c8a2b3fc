"""The log and layer schemas. A record is a put (op 1, with a value) or a tombstone (op 2, without)."""

from pyspark.sql import types as T

PUT, DELETE = 1, 2

def log_schema(kind: str = "string") -> T.StructType:
    """Records with text or binary keys and values."""
    return T.StructType.fromDDL(f"seq BIGINT NOT NULL, op TINYINT NOT NULL, key {kind} NOT NULL, value {kind}")


def layer_schema(kind: str = "string") -> T.StructType:
    return log_schema(kind).add("layer", T.LongType(), False)


#: The flush threshold in bytes, and the largest log record that recovery accepts.
FLUSH_BYTES = 64 * 1024 * 1024
MAX_RECORD_BYTES = 128 * 1024 * 1024
