"""WARC archives by index first: a record's file, offset, length, URL and digest are written as it is, and reads go by them.

Archives are gzip files of one member a record, in the shared folder. The index is a table; records to read are sorted by file and offset, neighbouring ranges are read at once, and each record is checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.graph import split_join
from stratalog.llm.scratch import Scratch
from stratalog.sources.workspace import arrow_folder

FILE_BYTES = 256 << 20
#: Ranges this near to each other are read at once, up to so many bytes (or one record, if it is larger).
GAP, SPAN = 64 << 10, 8 << 20
#: Archive bytes that a reading task gets.
TASK_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id {key}, file string, offset long, length long, url string, payload_digest string, record_type string, refers_to {key}"


class DamagedArchive(Exception):
    """A record isn't where the index says, or doesn't match its digest."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str) -> str:
    """A URL fit for a header line: control characters and spaces are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page} sha1 {digest}')}>"


def record(page, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record. A revisit has the digest and length of the whole payload but not the payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if page is not None:
        lines.append(f"X-Page-ID: {quote(str(page))}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {quote(str(refers_to))}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, body) of one record, names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise DamagedArchive("no WARC record starts here")
    fields = lambda ls: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in ls)}
    warc = fields(lines)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise DamagedArchive("a record's length is wrong")
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), body


def write(records: DataFrame, folder: str, key_type: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """records (page_id, url, payload, refers_to) to archive files and the index rows. Files have fresh names, so a task that runs again leaves only a file that no index row names."""

    def run(batches):
        import pyarrow as pa

        files, path = arrow_folder(folder)
        out, name, at = None, "", 0
        schema = None
        try:
            for b in batches:
                rows: list[list] = [[] for _ in range(8)]
                for k in range(b.num_rows):
                    page, url, payload, refers = (b.column(c)[k].as_py() for c in range(4))
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        files.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    digest = base32_sha1(payload)
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = z.compress(record(page, url, payload, digest, refers)) + z.flush()
                    out.write(member)
                    for to, v in zip(rows, (page, name, at, len(member), url, digest, "response" if refers is None else "revisit", refers), strict=True):
                        to.append(v)
                    at += len(member)
                kinds = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), b.schema.field(0).type]
                schema = schema or ["page_id", "file", "offset", "length", "url", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], schema)
        finally:
            if out is not None:
                out.close()

    return records.mapInArrow(run, INDEX.format(key=key_type))


def archive(pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """(index, folder): every row of pages as a record, and the written index.

    Of rows with equal payloads (null counts as empty) those with the least key are responses, the others revisits of it. Rows with a null key come after all others: they are revisits if any row of their payload has a key, else all responses. Repeated rows all get a record; those that repeat the response are responses too. An empty table gives an empty index.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    heads = rows.groupBy("sha").agg(F.min("page_id").alias("head"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    decided = split_join(rows, heads, "sha").select("page_id", "url", "payload", refers.alias("refers_to"))
    folder = f"{scratch.path}/warc"
    return scratch.save(write(decided, folder, dict(pages.dtypes)[key]), "index"), folder


def _ranges(rows: list[tuple], gap: int, span: int) -> Iterator[list[tuple]]:
    """Runs of rows (file, offset, length, ...) in order that one read can cover."""
    run: list[tuple] = []
    for r in rows:
        if run and (r[0] != run[-1][0] or r[1] > run[-1][1] + run[-1][2] + gap or r[1] + r[2] - run[0][1] > span):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read(selected: DataFrame, folder: str, key_type: str, with_payload: bool = False, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records of selected index rows: page_id, payload_bytes, payload_digest, record_type, refers_to and, if wanted, payload (null for revisits). Each response's payload is hashed again and must have the digest of its header and of the index.

    Keys of any type that has a text come back as they were, null ones as null and empty ones as empty. Empty payloads are records like any other; repeated index rows give repeated records; an empty selection gives no rows. A reading task holds ranges of `span` bytes, or one record, whatever the tables' sizes.
    """

    def key(text: str | None, kind):
        import pyarrow as pa

        return None if text is None else pa.array([unquote(text)]).cast(kind)[0].as_py()

    def run(batches):
        import pyarrow as pa

        files, path = arrow_folder(folder)
        for b in batches:
            kind = b.schema.field(4).type
            rows = list(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
            for group in _ranges(rows, gap, span):
                low, high = group[0][1], max(r[1] + r[2] for r in group)
                with files.open_input_file(f"{path}/{group[0][0]}") as f:
                    f.seek(low)
                    raw = f.read(high - low)
                out: list[list] = [[] for _ in range(6)]
                for _, offset, length, digest in group:
                    try:
                        warc, http, body = parse(zlib.decompress(raw[offset - low : offset - low + length], 31))
                    except zlib.error as e:
                        raise DamagedArchive(f"{group[0][0]} at {offset}: {e}") from e
                    response = warc["warc-type"] == "response"
                    if warc["warc-payload-digest"] != f"sha1:{digest}" or (response and base32_sha1(body) != digest):
                        raise DamagedArchive(f"{group[0][0]} at {offset}: the digest differs")
                    for to, v in zip(out, (key(warc.get("x-page-id"), kind), int(http["content-length"]), digest, warc["warc-type"], key(warc.get("x-refers-to-page-id"), kind), body if response and with_payload else None), strict=True):
                        to.append(v)
                kinds = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ordered = selected.select("file", "offset", "length", "payload_digest", "page_id").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, f"page_id {key_type}, payload_bytes long, payload_digest string, record_type string, refers_to {key_type}, payload binary")


def select(index: DataFrame, condition: Column) -> DataFrame:
    """Index rows to read: any condition on url, digest, type or key."""
    return index.where(condition)
