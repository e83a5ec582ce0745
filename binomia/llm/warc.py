"""WARC archives as a Spark Python data source, and archiving of pages with revisit records for equal payloads.

``warc`` reads .warc and .warc.gz files: whole files are dealt to partitions by size; record-type and header predicates
are pushed into the reader, which parses a record's headers first and skips the block of records that fail them or whose
payload no asked-for column needs. Files are not split, as a payload may itself hold an archive. Blocks stream through,
so memory is bounded by the largest single record. Writing goes to names of the task attempt's own; the commit gives
them their final names, so retried or lost tasks leave nothing behind.

archive() finds, for each payload digest met more than once, the smallest page id by a pre-aggregated group-by of
(digest, id) alone; the join that brings it to the pages is a plain shuffled join, which adaptive execution splits where
one payload holds many pages.

Defined results: a null body is an empty payload; a null url gives a record without target; records with a null page id
carry none and read back null, and are revisits wherever an equal payload has an id; rows that repeat the smallest id of a
payload are all responses; an empty table gives an empty archive, which reads as no rows. Other columns are not read.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import fresh_path, local_or_uri

#: What a record offers; a reader asked for fewer columns (by .schema()) decodes fewer.
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, block_digest string, payload_digest string, refers_to string, content_length bigint, "
    "http_status int, http_content_type string, http_content_length bigint, payload binary, path string"
)
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "block_digest": "warc-block-digest",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_length": "content-length",
}
HTTP_COLUMNS = {"http_status", "http_content_type", "http_content_length", "payload"}
MIN_REVISIT_BYTES = 100
PARTITION_BYTES = 64 << 20
FILE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
ID_PREFIX = "<urn:x-page:"


# -- parsing ---------------------------------------------------------------------------------------------------------


def _skip(stream, n: int) -> None:
    while n > 0:
        got = stream.read(min(n, 1 << 20))
        if not got:
            raise ValueError("a record ends before its Content-Length")
        n -= len(got)


def _header_lines(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    while line := stream.readline(1 << 16):
        line = line.rstrip(b"\r\n")
        if not line:
            break
        if line[:1] in b" \t" and last:  # folded
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.decode("latin-1").strip().lower()
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def read_records(stream, wanted: set[str], tests: list | None = None) -> Iterator[dict]:
    """Records of an open archive as dicts of the wanted columns; tests see the header columns before any block is read."""
    while line := stream.readline(1 << 16):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        headers = _header_lines(stream)
        length = int(headers.get("content-length", 0))
        row = {k: headers.get(h) for k, h in HEADERS.items()} | {"content_length": length}
        if tests and not all(t(row) for t in tests) or not wanted & HTTP_COLUMNS:
            passed = not tests or all(t(row) for t in tests)
            _skip(stream, length)
            if passed:
                yield row
            continue
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a record ends before its Content-Length")
        row |= {"http_status": None, "http_content_type": None, "http_content_length": None, "payload": block}
        if (row["content_type"] or "").startswith("application/http"):
            head, _, row["payload"] = block.partition(b"\r\n\r\n")
            first, _, rest = head.partition(b"\r\n")
            http = _header_lines(io.BytesIO(rest + b"\r\n\r\n"))
            status = re.match(rb"HTTP/\S+ (\d+)", first)
            size = http.get("content-length", "")
            row |= {"http_status": int(status[1]) if status else None, "http_content_type": http.get("content-type"), "http_content_length": int(size) if size.isdigit() else None}
        yield row


def _test(f):
    """A predicate over a row of header columns for a pushed filter, or None where Spark has to keep it."""
    kinds = {
        EqualTo: lambda a, b: a == b,
        GreaterThan: lambda a, b: a > b,
        GreaterThanOrEqual: lambda a, b: a >= b,
        LessThan: lambda a, b: a < b,
        LessThanOrEqual: lambda a, b: a <= b,
        StringStartsWith: str.startswith,
        StringEndsWith: str.endswith,
        StringContains: str.__contains__,
    }
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in HEADERS:
        return None
    if type(f) in kinds:
        return lambda row, op=kinds[type(f)], value=f.value: row[name] is not None and op(row[name], value)
    if isinstance(f, EqualNullSafe):
        return lambda row, value=f.value: row[name] == value
    if isinstance(f, In):
        return lambda row, values=frozenset(f.value): row[name] in values and row[name] is not None
    if isinstance(f, IsNotNull):
        return lambda row: row[name] is not None
    if isinstance(f, IsNull):
        return lambda row: row[name] is None
    return None


# -- the data source ---------------------------------------------------------------------------------------------------


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.pushed = schema.names, options, []
        self.schema = schema

    def pushFilters(self, filters):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self):
        from pyarrow import fs

        store, root = local_or_uri(self.options["path"])
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(x.path, x.size or 0) for x in sorted(files, key=lambda x: x.path) if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path) and not re.search(r"/[._][^/]*(/|$)", x.path.removeprefix(root.rstrip("/")))]
        limit = int(self.options.get("partitionbytes", PARTITION_BYTES))
        out, held = [], 0
        for path, size in files:
            if not out or held + size > limit:
                out.append(_Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out or [_Files([])]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, tests, wanted = to_arrow_schema(self.schema), [_test(f) for f in self.pushed], set(self.columns)
        store, _ = local_or_uri(self.options["path"])
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_stream(path, buffer_size=1 << 20) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for row in read_records(io.BufferedReader(_Raw(stream), 1 << 18), wanted, tests):
                    row["path"] = path
                    rows.append({k: row.get(k) for k in self.columns})
                    held += len(row.get("payload") or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class _Raw(io.RawIOBase):
    """Any object with read() as a raw stream, for a buffered reader with readline()."""

    def __init__(self, inner):
        self.inner = inner

    def readable(self):
        return True

    def readinto(self, buffer):
        got = self.inner.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_id: str, kind: str, target: str | None, payload: bytes, digest: str, length: int, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit's block holds the HTTP headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_clean(target)}"] if target is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: {refers_to}"] if refers_to else []
    else:
        block += payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", DATE)
        self.level, self.limit = int(options.get("level", 1)), int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator):
        store, root = local_or_uri(self.path)
        store.create_dir(f"{root}/_attempts", recursive=True)
        names, sink, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None or size > self.limit:
                    if sink is not None:
                        sink.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    sink, size = store.open_output_stream(f"{root}/_attempts/{names[-1]}"), 0
                raw = record_bytes(row["record_id"], row["record_type"], row["target_uri"], row["payload"] or b"", row["payload_digest"], row["payload_bytes"], row["refers_to"], self.date)
                packed = gzip.compress(raw, self.level, mtime=0)
                sink.write(packed)
                size += len(packed)
        if sink is not None:
            sink.close()
        return _Written(names)

    def commit(self, messages):
        store, root = local_or_uri(self.path)
        store.create_dir(root, recursive=True)
        for name in sorted(n for m in messages if m for n in m.paths):
            store.move(f"{root}/_attempts/{name}", f"{root}/{name}")
        store.create_dir(f"{root}/_attempts", recursive=True)
        store.delete_dir(f"{root}/_attempts")

    def abort(self, messages):
        store, root = local_or_uri(self.path)
        store.create_dir(f"{root}/_attempts", recursive=True)
        store.delete_dir(f"{root}/_attempts")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records under path; only the given columns are decoded. Filters on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc")
    if columns is not None:
        types = dict(x.strip().split(" ") for x in SCHEMA.split(","))
        reader = reader.schema(", ".join(f"{c} {types[c]}" for c in columns))
    return reader.load(path)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """What to write for each page: record_id, record_type, target_uri, payload, payload_digest, payload_bytes, refers_to."""
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "utf-8")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    met = own.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = own.join(met, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(ID_PREFIX), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", F.when(revisit, urn(F.col("first"))).alias("refers_to"),
    )


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> str:
    """Writes a record for each page under path (a new folder in the shared one by default); returns the path."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    spark.dataSource.register(WarcDataSource)
    with_revisits(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """An archive of archive() as one row a page; digests and sizes of responses come from the payload read back."""
    rows = read_archive(spark, path, ["record_id", "record_type", "payload_digest", "refers_to", "http_content_length", "payload"])
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    full = F.col("record_type") == "response"
    return rows.select(
        number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("http_content_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) payload_bytes, sha256(h) payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) f FROM d)
SELECT page_id, payload_bytes::BIGINT payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END refers_to
FROM m"""
