"""Helpers that the operators share: the shared folder, written stages, Arrow text access, safe names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute below
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A local session without ``spark.checkpoint.dir`` (tests, one machine) gets a temporary folder, once; a cluster's must name one.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='binomia-')}"
        spark.conf.set(CHECKPOINT_CONF, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._binomia_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table of written(), once nothing reads it any more."""
    spark, path = df.sparkSession, df._binomia_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def local_or_uri(uri: str):
    """(pyarrow filesystem, path) of a Hadoop-style URI, so that workers reach any shared store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def unused_name(stem: str, columns: list[str]) -> str:
    """A column name that clashes with none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most max_bytes in column (or one row), so that a worker's memory is bounded by one long row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


#: Bytes of a batch that the JVM hands to a worker; Spark's own bound is in rows, which long texts make large.
BATCH_BYTES = 16 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow() in batches of bounded bytes; what a task has freed goes back to the system at its end."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, as idle workers stay alive beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


