"""Plain-text files to documents: suffix, size and encoding are checked, legacy Cyrillic encodings recovered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cyrillic_score

# Encodings tried for bytes that are no UTF-8, in order of preference.
LEGACY = ("windows-1251", "KOI8-R", "ISO-8859-5", "x-MacCyrillic")
LEGACY_CONF = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


def decoded(files: DataFrame) -> DataFrame:
    """files (path, length, content) with text and encoding: strict UTF-8, else the legacy encoding with most Cyrillic letters;
    null text where there are none. A byte-order mark and line ends stay as they are."""
    spark = files.sparkSession
    for k, v in LEGACY_CONF.items():
        spark.conf.set(k, v)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    tries = [F.struct(cyrillic_score(F.decode("content", c)).alias("score"), F.lit(-i).alias("rank"), F.decode("content", c).alias("text"), F.lit(c).alias("encoding")) for i, c in enumerate(LEGACY)]
    out = files.withColumn("_valid", valid).withColumn("_best", F.when(~F.col("_valid"), F.array_max(F.array(*tries))))
    text = F.when(F.col("_valid"), F.col("content").cast("string")).when(F.col("_best.score") > 0, F.col("_best.text"))
    return out.withColumn("text", text).withColumn("encoding", F.when(F.col("_valid"), "utf-8").when(F.col("_best.score") > 0, F.col("_best.encoding"))).drop("_valid", "_best")


def read_plain_text(spark: SparkSession, path: str, max_file_size_mb: float = 2.0, on_error: str = "raise") -> DataFrame:
    """(path, length, text, encoding, error) of the .txt files under path. on_error 'raise' fails in the task that meets an
    oversized or undecodable file; 'keep' returns it with its error and null text."""
    limit = int(max_file_size_mb * 1024 * 1024)
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".txt")).select("path", "length", F.when(F.col("length") <= limit, F.col("content")).alias("content"))
    out = decoded(files).drop("content")
    error = F.when(F.col("length") > limit, F.concat(F.lit("File too large: "), F.col("path"))).when(F.col("text").isNull(), F.concat(F.lit("Cannot decode: "), F.col("path")))
    out = out.withColumn("error", error)
    return out.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.col("error")))) if on_error == "raise" else out


LOADERS: dict[str, Callable[..., DataFrame]] = {".txt": read_plain_text}


def load_text(spark: SparkSession, path: str, max_file_size_mb: float = 2.0) -> DataFrame:
    """One file's document by the loader of its suffix."""
    import os

    loader = next((f for s, f in LOADERS.items() if path.lower().endswith(s)), None)
    if loader is None:
        raise ValueError(f"Unsupported file format: {os.path.splitext(path)[1]}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"File not found: {path}")
    found = loader(spark, path, max_file_size_mb, on_error="keep")
    bad = found.where("error is not null").select("error").first()
    if bad:
        raise ValueError(bad[0])
    return found
