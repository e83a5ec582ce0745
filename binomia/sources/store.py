"""The gazetteer's tables and the cache of search responses, as Parquet with a versioned meta table."""

from __future__ import annotations

import datetime
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
TAXA = "taxon_id bigint, taxon_name string, taxon_rank string, ancestry string"
NAMES = "id bigint, taxon_id bigint, name string, name_normalized string, name_lemmatized string, locale string, is_preferred boolean, lexicon string"
TAGS = "taxon_id bigint, tag string"
CACHE = "query string, locale string, response_json string, created_at timestamp"


def _check_version(spark: SparkSession, path: str, what: str) -> None:
    row = spark.read.parquet(f"{path}/meta.parquet").first()
    if row is None or row["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"{what} schema version mismatch: expected {SCHEMA_VERSION}, got {row and row['schema_version']}")


def _write_version(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(SCHEMA_VERSION,)], "schema_version int").write.mode("overwrite").parquet(f"{path}/meta.parquet")


def write_gazetteer(path: str, taxa: DataFrame, names: DataFrame) -> None:
    """Both tables; names are sorted by locale within files, so that a locale's scan skips row groups."""
    taxa.write.mode("overwrite").parquet(f"{path}/taxa.parquet")
    names.repartition("locale").sortWithinPartitions("locale", "name_normalized").write.mode("overwrite").parquet(f"{path}/common_names.parquet")
    _write_version(taxa.sparkSession, path)


def open_gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(taxa, names)."""
    _check_version(spark, path, "Gazetteer")
    return spark.read.parquet(f"{path}/taxa.parquet"), spark.read.parquet(f"{path}/common_names.parquet")


def import_sqlite(spark: SparkSession, db: str, path: str) -> None:
    """An existing SQLite gazetteer, read on the driver in blocks, as Parquet tables."""
    with sqlite3.connect(f"file:{db}?mode=ro", uri=True) as c:
        version = c.execute("PRAGMA user_version").fetchone()[0]
        if version != SCHEMA_VERSION:
            raise ValueError(f"Gazetteer schema version mismatch: expected {SCHEMA_VERSION}, got {version}")
        for name, ddl in (("taxa", TAXA), ("common_names", NAMES)):
            columns = [x.strip().split(" ")[0] for x in ddl.split(",")]
            cursor = c.execute(f"SELECT {', '.join(columns)} FROM {name} ORDER BY 1")
            mode = "overwrite"
            while (rows := cursor.fetchmany(50_000)) or mode == "overwrite":
                rows = [tuple(bool(v) if k == "is_preferred" and v is not None else v for k, v in zip(columns, r, strict=True)) for r in rows]
                spark.createDataFrame(rows, ddl).write.mode(mode).parquet(f"{path}/{name}.parquet")
                mode = "append"
    _write_version(spark, path)


def taxon_ids(names: DataFrame, name_normalized: str, locale: str) -> DataFrame:
    """(taxon_id) of a point lookup, with duplicates."""
    return names.where((F.col("name_normalized") == name_normalized) & (F.col("locale") == locale)).select("taxon_id")


# -- response cache ------------------------------------------------------------------------------------------------------


def fresh(cache: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """The responses that are not older than ttl_days at `now`."""
    return cache.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(ttl_days)))


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with new rows in place of those of the same (query, locale); the latest wins, new before old."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("query", "locale").orderBy(F.desc("created_at"), F.desc("_new"), F.desc("response_json"))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


class ResponseCache:
    """A cache table under path: versions of it are written side by side and switched by the meta table."""

    def __init__(self, spark: SparkSession, path: str, ttl_days: int = 7):
        self.spark, self.path, self.ttl_days = spark, path.rstrip("/"), ttl_days
        try:
            row = spark.read.parquet(f"{self.path}/meta.parquet").orderBy(F.desc("version")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        if row is not None and row["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"Cache schema version mismatch: expected {SCHEMA_VERSION}, got {row['schema_version']}")
        self.version = row["version"] if row else 0

    def table(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], CACHE)
        return self.spark.read.parquet(f"{self.path}/v{self.version}.parquet")

    def get(self, now: datetime.datetime) -> DataFrame:
        return fresh(self.table(), F.lit(now), self.ttl_days)

    def put(self, new: DataFrame) -> None:
        upserted(self.table(), new).write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}.parquet")
        self.version += 1
        self.spark.createDataFrame([(SCHEMA_VERSION, self.version)], "schema_version int, version int").write.mode("append").parquet(f"{self.path}/meta.parquet")


# -- building ------------------------------------------------------------------------------------------------------------


def missing_taxa(checklist: DataFrame, taxa: DataFrame) -> DataFrame:
    """The checklist rows (taxon_name) that the gazetteer lacks: where a build resumes."""
    return checklist.join(taxa.select("taxon_name"), "taxon_name", "left_anti")


def build(checklist: DataFrame, responses: DataFrame, locales: list[str], tag: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(taxa, names, tags) from a checklist (taxon_name) and search responses (query, response_json): the result whose name
    is the query, its names in the given locales."""
    from ..functions.text import lemmatize, normalize
    from ..operators.matches import RESPONSE

    parsed = responses.select("query", F.explode(F.from_json("response_json", RESPONSE)["results"]).alias("r")).where("r.name = query and coalesce(r.id, r.taxon_id, 0) <> 0")
    met = checklist.select(F.col("taxon_name").alias("query")).distinct().join(parsed, "query").select(F.coalesce(F.nullif("r.id", F.lit(0)), "r.taxon_id").alias("taxon_id"), "r")
    one = met.groupBy("taxon_id").agg(F.first("r").alias("r"))
    taxa = one.select("taxon_id", F.col("r.name").alias("taxon_name"), F.col("r.rank").alias("taxon_rank"), F.lit(None).cast("string").alias("ancestry"))
    listed = one.select("taxon_id", F.posexplode("r.names").alias("pos", "n")).where(F.col("n.locale").isin(locales) & (F.coalesce(F.col("n.name"), F.lit("")) != ""))
    first = Window.partitionBy("taxon_id", "n.locale").orderBy("pos")
    names = listed.select(
        F.xxhash64("taxon_id", "pos").alias("id"), "taxon_id", F.col("n.name").alias("name"), normalize(F.col("n.name")).alias("name_normalized"), lemmatize(F.col("n.name")).alias("name_lemmatized"),
        F.col("n.locale").alias("locale"), (F.row_number().over(first) == 1).alias("is_preferred"), F.lit(None).cast("string").alias("lexicon"),
    )
    tags = taxa.select("taxon_id", F.lit(tag).cast("string").alias("tag")).where("tag is not null")
    return taxa, names, tags
