"""The operators' queries over whole tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, html_extract, packing, pii, quality_bayes, quality_rules, simhash, tiff, url_filter, warc
from .common import table


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark, warc.archive(table(spark, sf_dir, "pages")))


def quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def byte_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.recoded(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).drop("score")


def cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), digest=True)


def quality_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tiff.read_pages(tiff.stored(table(spark, sf_dir, "documents")))
    size = F.octet_length("samples")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash_near_dedup,
    "op2_warc": warc_roundtrip,
    "op3_quality_rules": quality_divergence,
    "op4_byte_bpe": byte_bpe_roundtrip,
    "op5_pii": personal_data,
    "op6_url_filter": url_verdicts,
    "op7_packing": cost_packing,
    "op8_quality_classifier": quality_posterior,
    "op9_html_extraction": main_text,
    "op10_tiff": tiff_pages,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op2_warc": warc.ORACLE_SQL, "op3_quality_rules": quality_rules.oracle_sql()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
