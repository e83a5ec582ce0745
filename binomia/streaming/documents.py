"""Documents that keep arriving: extraction per micro-batch, and each distinct query once over all batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import search_variants


def extract_stream(docs: DataFrame, extract: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs extract over each micro-batch of docs; a batch writes a folder of its own, so a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_queries(names: DataFrame, locale: str, event_time: str, watermark: str = "7 days") -> DataFrame:
    """Distinct (query, locale) of streamed names (normalized, event time), forgotten after the watermark as the cache is."""
    asked = names.withWatermark(event_time, watermark).select(F.explode(search_variants(F.col("normalized"))).alias("query"), F.lit(locale).alias("locale"), event_time)
    return asked.dropDuplicatesWithinWatermark(["query", "locale"])
