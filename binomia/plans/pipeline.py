"""The whole flow over a corpus: extraction, merging, resolution, enrichment, results, summary.

Everything is lazy but the resolved groups, which are written before they are used further (in the folder given, or the
session's checkpoint folder): searches and model calls are then made once, and counters see all groups, not those that a
pushed-down threshold leaves.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lemmatize, normalize
from ..operators import assemble, chunking, gazetteer, latin, llm_names, matches, merge, segment
from ..operators import resolve as resolution
from ..sources.store import ResponseCache
from .config import Config

KEY = ["doc_id", "group_idx"]


@dataclass
class Gazetteer:
    taxa: DataFrame
    names: DataFrame


@dataclass
class Providers:
    """What stands behind the flow: a searcher, a model for mentions and one for alternatives, lemmas as a map column."""

    search: resolution.Searcher
    extractor_llm: llm_names.Llm | None = None
    enricher_llm: llm_names.Llm | None = None
    extractor_prompt: str = ""
    enricher_prompt: str = ""
    lemmas: Column | None = None


@dataclass
class Stages:
    candidates: DataFrame
    groups: DataFrame
    resolved: DataFrame
    results: DataFrame
    summary: DataFrame


def _written(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    spark = df.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='binomia-')}"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def candidates(docs: DataFrame, config: Config, gaz: Gazetteer | None, providers: Providers) -> DataFrame:
    """All extractors' candidates with seq, in the order dictionary, pattern, model."""
    spans = segment.sentences(docs)
    columns = ["doc_id", "source_text", "source_context", "line_number", "start_char", "end_char", "normalized", "lemmatized", "method", "confidence", "gazetteer_taxon_ids"]
    none = F.array().cast("array<bigint>")
    parts = []
    if gaz is not None:
        found = segment.with_context(gazetteer.gazetteer_mentions(docs, gaz.names, config.locale, lemmas=providers.lemmas), spans, docs)
        parts.append(found.withColumn("method", F.lit("gazetteer")))
    known = gaz.taxa.select(F.col("taxon_name").alias("name")) if gaz is not None else None
    found = segment.with_context(latin.with_confidence(latin.latin_mentions(docs), known), spans, docs)
    parts.append(found.withColumn("method", F.lit("latin_regex")).withColumn("gazetteer_taxon_ids", none))
    llm = config.llm_extractor
    if llm and llm.enabled and providers.extractor_llm:
        cut = chunking.chunks(docs, llm.chunk_strategy, llm.min_chunk_words, llm.max_chunk_words)
        found = llm_names.llm_mentions(docs, cut, llm_names.with_locale(providers.extractor_prompt, config.locale), providers.extractor_llm)
        parts.append(found.withColumn("method", F.lit("llm")).withColumn("gazetteer_taxon_ids", none))
    out = None
    for i, p in enumerate(parts):
        if "normalized" not in p.columns:
            p = p.withColumn("normalized", normalize(F.col("source_text"))).withColumn("lemmatized", lemmatize(F.col("source_text"), providers.lemmas))
        order = [F.lit(i).alias("part"), *([F.col("idx"), F.col("pos")] if "idx" in p.columns else [F.col("start_char").alias("idx"), F.col("end_char").alias("pos")])]
        p = p.select(*columns, F.struct(*order).alias("_order"))
        out = p if out is None else out.unionByName(p)
    w = Window.partitionBy("doc_id").orderBy("_order", "source_text")
    return out.withColumn("seq", F.row_number().over(w)).drop("_order")


def analyze(docs: DataFrame, config: Config, gaz: Gazetteer | None, providers: Providers, folder: str | None = None) -> Stages:
    """docs (doc_id, text) through all phases."""
    if gaz is None and not config.degraded_mode:
        raise FileNotFoundError("Gazetteer not found; set degraded_mode to go on without it")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    found = candidates(docs, config, gaz, providers)
    survivors = merge.with_skip(merge.best_of_clusters(found), gaz.taxa if gaz else None)
    grouped = _written(merge.groups(survivors), folder, "groups")

    none = F.array().cast("array<string>")
    searched = resolution.resolve(grouped.where("not skip_resolution"), providers.search, KEY, providers.lemmas)
    if gaz is not None:
        given = grouped.where("skip_resolution")
        own = matches.gazetteer_matches(given, gaz.taxa, gazetteer.preferred_names(gaz.names, config.locale), KEY)
        given = given.join(own, KEY, "left").withColumn("matches", F.coalesce("matches", F.expr(resolution.EMPTY)))
        known = F.coalesce(matches.is_identified(F.col("matches"), F.col("normalized"), F.col("lemmatized")), F.lit(False))
        given = given.withColumn("identified", known).withColumn("reason", matches.reason(F.col("matches"), F.col("identified"))).withColumn("candidate_names", none).withColumn("calls", F.lit(0))
        resolved = given.withColumn("_late", F.lit(0)).unionByName(searched.withColumn("_late", F.lit(1)))
    else:
        resolved = searched.withColumn("_late", F.lit(1))
    resolved = _written(resolved, folder, "resolved")

    llm = config.llm_enricher
    response = f"struct<{llm_names.ALTERNATIVES.replace(' ', ':').replace(',:', ',')}>"
    if llm and llm.enabled and providers.enricher_llm:
        open_groups = resolved.where("not identified")
        first = open_groups.select(*KEY, "normalized", F.get("occurrences", F.lit(0)).alias("o")).join(docs, "doc_id")
        from ..functions.text import find_span

        start, end = find_span(F.col("text"), F.col("o.source_text"))
        located = first.withColumn("start_char", start.cast("int")).withColumn("end_char", end.cast("int")).drop("text").withColumn("fallback", F.col("o.source_context")).drop("o")
        wide = segment.expanded_context(located, segment.sentences(docs)).withColumn("expanded_context", F.coalesce("expanded_context", "fallback"))
        alt = _written(llm_names.alternatives(wide.select(*KEY, "normalized", "expanded_context"), llm_names.with_locale(providers.enricher_prompt, config.locale), providers.enricher_llm, KEY), folder, "alternatives")
        again = resolution.enrich(open_groups, alt, providers.search, KEY).join(alt.select(*KEY, "llm_response"), KEY, "left")
        resolved = _written(resolved.where("identified").withColumn("llm_response", F.lit(None).cast(response)).unionByName(again), folder, "enriched")
    else:
        resolved = resolved.withColumn("llm_response", F.lit(None).cast(response))
    # dictionary groups first, then searched ones, each as first seen
    w = Window.partitionBy("doc_id").orderBy("_late", "group_idx")
    resolved = resolved.withColumn("result_idx", F.row_number().over(w) - 1).drop("_late")
    out = assemble.results(resolved, config.confidence)
    return Stages(found, grouped, resolved, out, assemble.summary(found, grouped, resolved, out))


def cached_search(cache: ResponseCache, ask, locale: str, now: datetime.datetime):
    """A searcher that looks in the cache first, asks for what is missing or expired, and stores the answers.

    ask(queries) gives (query, locale, response_json, created_at)."""

    def search(queries: DataFrame) -> DataFrame:
        queries = _written(queries, None, "queries")
        held = cache.get(now).where(F.col("locale") == locale)
        missing = queries.join(held.select("query"), "query", "left_anti")
        cache.put(_written(ask(missing), None, "responses"))
        both = cache.table().where(F.col("locale") == locale)
        return queries.join(both, "query").select("query", matches.parse_response(F.col("response_json"), F.col("query"), locale).alias("matches"))

    return search


# -- estimate ------------------------------------------------------------------------------------------------------------

SEARCH_SECONDS, LLM_SECONDS = 1.0, 2.0


def estimate(docs: DataFrame, config: Config, gaz: Gazetteer | None) -> DataFrame:
    """A row for each document: sentences, chunks, llm_calls, gazetteer_candidates, regex_candidates, unique_candidates,
    api_calls, estimated_seconds; nothing is searched or asked."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    counted = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    llm = config.llm_extractor
    parts = [counted(segment.sentences(docs), "sentences"), counted(latin.latin_mentions(docs), "regex_candidates")]
    parts.append(counted(chunking.chunks(docs, llm.chunk_strategy, llm.min_chunk_words, llm.max_chunk_words), "chunks") if llm and llm.enabled else docs.select("doc_id", F.lit(0).alias("chunks")))
    if gaz is not None:
        parts.append(counted(gazetteer.gazetteer_mentions(docs, gaz.names, config.locale), "gazetteer_candidates"))
    else:
        parts.append(docs.select("doc_id", F.lit(0).alias("gazetteer_candidates")))
    out = docs.select("doc_id")
    for p in parts:
        out = out.join(p, "doc_id", "left")
    out = out.fillna(0)
    out = out.withColumn("llm_calls", F.col("chunks")).withColumn("unique_candidates", F.greatest(F.col("gazetteer_candidates") + F.col("regex_candidates"), F.lit(1)))
    out = out.withColumn("api_calls", F.greatest(F.col("unique_candidates") - F.col("gazetteer_candidates"), F.lit(0)))
    return out.withColumn("estimated_seconds", F.col("api_calls") * SEARCH_SECONDS + F.col("llm_calls") * LLM_SECONDS)


# -- checkpoints and events ----------------------------------------------------------------------------------------------


def checkpoint_key(text: str, config: Config) -> str:
    return hashlib.sha256(f"{text}\n{json.dumps(asdict(config), sort_keys=True, ensure_ascii=False)}".encode()).hexdigest()


def checkpoint_keys(docs: DataFrame, config: Config) -> DataFrame:
    """docs with key: what a stored stage is found by."""
    return docs.withColumn("key", F.sha2(F.concat("text", F.lit("\n" + json.dumps(asdict(config), sort_keys=True, ensure_ascii=False))), 256))


class StageStore:
    """Results by checkpoint key, as Parquet under a folder: load what is done, run the rest, save it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def pending(self, keyed: DataFrame) -> DataFrame:
        return keyed.join(self.spark.read.parquet(self.path).select("key").distinct(), "key", "left_anti") if self._exists() else keyed

    def save(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def load(self, keyed: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self.path).join(keyed.select("key").distinct(), "key", "left_semi")

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def process(docs: DataFrame, config: Config, gaz: Gazetteer | None, providers: Providers, folder: str | None = None) -> Iterator[dict]:
    """The run as events for a driver that shows progress: phases, each result, and the summary at the end."""
    import time

    began = time.monotonic()
    yield {"event": "phase_started", "phase": "extraction"}
    stages = analyze(docs, config, gaz, providers, folder)
    for phase in ("merge", "resolution", "enrichment", "assembly"):
        yield {"event": "phase_started", "phase": phase}
    for row in stages.results.orderBy("doc_id", "result_idx").toLocalIterator():
        yield {"event": "result_ready", "result": row.asDict(recursive=True)}
    yield {"event": "finished", "summary": stages.summary.first().asDict() | {"total_time": time.monotonic() - began}}
