"""Command line: process a file or folder, or estimate what it would cost."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import assemble
from ..sources import providers, store, text_files
from . import pipeline
from .config import Config, load_config

LINES = ("sentences", "chunks", "llm_calls", "gazetteer_candidates", "regex_candidates", "unique_candidates", "api_calls")


def _log(as_json: bool) -> logging.Logger:
    handler = logging.StreamHandler()

    class Json(logging.Formatter):
        def format(self, record):
            return json.dumps({"timestamp": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname.lower(), "event": record.getMessage()}, ensure_ascii=False)

    handler.setFormatter(Json() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(message)s", "%Y-%m-%dT%H:%M:%S"))
    log = logging.getLogger("binomia")
    log.handlers, log.propagate = [handler], False
    log.setLevel(logging.INFO)
    return log


def _open(spark: SparkSession, config: Config, log: logging.Logger) -> pipeline.Gazetteer | None:
    try:
        return pipeline.Gazetteer(*store.open_gazetteer(spark, config.gazetteer_path))
    except Exception as e:
        if not config.degraded_mode:
            raise FileNotFoundError(f"Gazetteer not found: {config.gazetteer_path}") from e if "PATH_NOT_FOUND" in str(e) else e
        log.warning("gazetteer is missing, going on without: %s", config.gazetteer_path)
        return None


def _providers(spark: SparkSession, config: Config) -> pipeline.Providers:
    import datetime

    s = config.inaturalist
    ask = lambda queries: providers.http_responses(queries, config.locale, s.base_url, config.user_agent, s.timeout, s.max_retries, s.rate_limit, s.burst_limit)
    if s.cache_enabled:
        search = pipeline.cached_search(store.ResponseCache(spark, s.cache_path, s.cache_ttl_days), ask, config.locale, datetime.datetime.now())
    else:
        search = lambda queries: providers.table_searcher(pipeline._written(ask(queries), None, "responses"), config.locale)(queries)
    models, prompts = [], []
    for c in (config.llm_extractor, config.llm_enricher):
        on = c is not None and c.enabled
        text = open(c.prompt_file, encoding="utf-8").read() if on else ""
        key = os.environ.get({"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}.get(c.provider, ""), "") if on else ""
        models.append(providers.http_llm(c.provider, c.model, text.replace("{{locale}}", config.locale), c.url, key, c.timeout) if on else None)
        prompts.append(text)
    return pipeline.Providers(search, *models, *prompts)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, made: pipeline.Providers | None = None) -> int:
    parser = argparse.ArgumentParser(prog="binomia")
    parser.add_argument("--config", default="binomia.config.json")
    parser.add_argument("--json-logs", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("process")
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--all-occurrences", action="store_true")
    commands.add_parser("dry-run").add_argument("input")
    args = parser.parse_args(argv)
    log = _log(args.json_logs or os.environ.get("LOG_FORMAT") == "json")
    try:
        config = load_config(args.config)
        spark = spark or SparkSession.builder.appName("binomia").getOrCreate()
        docs = text_files.load_text(spark, args.input, config.max_file_size_mb).select(F.xxhash64("path").alias("doc_id"), "text")
        gaz = _open(spark, config, log)
        if args.command == "dry-run":
            row = pipeline.estimate(docs, config, gaz).first().asDict()
            for name in LINES:
                print(f"{name.replace('_', ' ')}: {row[name]}", file=sys.stderr)
            print(f"estimated seconds: {row['estimated_seconds']:.1f}", file=sys.stderr)
            return 0
        stages = pipeline.analyze(docs, config, gaz, made or _providers(spark, config))
        text = assemble.to_json(stages.results.orderBy("doc_id", "result_idx"), args.all_occurrences)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
        s = stages.summary.first()
        print(f"Done - identified {s['identified_count']}, unidentified {s['unidentified_count']}, skipped search {s['skipped_resolution']}, searches {s['search_calls']}", file=sys.stderr)
        return 0
    except Exception as e:
        log.error("%s: %s", type(e).__name__, e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
