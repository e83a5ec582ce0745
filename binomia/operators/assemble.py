"""Resolved groups to results, in both output forms, and the run's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1.0"


def results(resolved: DataFrame, threshold: float) -> DataFrame:
    """Groups whose confidence reaches the threshold, with source_text, count and at most five matches."""
    out = resolved.where(F.col("confidence") >= threshold)
    first = F.get("occurrences", F.lit(0))["source_text"]
    return out.withColumn("source_text", F.coalesce(first, F.col("normalized"))).withColumn("count", F.size("occurrences")).withColumn("matches", F.slice("matches", 1, 5))


def per_occurrence(found: DataFrame) -> DataFrame:
    """A row for each occurrence instead of each name."""
    rest = [c for c in found.columns if c not in ("occurrences", "count", "source_text")]
    return found.select(*rest, F.explode("occurrences").alias("o")).select("o.*", *rest)


def summary(candidates: DataFrame, groups: DataFrame, resolved: DataFrame, found: DataFrame) -> DataFrame:
    """One row: candidates before merging, unique names, (un)identified results, skipped groups, search calls."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(candidates, "total_candidates"), count(groups, "unique_candidates"), count(groups.where("skip_resolution"), "skipped_resolution"),
        found.agg(F.count_if("identified").alias("identified_count"), F.count_if(~F.col("identified")).alias("unidentified_count")), resolved.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("search_calls")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def to_json(found: DataFrame, full: bool = False) -> str:
    """The versioned document, pretty-printed; for a result that one reader wants whole, row by row from the cluster."""
    import json

    shown = per_occurrence(found) if full else found
    hidden = {"doc_id", "group_idx", "lemmatized", "normalized", "gazetteer_taxon_ids", "skip_resolution", "calls", "result_idx", "method", "confidence"}
    out = []
    for row in shown.toLocalIterator():
        x = row.asDict(recursive=True)
        for m in x["matches"]:
            m.pop("taxon_names", None)
        out.append({"source_text": x["source_text"], "extraction_method": x["method"], "extraction_confidence": x["confidence"]} | {k: v for k, v in x.items() if k not in hidden})
    return json.dumps({"version": VERSION, "results": out}, ensure_ascii=False, indent=2)
