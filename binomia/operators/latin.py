"""Latin binomials by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import pattern_spans

BINOMIAL = r"(?U)\b[A-Z][a-z]+ [a-z]{2,}(?: [a-z]{2,})?\b"
# Phrases that look like binomials and are none.
STOP_PHRASES = ("et cetera", "ad libitum", "in situ", "ex vivo", "de facto", "pro rata", "per se", "ab initio", "status quo", "modus operandi", "alma mater", "anno domini")
# Titles after which (and a full stop) a binomial is a person.
TITLES = ("mr", "dr", "prof", "von", "van")
KNOWN, UNKNOWN = 0.9, 0.7


def latin_mentions(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", stop_phrases: tuple[str, ...] = STOP_PHRASES) -> DataFrame:
    """(doc_id, source_text, start_char, end_char, line_number): greedy matches whose words all have three letters, that are
    no stop phrase and do not follow a title with a full stop."""
    found = pattern_spans(docs, BINOMIAL, text_col, id_col, before=True)
    # Read backwards, so that the pattern is anchored and never scans. A match's first word bounds the word before the next.
    title = F.reverse(F.regexp_extract(F.reverse("before"), r"(?U)^\s*\.[\s.]*(\w+)", 1))
    kept = found.where(
        F.forall(F.split("source_text", " "), lambda w: F.length(w) >= 3)
        & ~F.lower("source_text").isin(*(stop_phrases or STOP_PHRASES))
        & ~F.lower(title).isin(*TITLES)
    )
    return kept.select(id_col, "source_text", "start_char", "end_char", "line_number")


def with_confidence(mentions: DataFrame, known_names: DataFrame | None) -> DataFrame:
    """mentions with confidence: higher where the whole lower-cased match is a known name (column `name`)."""
    if known_names is None:
        return mentions.withColumn("confidence", F.lit(UNKNOWN))
    known = known_names.select(F.lower("name").alias("_name")).distinct().withColumn("_known", F.lit(True))
    out = mentions.join(known, F.lower("source_text") == F.col("_name"), "left")
    return out.withColumn("confidence", F.when(F.col("_known"), KNOWN).otherwise(UNKNOWN)).drop("_name", "_known")
