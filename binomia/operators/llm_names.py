"""Names from a language model's replies: mentions in chunks, alternatives for unresolved groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filter_names, find_span, line_at, line_number, parse_json, strip_space
from ..sources.providers import prompt_key

Llm = Callable[[DataFrame], DataFrame]  # (prompt_key, user) -> (prompt_key, raw)
CONFIDENCE = 0.6
MENTIONS = "candidates array<struct<name:string,context:string>>"
ALTERNATIVES = "common_names_loc array<string>, common_names_en array<string>, latin_names array<string>"


def with_locale(template: str, locale: str) -> str:
    return template.replace("{{locale}}", locale)


def asked(rows: DataFrame, user, system: str, llm: Llm) -> DataFrame:
    """rows with raw; each distinct prompt is sent once."""
    own = rows.withColumn("_user", user).withColumn("_key", prompt_key(system, F.col("_user")))
    replies = llm(own.select(F.col("_key").alias("prompt_key"), F.col("_user").alias("user")).dropDuplicates(["prompt_key"]))
    return own.join(replies.select(F.col("prompt_key").alias("_key"), "raw"), "_key", "left").drop("_key", "_user")


def llm_mentions(docs: DataFrame, chunk_rows: DataFrame, system: str, llm: Llm, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Candidates that a model names in chunks (doc_id, idx, chunk); spans are first occurrences in the whole text."""
    replies = asked(chunk_rows, F.col("chunk"), system, llm)
    items = replies.select(id_col, "idx", F.posexplode(parse_json(F.col("raw"), MENTIONS, "candidates")["candidates"]).alias("pos", "c"))
    named = items.select(id_col, "idx", "pos", strip_space(F.col("c.name")).alias("source_text"), strip_space(F.coalesce("c.context", F.lit(""))).alias("_context")).where("source_text <> ''")
    out = named.join(docs.select(F.col(id_col), F.col(text_col).alias("_text")), id_col)
    start, end = find_span(F.col("_text"), F.col("source_text"))
    out = out.withColumn("start_char", start.cast("int")).withColumn("end_char", end.cast("int")).withColumn("line_number", line_number(F.col("_text"), F.col("start_char")))
    out = out.withColumn("source_context", F.coalesce(F.nullif("_context", F.lit("")), line_at(F.col("_text"), F.col("line_number"))))
    return out.select(id_col, "idx", "pos", "source_text", "source_context", "line_number", "start_char", "end_char", F.lit(CONFIDENCE).alias("confidence"))


def alternatives(groups: DataFrame, system: str, llm: Llm, key: list[str]) -> DataFrame:
    """key, llm_response (names by kind, empty where the reply is none), names (all, in order)."""
    user = F.concat(F.lit("Candidate: "), F.col("normalized"), F.lit("\nContext: "), F.coalesce("expanded_context", F.lit("")))
    replies = asked(groups, user, system, llm).withColumn("_p", parse_json(F.col("raw"), ALTERNATIVES, "common_names_loc"))
    response = F.struct(filter_names(F.col("_p.common_names_loc"), F.col("normalized")).alias("common_names_loc"), filter_names(F.col("_p.common_names_en")).alias("common_names_en"), filter_names(F.col("_p.latin_names")).alias("latin_names"))
    return replies.select(*key, response.alias("llm_response")).withColumn("names", F.concat("llm_response.common_names_loc", "llm_response.common_names_en", "llm_response.latin_names"))
