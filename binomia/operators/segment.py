"""Tokens and sentences with positions, and the sentence (or line) around a mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import pattern_spans
from ..functions.text import line_at

#: A word, or one character that is neither word nor white space.
TOKEN = r"(?U)\w+|[^\s\w]"
#: From a non-space up to an end mark (with closing quotes or brackets) before white space, or to the text's end.
SENTENCE = r"(?Us)(?=\S)(?:.*?[.!?…]+[\"'»”’)\]]*(?=\s)|.*\S)"


def tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, i, token, start_char, end_char), i from 1."""
    found = pattern_spans(docs, TOKEN, text_col, id_col)
    return found.select(id_col, "i", F.col("source_text").alias("token"), "start_char", "end_char")


def sentences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, sent_idx, start, end, text), sent_idx from 0; white space lies outside."""
    found = pattern_spans(docs, SENTENCE, text_col, id_col)
    return found.select(id_col, (F.col("i") - 1).alias("sent_idx"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.col("source_text").alias("text"))


def _held(mentions: DataFrame, spans: DataFrame, at: Column, text: str, id_col: str) -> DataFrame:
    """mentions with _held: the column text of the span that holds position at, else null.

    Spans do not overlap, so the one that began last is the only one that can hold a position: a running last-value over
    both, ordered by position, replaces a range join.
    """
    order = Window.partitionBy(id_col).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    names = mentions.columns
    marks = spans.select(F.col(id_col), F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("end"), F.col(text).alias("text")).alias("_s"), F.lit(None).cast(mentions.select(F.struct(*names)).schema[0].dataType).alias("_m"))
    own = mentions.select(F.col(id_col), at.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_s"].dataType).alias("_s"), F.struct(*names).alias("_m"))
    met = marks.unionByName(own).withColumn("_s", F.last("_s", ignorenulls=True).over(order)).where("_kind = 1")
    return met.select("_m.*", F.when(F.col("_s.end") > F.col("_at"), F.col("_s.text")).alias("_held"))


def with_context(mentions: DataFrame, spans: DataFrame, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """mentions with source_context: the sentence that holds start_char, else the line."""
    out = _held(mentions, spans, F.col("start_char"), "text", id_col).withColumnRenamed("_held", "source_context")
    lines = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    missing = out.where(F.col("source_context").isNull()).drop("source_context").join(lines, id_col).withColumn("source_context", line_at(F.col("_text"), F.col("line_number"))).drop("_text")
    return out.where(F.col("source_context").isNotNull()).unionByName(missing)


def expanded_context(mentions: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """mentions with expanded_context: its sentence with the one before and after, joined by spaces; null if in none.

    The sentence is the one that holds start_char, or else the one that holds the last character: never a later one than
    any other that holds an end of the mention.
    """
    w = Window.partitionBy(id_col).orderBy("sent_idx")
    around = spans.withColumn("_wide", F.array_join(F.filter(F.array(F.lag("text").over(w), F.col("text"), F.lead("text").over(w)), lambda x: x.isNotNull()), " "))
    first = _held(mentions, around, F.col("start_char"), "_wide", id_col).withColumnRenamed("_held", "expanded_context")
    rest = first.where(F.col("expanded_context").isNull()).drop("expanded_context")
    by_end = _held(rest, around, F.col("end_char") - 1, "_wide", id_col).withColumnRenamed("_held", "expanded_context")
    return first.where(F.col("expanded_context").isNotNull()).unionByName(by_end)
