"""Regular-expression matches with positions, without a UDF and within the row.

Matches are marked in the text, the text is split at the marks, and positions are prefix sums of segment lengths over the
row's own array: nothing is shuffled, and ids need not be there or differ. The sums double their reach in each step
(n log n), as growing an array by one element at a time would be quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\x01", "\x02"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """The running sums of an array of longs, each including its own element."""

    def step(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0).cast("long")))

    def sums(own: Column) -> Column:
        turns = F.when(F.size(own) > 1, F.sequence(F.lit(0), F.length(F.bin(F.size(own) - 1)) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(turns, own, step)

    return let(values, sums)


def pattern_spans(docs: DataFrame, pattern: str, text_col: str = "text", id_col: str = "doc_id", before: bool = False) -> DataFrame:
    """(doc_id, i, source_text, start_char, end_char, line_number[, before]): non-overlapping matches, i from 1 in order.

    pattern has no groups but (?:...). before is the text between the match and the start of the match before it (or of
    the text). A mark in the text counts as a control character that the pattern sees, and comes out as it was. Null texts
    have no matches; rows with null or repeated ids are rows of their own.
    """
    text = F.col(text_col)
    clean = F.translate(text, OPEN + CLOSE, "\x03\x03")
    segments = F.split(F.regexp_replace(clean, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN)
    # Lengths and line ends in one long each: their sums stay below 2^31.
    sizes = lambda bare: F.transform(bare, lambda s: F.call_function("shiftleft", F.length(s).cast("long"), F.lit(32)) + (F.length(s) - F.length(F.translate(s, "\n", ""))))
    has_marks = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))

    def rows(segs: Column, bare: Column, sums: Column, marked: Column) -> Column:
        def one(i: Column) -> Column:
            at = F.get(sums, i - 1)
            start = F.call_function("shiftright", at, F.lit(32)).cast("int")
            found = F.substring_index(F.get(segs, i), CLOSE, 1)
            fields = [
                i.alias("i"),
                # marks that the text itself has are rare; there a match is cut from the text
                F.when(marked, F.substring(text, start + 1, F.length(found))).otherwise(found).alias("source_text"),
                start.alias("start_char"),
                (start + F.length(found)).alias("end_char"),
                (1 + at.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("line_number"),
            ]
            return F.struct(*fields, *([F.get(bare, i - 1).alias("before")] if before else []))

        return F.transform(F.sequence(F.lit(1), F.size(segs) - 1), one)

    def found(segs: Column) -> Column:
        return let(F.transform(segs, lambda s: F.translate(s, CLOSE, "")), lambda bare: let(prefix_sums(sizes(bare)), lambda sums: let(has_marks, lambda marked: rows(segs, bare, sums, marked))))

    all_ = let(segments, lambda segs: F.when(F.size(segs) > 1, found(segs)))
    return docs.where(text.isNotNull()).select(F.col(id_col), F.explode(all_).alias("s")).select(id_col, "s.*")
