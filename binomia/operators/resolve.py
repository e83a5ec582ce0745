"""Search of the groups' names: each distinct query once for the whole corpus, then a fold per group that stops where the
name is identified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_variants
from .matches import MATCHES, is_identified, merge_matches, reason

Searcher = Callable[[DataFrame], DataFrame]  # (query) -> (query, matches)
EMPTY = f"from_json('[]', '{MATCHES}')"


def _lookup(rows: DataFrame, search: Searcher) -> DataFrame:
    found = search(rows.select("query").distinct())
    return rows.join(found, "query", "left").withColumn("matches", F.coalesce("matches", F.expr(EMPTY)))


def resolve(groups: DataFrame, search: Searcher, key: list[str], lemmas: Column | None = None) -> DataFrame:
    """groups with matches, identified, reason, candidate_names, calls (searches up to and with the one that identified)."""
    variants = groups.withColumn("_variants", search_variants(F.col("normalized"), lemmas))
    asked = variants.select(*key, F.posexplode("_variants").alias("idx", "query"))
    steps = _lookup(asked, search).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("idx", "matches"))).alias("_steps"))
    out = variants.join(steps, key, "left")
    start = F.struct(F.expr(EMPTY).alias("ms"), F.lit(0).alias("calls"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        ms = merge_matches(a["ms"], s["matches"])
        new = F.transform(F.array(ms), lambda x: F.struct(x.alias("ms"), (a["calls"] + 1).alias("calls"), F.coalesce(is_identified(x, F.col("normalized"), F.col("lemmatized")), F.lit(False)).alias("done")))[0]
        return F.when(a["done"], a).otherwise(new)

    none = F.expr(f"from_json('[]', 'array<struct<idx:int,matches:{MATCHES}>>')")
    out = out.withColumn("_r", F.aggregate(F.coalesce("_steps", none), start, step))
    out = out.withColumn("matches", F.col("_r.ms")).withColumn("identified", F.col("_r.done")).withColumn("calls", F.col("_r.calls"))
    out = out.withColumn("reason", reason(F.col("matches"), F.col("identified")))
    return out.withColumn("candidate_names", F.when(F.col("identified"), F.array().cast("array<string>")).otherwise(F.col("_variants"))).drop("_variants", "_steps", "_r")


def enrich(resolved: DataFrame, alternatives: DataFrame, search: Searcher, key: list[str]) -> DataFrame:
    """resolved, its unidentified groups searched once more by their alternative names (key, names array).

    Names already tried are left out; all others are searched; the matches join those at hand.
    """
    from ..functions.text import normalize

    alt = alternatives.select(*key, F.array_distinct(F.filter(F.transform("names", normalize), lambda x: x != "")).alias("_alt"))
    own = resolved.join(alt, key, "left").withColumn("_new", F.when(~F.col("identified"), F.array_except(F.coalesce("_alt", F.array().cast("array<string>")), F.col("candidate_names"))))
    asked = own.select(*key, F.posexplode("_new").alias("idx", "query"))
    extra = _lookup(asked, search).groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "matches"))), lambda s: s["matches"])).alias("_extra"))
    out = own.join(extra, key, "left").withColumn("_has", F.coalesce(F.size("_new") > 0, F.lit(False)))
    out = out.withColumn("matches", F.when(F.col("_has"), merge_matches(F.col("matches"), F.coalesce("_extra", F.expr(EMPTY)))).otherwise(F.col("matches")))
    now = F.when(F.col("_has"), F.coalesce(is_identified(F.col("matches"), F.col("normalized"), F.col("lemmatized")), F.lit(False))).otherwise(F.col("identified"))
    out = out.withColumn("identified", now).withColumn("calls", F.col("calls") + F.greatest(F.size(F.coalesce("_new", F.array().cast("array<string>"))), F.lit(0)))
    out = out.withColumn("reason", reason(F.col("matches"), F.col("identified")))
    tried = F.when(F.col("identified"), F.array().cast("array<string>")).otherwise(F.concat(F.col("candidate_names"), F.coalesce("_new", F.array().cast("array<string>"))))
    return out.withColumn("candidate_names", tried).drop("_alt", "_new", "_extra", "_has")
