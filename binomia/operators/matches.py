"""Search responses to taxon matches, and the decision whether a name is identified by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
TOP = 5
# Addresses and reasons as the results carry them.
TAXON_URL = "https://www.inaturalist.org/taxa/"
NO_MATCHES, SEVERAL, NOT_MATCHED = "No matches in iNaturalist", "Multiple candidate taxa found", "Common name not matched"

TAXONOMY = "struct<" + ",".join(f"`{r}`:string" for r in RANKS) + ">"
MATCH = f"struct<taxon_id:bigint,taxon_name:string,taxon_rank:string,taxonomy:{TAXONOMY},taxon_common_name_en:string,taxon_common_name_loc:string,taxon_matched_name:string,taxon_url:string,score:double,taxon_names:array<string>>"
MATCHES = f"array<{MATCH}>"
RESPONSE = (
    "results array<struct<id:bigint,taxon_id:bigint,name:string,rank:string,matched_name:string,matched_term:string,uri:string,score:double,preferred_common_name:string,"
    "names:array<struct<name:string,locale:string>>,ancestors:array<struct<rank:string,name:string>>>>"
)


def _filled(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def parse_response(response: Column, query: Column, locale: str) -> Column:
    """An array of matches: the first five results in response order."""

    def one(r: Column, q: Column) -> Column:
        name, rank = F.coalesce(r["name"], F.lit("")), F.coalesce(r["rank"], F.lit(""))
        own = F.coalesce(F.nullif(r["id"], F.lit(0)), F.nullif(r["taxon_id"], F.lit(0)), F.lit(0).cast("bigint"))
        common = r["preferred_common_name"]
        common = F.nullif(F.when(F.startswith(F.ltrim(common), F.lit("{")), F.get_json_object(common, "$.name")).otherwise(common), F.lit(""))
        listed = F.coalesce(r["names"], F.from_json(F.lit("[]"), "array<struct<name:string,locale:string>>"))
        local = F.get(F.filter(listed, lambda x: (x["locale"] == locale) & (F.coalesce(x["name"], F.lit("")) != "")), 0)["name"]
        line = F.concat(F.coalesce(r["ancestors"], F.from_json(F.lit("[]"), "array<struct<rank:string,name:string>>")), F.array(F.struct(rank.alias("rank"), name.alias("name"))))
        at = lambda k: F.try_element_at(F.filter(line, lambda x: (x["rank"] == k) & (F.coalesce(x["name"], F.lit("")) != "")), F.lit(-1))["name"].alias(k)
        return F.struct(
            own.alias("taxon_id"), name.alias("taxon_name"), rank.alias("taxon_rank"), F.struct(*[at(k) for k in RANKS]).alias("taxonomy"), common.alias("taxon_common_name_en"),
            F.coalesce(local, common).alias("taxon_common_name_loc"), _filled(r["matched_name"], r["matched_term"], q).alias("taxon_matched_name"),
            F.coalesce(F.nullif(r["uri"], F.lit("")), F.concat(F.lit(TAXON_URL), own.cast("string"))).alias("taxon_url"), F.coalesce(r["score"], F.lit(0.0)).alias("score"),
            F.transform(F.filter(listed, lambda x: F.coalesce(x["name"], F.lit("")) != ""), lambda x: x["name"]).alias("taxon_names"),
        )

    results = F.coalesce(F.from_json(response, RESPONSE)["results"], F.from_json(F.lit("[]"), RESPONSE.removeprefix("results ")))
    return F.transform(F.slice(results, 1, TOP), lambda r: one(r, query)).cast(MATCHES)


def match_names(m: Column) -> Column:
    """The normalised names that a match may be known by."""
    own = F.array(m["taxon_matched_name"], m["taxon_name"], m["taxon_common_name_en"], m["taxon_common_name_loc"])
    return F.array_distinct(F.transform(F.filter(F.concat(own, F.coalesce(m["taxon_names"], F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != ""), normalize))


def is_identified(matches: Column, normalized: Column, lemmatized: Column) -> Column:
    return F.exists(matches, lambda m: F.array_contains(match_names(m), normalized) | F.array_contains(match_names(m), lemmatized))


def reason(matches: Column, identified: Column) -> Column:
    return F.when(identified, "").when(F.size(matches) == 0, NO_MATCHES).when(F.size(matches) > 1, SEVERAL).otherwise(NOT_MATCHED)


def merge_matches(existing: Column, extra: Column) -> Column:
    """The first of each taxon, by score downwards (ties as they came), at most five."""

    def top(all_: Column) -> Column:
        ids = F.transform(all_, lambda m: m["taxon_id"])
        keyed = F.transform(all_, lambda m, i: F.struct((-m["score"]).alias("k"), i.alias("i"), (F.array_position(ids, m["taxon_id"]) - 1 == i).alias("first"), m.alias("m")))
        # score and position order the structs before the rest is looked at
        return F.transform(F.slice(F.array_sort(F.filter(keyed, lambda s: s["first"])), 1, TOP), lambda s: s["m"])

    return F.transform(F.array(F.concat(existing, extra)), top)[0]


def gazetteer_matches(groups: DataFrame, taxa: DataFrame, common: DataFrame, key: list[str]) -> DataFrame:
    """key and matches of groups that need no search: a match for each taxon id with a record, in order; the first scores 1,
    others 0.5. common is preferred_names()."""
    ids = groups.select(*key, "normalized", F.posexplode(F.array_distinct("gazetteer_taxon_ids")).alias("pos", "taxon_id"))
    full = ids.join(taxa, "taxon_id").join(common, "taxon_id", "left")
    rank = lambda k: F.when(F.col("taxon_rank") == k, F.col("taxon_name")).alias(k)
    match = F.struct(
        "taxon_id", "taxon_name", "taxon_rank", F.struct(*[rank(k) for k in RANKS]).alias("taxonomy"), F.col("common_en").alias("taxon_common_name_en"), F.col("common_loc").alias("taxon_common_name_loc"),
        F.col("normalized").alias("taxon_matched_name"), F.concat(F.lit(TAXON_URL), F.col("taxon_id").cast("string")).alias("taxon_url"), F.when(F.col("pos") == 0, 1.0).otherwise(0.5).alias("score"),
        F.array_compact(F.array("common_en", "common_loc")).alias("taxon_names"),
    ).cast(MATCH)
    return full.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", match.alias("m")))), lambda s: s["m"]).alias("matches"))
