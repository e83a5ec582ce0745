"""Dictionary phrases: name tables, and all token-aligned hits in texts by a join on n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lemmatize
from .segment import TOKEN, tokens

JOINER = "\x01"
#: Phrases that are broadcast at most; a larger dictionary is joined by a shuffle.
BROADCAST_PHRASES = 500_000


def locale_mappings(names: DataFrame, column: str) -> DataFrame:
    """(locale, name, taxon_ids): ids in table order with duplicates, for every locale; null and empty names are left out."""
    own = names.where(F.coalesce(F.col(column), F.lit("")) != "")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("id", "taxon_id"))), lambda s: s["taxon_id"])
    return own.groupBy("locale", F.col(column).alias("name")).agg(ids.alias("taxon_ids"))


def name_mappings(names: DataFrame, locale: str, column: str) -> DataFrame:
    """(name, taxon_ids): locale_mappings() of one locale."""
    return locale_mappings(names.where(F.col("locale") == locale), column).select("name", "taxon_ids")


def preferred_names(names: DataFrame, locale: str) -> DataFrame:
    """(taxon_id, common_en, common_loc): the first preferred name (if not empty), else the first, by locale."""

    def pick(where: Column) -> Column:
        first_preferred = F.min_by("name", F.when(where & F.col("is_preferred"), F.col("id")))
        return F.coalesce(F.nullif(first_preferred, F.lit("")), F.min_by("name", F.when(where, F.col("id"))))

    return names.where(F.col("locale").isin(locale, "en")).groupBy("taxon_id").agg(pick(F.col("locale") == "en").alias("common_en"), pick(F.col("locale") == locale).alias("common_loc"))


def full_records(taxa: DataFrame, names: DataFrame, locale: str) -> DataFrame:
    """taxa with common_en and common_loc."""
    return taxa.join(preferred_names(names, locale), "taxon_id", "left")


def phrase_key(c: Column) -> Column:
    """A phrase as its lower-cased tokens."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x)), JOINER)


def phrases(*mappings: DataFrame) -> DataFrame:
    """(key, n): distinct token keys of all names, with their token counts."""
    both = mappings[0].select("name")
    for m in mappings[1:]:
        both = both.union(m.select("name"))
    keyed = both.distinct().select(phrase_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    return keyed.withColumn("n", F.size(F.split("key", JOINER)))


def phrase_hits(docs: DataFrame, dictionary: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_tokens: int | None = None) -> DataFrame:
    """(doc_id, start_char, end_char, key): all hits, nested ones too. max_tokens, if not given, is read from dictionary."""
    size = dictionary.agg(F.max("n").alias("longest"), F.count("*").alias("n")).first()
    longest = max_tokens or size["longest"] or 0
    toks = tokens(docs, text_col, id_col).withColumn("w", F.lower("token"))
    w = Window.partitionBy(id_col).orderBy("i")
    grams = []
    parts, key = [], None
    for k in range(max(longest, 1)):
        parts.append(F.lead("w", k).over(w) if k else F.col("w"))
        toks = toks.withColumn(f"_w{k}", parts[-1]).withColumn(f"_e{k}", F.lead("end_char", k).over(w) if k else F.col("end_char"))
        key = F.concat(key, F.lit(JOINER), F.col(f"_w{k}")) if k else F.col("_w0")
        grams.append(F.struct(key.alias("key"), F.col(f"_e{k}").alias("end_char")))
    hits = toks.select(id_col, "start_char", F.explode(F.array(*grams)).alias("g")).select(id_col, "start_char", "g.end_char", "g.key").where("key is not null and end_char is not null")
    # The n-grams outgrow any estimate from the texts' files, so neither side's broadcast is left to estimates.
    keys = dictionary.select("key")
    keys = F.broadcast(keys) if size["n"] <= BROADCAST_PHRASES else keys.hint("merge")
    return hits.join(keys, "key").select(id_col, "start_char", "end_char", "key")


def gazetteer_mentions(docs: DataFrame, names: DataFrame, locale: str, text_col: str = "text", id_col: str = "doc_id", lemmas: Column | None = None) -> DataFrame:
    """Candidates from a dictionary: an exact normalised name first (1.0, or 0.8 with several ids), else a lemma (0.9, 0.7)."""
    exact, lemma = name_mappings(names, locale, "name_normalized"), name_mappings(names, locale, "name_lemmatized")
    hits = phrase_hits(docs, phrases(exact, lemma), text_col, id_col)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    hits = hits.join(texts, id_col).withColumn("source_text", F.expr("substring(_text, start_char + 1, end_char - start_char)"))
    before = F.expr("substring(_text, 1, start_char)")
    hits = hits.withColumn("line_number", (1 + F.length(before) - F.length(F.translate(before, "\n", ""))).cast("int")).drop("_text", "key")
    from ..functions.text import normalize

    hits = hits.withColumn("normalized", normalize(F.col("source_text"))).withColumn("lemmatized", lemmatize(F.col("source_text"), lemmas))
    out = hits.join(exact.select(F.col("name").alias("normalized"), F.col("taxon_ids").alias("_exact")), "normalized", "left")
    out = out.join(lemma.select(F.col("name").alias("lemmatized"), F.col("taxon_ids").alias("_lemma")), "lemmatized", "left")
    ids, many = F.coalesce("_exact", "_lemma"), F.size(F.coalesce("_exact", "_lemma")) > 1
    confidence = F.when(F.col("_exact").isNotNull(), F.when(many, 0.8).otherwise(1.0)).otherwise(F.when(many, 0.7).otherwise(0.9))
    out = out.withColumn("gazetteer_taxon_ids", ids).withColumn("confidence", confidence).where("gazetteer_taxon_ids is not null")
    return out.select(id_col, "source_text", "start_char", "end_char", "line_number", "normalized", "lemmatized", "confidence", "gazetteer_taxon_ids")
