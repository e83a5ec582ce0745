"""Queries of the extraction engine over the driver's tables, with DuckDB SQL of the same results.

The driver's tables hold no gazetteer, so names and taxa are taken from part, customer and benchmark where a query needs them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import assemble, chunking, gazetteer, latin, llm_names, matches, merge, resolve, segment
from .plans import pipeline
from .plans.config import Config
from .sources import store

FLAGSHIP = "latin_mentions"
NOW = "2024-01-31"
TTL_DAYS = 7


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "text")


# -- fixtures from the driver's tables -------------------------------------------------------------------------------------


def _known_names(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select(F.regexp_extract("text", "[A-Z][a-z]+ [a-z]{2,}", 0).alias("name")).where("name <> ''").distinct()


def _taxa(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("taxon_id"), F.col("p_name").alias("taxon_name"), F.lower("p_type").alias("taxon_rank"), F.lit(None).cast("string").alias("ancestry"))


def _part_names(spark: SparkSession, sf: str) -> DataFrame:
    """names: a part's name in the locale of its brand; many parts share a name."""
    return _table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("taxon_id"), F.col("p_name").alias("name"), T.normalize(F.col("p_name")).alias("name_normalized"),
        T.lemmatize(F.col("p_name")).alias("name_lemmatized"), F.col("p_brand").alias("locale"), F.lit(True).alias("is_preferred"),
    )


def _customer_names(spark: SparkSession, sf: str) -> DataFrame:
    """names: several customers name the same taxon, in three locales, some preferred, some of those empty."""
    k = F.col("c_custkey")
    return _table(spark, sf, "customer").select(
        k.alias("id"), (k % 97).alias("taxon_id"), F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 3 == 0, "en").when(k % 3 == 1, "ru").otherwise("de").alias("locale"), (k % 5 == 0).alias("is_preferred"),
    )


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """phrases: the first two tokens of each benchmark text, and two common words."""
    first = _table(spark, sf, "benchmark").select(F.regexp_extract_all("text", F.lit(segment.TOKEN), F.lit(0)).alias("t")).where("size(t) > 1")
    keys = first.select(F.concat_ws(gazetteer.JOINER, F.lower(F.get("t", F.lit(0))), F.lower(F.get("t", F.lit(1)))).alias("key")).distinct()
    return keys.withColumn("n", F.lit(2)).union(spark.createDataFrame([("the", 1), ("und", 1)], "key string, n int"))


# -- queries -----------------------------------------------------------------------------------------------------------


def latin_mentions(spark, sf):
    return latin.latin_mentions(_docs(spark, sf))


def latin_confidence(spark, sf):
    return latin.with_confidence(latin.latin_mentions(_docs(spark, sf)), _known_names(spark, sf)).select("doc_id", "start_char", "source_text", "confidence")


def normalize_tokens(spark, sf):
    c = F.col("text")
    return _docs(spark, sf).select("doc_id", F.md5(T.normalize(c)).alias("normalized_md5"), F.md5(T.lemmatize(c)).alias("lemma_md5"), F.size(F.regexp_extract_all(c, F.lit(T.NAME_WORD), F.lit(0))).cast("long").alias("n_words"))


def search_variants(spark, sf):
    name = F.concat(F.initcap("p_name"), F.lit(" Ёлка-"), F.col("p_size").cast("string"))
    return _table(spark, sf, "part").select("p_partkey", F.posexplode(T.search_variants(name)).alias("idx", "variant"))


def gazetteer_mappings(spark, sf):
    m = gazetteer.locale_mappings(_part_names(spark, sf), "name_normalized")
    return m.select("locale", "name", F.size("taxon_ids").cast("long").alias("n_ids"), F.get("taxon_ids", F.lit(0)).alias("first_id"), F.array_join("taxon_ids", ",").alias("ids"))


def gazetteer_record(spark, sf):
    return gazetteer.full_records(_taxa(spark, sf), _customer_names(spark, sf), "ru").select("taxon_id", "taxon_name", "taxon_rank", "common_en", "common_loc")


def gazetteer_mentions(spark, sf):
    hits = gazetteer.phrase_hits(_docs(spark, sf), _dictionary(spark, sf), max_tokens=2)
    return hits.withColumn("key", F.translate("key", gazetteer.JOINER, " "))


def _candidates(spark, sf) -> DataFrame:
    docs = _docs(spark, sf)
    a = gazetteer.phrase_hits(docs, _dictionary(spark, sf), max_tokens=2).select("doc_id", "start_char", "end_char", F.lit("gazetteer").alias("method"), F.when(F.col("key").contains(gazetteer.JOINER), 1.0).otherwise(0.6).alias("confidence"))
    b = latin.latin_mentions(docs).select("doc_id", "start_char", "end_char", F.lit("latin_regex").alias("method"), F.lit(0.7).alias("confidence"))
    return a.union(b).withColumn("seq", F.when(F.col("method") == "gazetteer", 0).otherwise(1))


def overlap_best(spark, sf):
    return merge.best_of_clusters(_candidates(spark, sf)).select("doc_id", "start_char", "end_char", "method", "confidence")


def _latin_survivors(spark, sf) -> DataFrame:
    found = latin.with_confidence(latin.latin_mentions(_docs(spark, sf)), _known_names(spark, sf))
    return found.select(
        "doc_id", F.lit(0).alias("seq"), "start_char", "end_char", T.normalize(F.col("source_text")).alias("normalized"), T.lemmatize(F.col("source_text")).alias("lemmatized"), F.lit("latin_regex").alias("method"), "confidence",
        F.array().cast("array<bigint>").alias("gazetteer_taxon_ids"), F.lit(False).alias("skip"), "line_number", "source_text", F.lit("").alias("source_context"),
    )


def candidate_groups(spark, sf):
    g = merge.groups(_latin_survivors(spark, sf))
    return g.select("doc_id", F.col("group_idx").cast("long").alias("group_idx"), "normalized", "lemmatized", "confidence", F.size("occurrences").cast("long").alias("n_occurrences"))


def dedup_results(spark, sf):
    g = merge.groups(_latin_survivors(spark, sf)).withColumn("matches", F.expr(resolve.EMPTY)).withColumn("identified", F.lit(False))
    return assemble.results(g, 0.9).select("doc_id", "source_text", "confidence", F.col("count").cast("long").alias("count"))


def occurrence_explode(spark, sf):
    g = merge.groups(_latin_survivors(spark, sf)).withColumn("matches", F.expr(resolve.EMPTY)).withColumn("identified", F.lit(False))
    return assemble.per_occurrence(assemble.results(g, 0.0)).select("doc_id", F.col("group_idx").cast("long").alias("group_idx"), "source_text", "line_number")


def _responses(spark, sf) -> DataFrame:
    """(query, locale, response_json): for each part name, its parts as search results."""
    own = F.struct(
        F.col("p_partkey").alias("id"), F.initcap("p_name").alias("name"), F.lower("p_type").alias("rank"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("other")).alias("matched_term"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("score"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Common "), F.col("p_brand"))).alias("preferred_common_name"),
        F.array(F.struct(F.lit("family").alias("rank"), F.col("p_brand").alias("name"))).alias("ancestors"),
    )
    each = _table(spark, sf, "part").groupBy(F.col("p_name").alias("query")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), own.alias("r")))).alias("rs"))
    return each.select("query", F.lit("en").alias("locale"), F.to_json(F.struct(F.transform("rs", lambda x: x["r"]).alias("results"))).alias("response_json"))


def response_matches(spark, sf):
    r = _responses(spark, sf)
    m = r.select("query", F.posexplode(matches.parse_response(F.col("response_json"), F.col("query"), "en")).alias("pos", "m"))
    return m.select("query", "pos", "m.taxon_id", "m.taxon_name", "m.taxon_matched_name", "m.taxon_common_name_en", F.col("m.taxonomy.family").alias("family"), "m.taxon_url", "m.score")


def identify(spark, sf):
    r = _responses(spark, sf).select("query", matches.parse_response(F.col("response_json"), F.col("query"), "en").alias("ms"))
    asked = r.union(r.select(F.concat(F.lit("no "), F.col("query")), "ms")).union(r.select(F.concat(F.lit("empty "), F.col("query")), F.expr(resolve.EMPTY)))
    done = matches.is_identified(F.col("ms"), F.col("query"), F.col("query"))
    return asked.select("query", done.alias("identified"), matches.reason(F.col("ms"), done).alias("reason"), F.size("ms").cast("long").alias("n_matches"))


def merge_top5(spark, sf):
    ms = F.struct("l_linenumber", "l_partkey", F.struct((F.col("l_suppkey") % 7).alias("taxon_id"), (F.floor(F.col("l_quantity") / 10)).cast("double").alias("score")).alias("m"))
    each = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey")).agg(F.array_sort(F.collect_list(ms)).alias("s"))
    own = F.transform("s", lambda x: x["m"])
    top = each.select("l_orderkey", F.posexplode(matches.merge_matches(F.slice(own, 1, 2), F.slice(own, F.lit(3), F.size("s") + 1))).alias("pos", "m"))
    return top.select("l_orderkey", "pos", "m.taxon_id", "m.score")


def _cache(spark, sf) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("query"), F.col("event_type").alias("locale"), F.col("props").alias("response_json"), F.col("ts").alias("created_at"), "event_id")


def cache_upsert(spark, sf):
    c = _cache(spark, sf)
    return store.upserted(c.where("event_id % 2 = 0").drop("event_id"), c.where("event_id % 2 = 1").drop("event_id")).select("query", "locale", "response_json")


def ttl_cache_lookup(spark, sf):
    c = _cache(spark, sf)
    held = store.upserted(c.where("event_id % 2 = 0").drop("event_id"), c.where("event_id % 2 = 1").drop("event_id"))
    asked = c.select("query", "locale").distinct()
    live = store.fresh(held, F.lit(NOW).cast("timestamp"), TTL_DAYS)
    return asked.join(live, ["query", "locale"], "left").select("query", "locale", F.col("response_json").isNotNull().alias("hit"), "response_json")


def word_chunks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(chunking.tumbling(F.col("text"), 100)).alias("idx", "chunk"))


def sliding_chunks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(chunking.sliding(F.col("text"), 120)).alias("idx", "chunk"))


def sentence_spans(spark, sf):
    return segment.sentences(_docs(spark, sf)).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "start", "end", F.md5("text").alias("text_md5"))


def sentence_context(spark, sf):
    docs = _docs(spark, sf)
    return segment.with_context(latin.latin_mentions(docs), segment.sentences(docs), docs).select("doc_id", "start_char", "source_text", F.md5("source_context").alias("context_md5"))


def paragraph_chunks(spark, sf):
    docs = _docs(spark, sf).withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return chunking.chunks(docs, "paragraph", 50, 150)


def page_chunks(spark, sf):
    return chunking.chunks(_docs(spark, sf), "page", 50, 150)


def json_repair(spark, sf):
    e = _table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.replace(F.col("props"), F.lit("}"), F.lit(", }"))).otherwise(F.lit("not json"))
    return e.select("event_id", F.coalesce(T.parse_json(raw, "k bigint", "k")["k"], F.lit(-1)).alias("k"))


def encoding_score(spark, sf):
    mixed = F.concat(F.col("p_name"), F.lit(" Липа ёж ЁЛЬ "), F.repeat(F.lit("ж"), F.col("p_size")))
    return _table(spark, sf, "part").select("p_partkey", T.cyrillic_score(mixed).cast("long").alias("score"))


def estimate(spark, sf):
    config = Config(confidence=0.5, locale="en")
    names = _table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(segment.TOKEN), F.lit(0)).alias("t")).where("size(t) > 1")
    names = names.select(F.col("item_id").alias("id"), F.col("item_id").alias("taxon_id"), F.lower(F.concat_ws(" ", F.slice("t", 1, 2))).alias("name"))
    names = names.select("id", "taxon_id", "name", F.col("name").alias("name_normalized"), F.lit(None).cast("string").alias("name_lemmatized"), F.lit("en").alias("locale"), F.lit(True).alias("is_preferred"))
    out = pipeline.estimate(_docs(spark, sf), config, pipeline.Gazetteer(_taxa(spark, sf), names))
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("sentences", "regex_candidates", "chunks", "llm_calls")])


def _full(spark, sf) -> pipeline.Stages:
    """The flow with the parts' names searched by table: mentions are binomials, the known ones those of benchmark."""
    b = _table(spark, sf, "benchmark").select("item_id", F.regexp_extract("text", "[A-Z][a-z]+ [a-z]{2,}", 0).alias("name")).where("name <> ''")
    result = F.to_json(F.struct(F.array(F.struct(F.col("item_id").alias("id"), F.col("name"), F.lit("species").alias("rank"), F.col("name").alias("matched_term"), F.lit(1.0).alias("score"))).alias("results")))
    responses = b.groupBy(F.lower("name").alias("query")).agg(F.min_by(result, "item_id").alias("response_json")).withColumn("locale", F.lit("en"))
    from .sources.providers import table_searcher

    config = Config(confidence=0.5, locale="en", degraded_mode=True)
    return pipeline.analyze(_docs(spark, sf), config, None, pipeline.Providers(table_searcher(responses, "en")))


def resolved_results(spark, sf):
    r = _full(spark, sf).results
    return r.select("doc_id", "source_text", "lemmatized", "identified", "reason", F.size("matches").cast("long").alias("n_matches"), F.col("count").cast("long").alias("count"))


def pipeline_summary(spark, sf):
    s = _full(spark, sf).summary
    return s.select(*[F.col(c).cast("long").alias(c) for c in ("total_candidates", "unique_candidates", "identified_count", "unidentified_count", "skipped_resolution", "search_calls")])


def expanded_context(spark, sf):
    docs = _docs(spark, sf)
    out = segment.expanded_context(latin.latin_mentions(docs), segment.sentences(docs))
    return out.select("doc_id", "start_char", "source_text", F.md5("expanded_context").alias("context_md5"))


def gazetteer_candidates(spark, sf):
    """Dictionary candidates with confidence; the names are the benchmark texts' first two words."""
    pair = F.lower(F.regexp_extract("text", r"^([A-Za-z]+ [A-Za-z]+)", 1))
    own = _table(spark, sf, "benchmark").select("item_id", pair.alias("name")).where("name <> ''")
    names = own.select(F.col("item_id").alias("id"), F.col("item_id").alias("taxon_id"), "name", F.col("name").alias("name_normalized"), F.lit(None).cast("string").alias("name_lemmatized"), F.lit("en").alias("locale"), F.lit(True).alias("is_preferred"))
    found = gazetteer.gazetteer_mentions(_docs(spark, sf), names, "en")
    return found.select("doc_id", "start_char", "end_char", "source_text", "line_number", "confidence", F.array_join("gazetteer_taxon_ids", ",").alias("ids"))


def llm_mentions(spark, sf):
    """Candidates of a model's replies; the model here names each chunk's first capitalised word, in a code fence."""
    docs = _docs(spark, sf)
    name = F.regexp_extract("user", "[A-Z][a-z]{3,}", 0)
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct(name.alias("name"), F.lit("").alias("context"))).alias("candidates"))), F.lit("\n```"))
    found = llm_names.llm_mentions(docs, chunking.chunks(docs, "page", 50, 150, by_sentences=False), "name organisms", lambda prompts: prompts.select("prompt_key", reply.alias("raw")))
    return found.select("doc_id", "idx", "source_text", "start_char", "end_char", "line_number", "confidence", F.md5("source_context").alias("context_md5"))


def gazetteer_matches(spark, sf):
    """Matches of groups that need no search: each customer's taxa by number, with records from part and customer."""
    ids = F.array(F.col("c_custkey") % 13, F.col("c_custkey") % 89, F.col("c_custkey") % 13, F.lit(-1).cast("bigint"))
    groups = _table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lower("c_name").alias("normalized"), ids.alias("gazetteer_taxon_ids"))
    m = matches.gazetteer_matches(groups, _taxa(spark, sf), gazetteer.preferred_names(_customer_names(spark, sf), "ru"), ["key"])
    return m.select("key", F.posexplode("matches").alias("pos", "m")).select("key", "pos", "m.taxon_id", "m.taxon_name", "m.taxon_matched_name", "m.taxon_common_name_en", "m.taxon_common_name_loc", "m.score")


# -- DuckDB --------------------------------------------------------------------------------------------------------------

_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_SPANS = """
m AS (SELECT doc_id, replace(regexp_replace(regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1' || chr(3), 'g'),
  '(^|\\x03)([A-Z][a-z]+ \\x03[a-z]{2,}(?: \\x03[a-z]{2,})?)([^\\p{L}\\p{N}_\\x03]|$)', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(3), '') t, text FROM documents),
s AS (SELECT doc_id, text, unnest(string_split(t, chr(1))) seg, generate_subscripts(string_split(t, chr(1)), 1) i FROM m),
p AS (SELECT doc_id, i, text, split_part(seg, chr(2), 1) src, sum(length(replace(seg, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::INT st FROM s),
latin AS (SELECT doc_id, src source_text, st start_char, (st + length(src))::INT end_char,
  (1 + length(substring(text, 1, st)) - length(replace(substring(text, 1, st), chr(10), '')))::INT line_number, text FROM p WHERE i > 1
  AND NOT regexp_matches(src, '(^| )[A-Za-z]{1,2}( |$)') AND lower(src) NOT IN (""" + _quoted(latin.STOP_PHRASES) + """)
  AND coalesce(lower(regexp_extract(substring(text, 1, st), '([\\p{L}\\p{N}_]+)[\\s.]*\\.\\s*$', 1)), '') NOT IN (""" + _quoted(latin.TITLES) + """))"""  # fmt: skip
_KNOWN = "known AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Z][a-z]+ [a-z]{2,}')) kn FROM benchmark WHERE regexp_extract(text, '[A-Z][a-z]+ [a-z]{2,}') <> '')"
_CONF = "conf AS (SELECT l.*, CASE WHEN kn IS NOT NULL THEN 0.9 ELSE 0.7 END::DOUBLE confidence, list_aggregate(list_transform(regexp_extract_all(source_text, '[A-Za-z]+'), lambda x: lower(x)), 'string_agg', ' ') lemma FROM latin l LEFT JOIN known ON lower(source_text) = kn)"
_TOKENS = """
tm AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') toks, string_split_regex(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') gaps FROM documents),
tu AS (SELECT doc_id, unnest(toks) tok, unnest(gaps[1:len(toks)]) gap, generate_subscripts(toks, 1) i FROM tm),
tk AS (SELECT doc_id, i, lower(tok) w, (sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i))::INT e, length(tok)::INT n FROM tu),
dict AS (SELECT DISTINCT lower(t[1]) || chr(1) || lower(t[2]) k FROM (SELECT regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]') t FROM benchmark) WHERE len(t) > 1 UNION SELECT 'the' UNION SELECT 'und'),
ng AS (SELECT doc_id, e - n st, e en, w k FROM tk UNION ALL SELECT doc_id, e - n, lead(e) OVER x, w || chr(1) || lead(w) OVER x FROM tk WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT doc_id, st start_char, en end_char, k FROM ng JOIN dict USING (k) WHERE en IS NOT NULL)"""
_SENTENCES = """
sm AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?…]+["''»”’)\\]]*)(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) parts FROM documents),
su AS (SELECT doc_id, unnest(parts) raw, generate_subscripts(parts, 1) i FROM sm),
sp AS (SELECT doc_id, i, raw, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') tx, length(raw) - length(regexp_replace(raw, '^\\s+', '')) lead_n,
  coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) off FROM su),
sent AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT sent_idx, (off + lead_n)::INT s, (off + lead_n + length(tx))::INT e, tx FROM sp WHERE tx <> '')"""
_GROUPS = "grp AS (SELECT doc_id, lemma, min(start_char) f, count(*) n, arg_max(lower(source_text), confidence * 1e9 + start_char) norm, max(confidence) conf, arg_min(source_text, start_char) src FROM conf GROUP BY ALL)"
_PARTS = """
res AS (SELECT p_name query, p_partkey id, p_type, p_size, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 pos FROM part),
five AS (SELECT query, pos::INT pos, id taxon_id, list_aggregate(list_transform(string_split(query, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') taxon_name,
  CASE WHEN p_size % 2 = 0 THEN query ELSE 'other' END taxon_matched_name, CASE WHEN p_size % 5 = 0 THEN 'Common ' || p_brand END taxon_common_name_en, p_brand family,
  'https://www.inaturalist.org/taxa/' || id taxon_url, CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE 0 END::DOUBLE score FROM res WHERE pos < 5)"""
_CACHE = "c AS (SELECT 'u' || user_id query, event_type locale, props response_json, ts created_at, event_id FROM events), held AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query, locale ORDER BY created_at DESC, event_id % 2 DESC, response_json DESC) = 1)"

ORACLES = {
    "latin_mentions": f"WITH {_SPANS} SELECT doc_id, source_text, start_char, end_char, line_number FROM latin",
    "latin_confidence": f"WITH {_SPANS}, {_KNOWN}, {_CONF} SELECT doc_id, start_char, source_text, confidence FROM conf",
    "normalize_tokens": "SELECT doc_id, md5(replace(lower(text), 'ё', 'е')) normalized_md5, md5(coalesce(list_aggregate(list_transform(w, lambda x: lower(x)), 'string_agg', ' '), '')) lemma_md5, len(w)::BIGINT n_words FROM (SELECT *, regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]+') w FROM documents)",
    "search_variants": """WITH v AS (SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') || ' Ёлка-' || p_size n FROM part),
        a AS (SELECT p_partkey, lower(n) a, replace(lower(n), 'ё', 'е') b, list_aggregate(list_transform(regexp_extract_all(n, '[A-Za-zА-Яа-яЁё]+'), lambda x: lower(x)), 'string_agg', ' ') c FROM v),
        u AS (SELECT p_partkey, unnest([a, b, c, replace(c, 'ё', 'е')]) variant, unnest([1, 2, 3, 4]) k FROM a), d AS (SELECT p_partkey, variant, min(k) k FROM u WHERE variant <> '' GROUP BY ALL)
        SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INT idx, variant FROM d""",
    "gazetteer_mappings": "SELECT p_brand locale, lower(p_name) AS name, count(*) n_ids, min(p_partkey) first_id, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) ids FROM part GROUP BY ALL",
    "gazetteer_record": """WITH n AS (SELECT c_custkey id, c_custkey % 97 taxon_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' ELSE 'de' END locale, c_custkey % 5 = 0 p FROM customer),
        a AS (SELECT taxon_id, locale, coalesce(nullif(arg_min(name, id) FILTER (p), ''), arg_min(name, id)) AS name FROM n WHERE locale IN ('en', 'ru') GROUP BY ALL)
        SELECT p_partkey taxon_id, p_name taxon_name, lower(p_type) taxon_rank, e.name common_en, r.name common_loc FROM part LEFT JOIN a e ON e.taxon_id = p_partkey AND e.locale = 'en' LEFT JOIN a r ON r.taxon_id = p_partkey AND r.locale = 'ru'""",
    "gazetteer_mentions": f"WITH {_TOKENS.strip()} SELECT doc_id, start_char, end_char, replace(k, chr(1), ' ') AS \"key\" FROM hits",
    "overlap_best": f"""WITH {_TOKENS.strip()}, {_SPANS.strip()},
        cand AS (SELECT doc_id, start_char, end_char, 'gazetteer' AS method, CASE WHEN contains(k, chr(1)) THEN 1.0 ELSE 0.6 END::DOUBLE confidence, 0 seq, 3 prio FROM hits UNION ALL SELECT doc_id, start_char, end_char, 'latin_regex', 0.7, 1, 2 FROM latin),
        a AS (SELECT *, max(end_char) OVER (PARTITION BY doc_id ORDER BY start_char, end_char, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM cand),
        b AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_char > pm THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_char, end_char, seq) cl FROM a)
        SELECT doc_id, start_char, end_char, method, confidence FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, cl ORDER BY confidence DESC, prio DESC, end_char - start_char DESC, start_char, end_char, seq) = 1""",
    "candidate_groups": f"WITH {_SPANS}, {_KNOWN}, {_CONF}, {_GROUPS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 group_idx, norm normalized, lemma lemmatized, conf confidence, n n_occurrences FROM grp",
    "dedup_results": f"WITH {_SPANS}, {_KNOWN}, {_CONF}, {_GROUPS} SELECT doc_id, src source_text, conf confidence, n AS \"count\" FROM grp WHERE conf >= 0.9",
    "occurrence_explode": f"WITH {_SPANS}, {_KNOWN}, {_CONF}, g AS (SELECT *, min(start_char) OVER (PARTITION BY doc_id, lemma) f FROM conf) SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY f) - 1 group_idx, source_text, line_number FROM g",
    "response_matches": f"WITH {_PARTS.strip()} SELECT * FROM five",
    "identify": f"""WITH {_PARTS.strip()}, a AS (SELECT query, count(*) n, bool_or(lower(taxon_matched_name) = query OR lower(taxon_name) = query) ok FROM five GROUP BY ALL)
        SELECT query, ok identified, CASE WHEN ok THEN '' WHEN n > 1 THEN '{matches.SEVERAL}' ELSE '{matches.NOT_MATCHED}' END reason, n n_matches FROM a UNION ALL
        SELECT 'no ' || query, false, CASE WHEN n > 1 THEN '{matches.SEVERAL}' ELSE '{matches.NOT_MATCHED}' END, n FROM a UNION ALL SELECT 'empty ' || query, false, '{matches.NO_MATCHES}', 0 FROM a""",
    "merge_top5": """WITH o AS (SELECT l_orderkey, l_suppkey % 7 taxon_id, floor(l_quantity / 10)::DOUBLE score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey % 7, floor(l_quantity / 10)) i FROM lineitem),
        d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_orderkey, taxon_id ORDER BY i) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, i) - 1 pos FROM d)
        SELECT l_orderkey, pos::INT pos, taxon_id, score FROM r WHERE pos < 5""",
    "cache_upsert": f"WITH {_CACHE} SELECT query, locale, response_json FROM held",
    "ttl_cache_lookup": f"WITH {_CACHE} SELECT query, locale, created_at >= TIMESTAMP '{NOW}' - INTERVAL {TTL_DAYS} DAY hit, CASE WHEN created_at >= TIMESTAMP '{NOW}' - INTERVAL {TTL_DAYS} DAY THEN response_json END response_json FROM held",
    "word_chunks": "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') w FROM documents), k AS (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // 100)) i FROM w WHERE len(w) > 0) SELECT doc_id, i::INT idx, array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ') AS chunk FROM k",
    "sliding_chunks": "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') w FROM documents), k AS (SELECT doc_id, w, unnest(generate_series(0, CASE WHEN len(w) <= 120 THEN 0 ELSE ceil((len(w) - 120) / 70)::BIGINT END)) i FROM w WHERE len(w) > 0) SELECT doc_id, i::INT idx, array_to_string(w[i * 70 + 1 : i * 70 + 120], ' ') AS chunk FROM k",
    "sentence_spans": f"WITH {_SENTENCES.strip()} SELECT doc_id, sent_idx, s AS \"start\", e AS \"end\", md5(tx) text_md5 FROM sent",
    "sentence_context": f"""WITH {_SPANS}, {_SENTENCES.strip()} SELECT l.doc_id, start_char, source_text, md5(coalesce(tx, string_split(text, chr(10))[line_number])) context_md5
        FROM latin l LEFT JOIN sent t ON l.doc_id = t.doc_id AND s <= start_char AND start_char < e""",
    "expanded_context": f"""WITH {_SPANS}, {_SENTENCES.strip()}, w AS (SELECT doc_id, sent_idx, s, e, concat_ws(' ', lag(tx) OVER o, tx, lead(tx) OVER o) wide FROM sent WINDOW o AS (PARTITION BY doc_id ORDER BY sent_idx))
        SELECT l.doc_id, start_char, source_text, md5(arg_min(wide, sent_idx)) context_md5 FROM latin l LEFT JOIN w ON l.doc_id = w.doc_id AND (s <= start_char AND start_char < e OR s < end_char AND end_char <= e)
        GROUP BY l.doc_id, start_char, source_text""",
    "gazetteer_candidates": f"""WITH n AS (SELECT item_id, lower(regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+)', 1)) nm FROM benchmark), g AS (SELECT nm, count(*) c, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) ids FROM n WHERE nm <> '' GROUP BY ALL), {_TOKENS.strip()},
        two AS (SELECT doc_id, st, en FROM ng WHERE en IS NOT NULL AND contains(k, chr(1))), x AS (SELECT two.doc_id, st, en, substring(text, st + 1, en - st) src, substring(text, 1, st) pre FROM two JOIN documents USING (doc_id))
        SELECT doc_id, st start_char, en end_char, src source_text, (1 + length(pre) - length(replace(pre, chr(10), '')))::INT line_number, CASE WHEN c > 1 THEN 0.8 ELSE 1.0 END::DOUBLE confidence, ids FROM x JOIN g ON lower(src) = nm""",
    "llm_mentions": """WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') w FROM documents), k AS (SELECT doc_id, text, w, unnest(generate_series(0, (len(w) - 1) // 150)) i FROM w WHERE len(w) > 0),
        c AS (SELECT doc_id, text, i, regexp_extract(array_to_string(w[i * 150 + 1 : i * 150 + 150], ' '), '[A-Z][a-z]{3,}') nm FROM k), d AS (SELECT *, instr(text, nm) - 1 st FROM c WHERE nm <> ''),
        e AS (SELECT *, 1 + length(substring(text, 1, st)) - length(replace(substring(text, 1, st), chr(10), '')) ln FROM d)
        SELECT doc_id, i::INT idx, nm source_text, st::INT start_char, (st + length(nm))::INT end_char, ln::INT line_number, 0.6::DOUBLE confidence, md5(string_split(text, chr(10))[ln]) context_md5 FROM e""",
    "gazetteer_matches": """WITH n AS (SELECT c_custkey id, c_custkey % 97 taxon_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ru' ELSE 'de' END locale, c_custkey % 5 = 0 p FROM customer),
        a AS (SELECT taxon_id, locale, coalesce(nullif(arg_min(name, id) FILTER (p), ''), arg_min(name, id)) AS name FROM n WHERE locale IN ('en', 'ru') GROUP BY ALL),
        i AS (SELECT c_custkey AS "key", lower(c_name) norm, unnest([c_custkey % 13, c_custkey % 89]) t, unnest([0, 1]) o FROM customer), u AS (SELECT * FROM i WHERE o = 0 OR t <> "key" % 13)
        SELECT u."key", (row_number() OVER (PARTITION BY u."key" ORDER BY o) - 1)::INT pos, t taxon_id, p_name taxon_name, norm taxon_matched_name, e.name taxon_common_name_en, r.name taxon_common_name_loc, CASE WHEN o = 0 THEN 1.0 ELSE 0.5 END::DOUBLE score
        FROM u JOIN part ON p_partkey = t LEFT JOIN a e ON e.taxon_id = t AND e.locale = 'en' LEFT JOIN a r ON r.taxon_id = t AND r.locale = 'ru'""",
    "json_repair": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props::JSON ->> 'k')::BIGINT ELSE -1 END k FROM events",
    "encoding_score": "SELECT p_partkey, 2 * len(regexp_extract_all(x, '[а-яё]')) + len(regexp_extract_all(x, '[А-ЯЁ]')) score FROM (SELECT p_partkey, p_name || ' Липа ёж ЁЛЬ ' || repeat('ж', p_size) x FROM part)",
    "estimate": f"WITH {_SPANS}, {_SENTENCES.strip()}, a AS (SELECT doc_id, count(*) n FROM sent GROUP BY ALL), b AS (SELECT doc_id, count(*) n FROM latin GROUP BY ALL) SELECT d.doc_id, coalesce(a.n, 0)::BIGINT sentences, coalesce(b.n, 0)::BIGINT regex_candidates, 0::BIGINT chunks, 0::BIGINT llm_calls FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)",
    "resolved_results": f"""WITH {_SPANS}, {_KNOWN}, {_CONF}, {_GROUPS} SELECT doc_id, src source_text, lemma lemmatized, kn IS NOT NULL identified, CASE WHEN kn IS NULL THEN '{matches.NO_MATCHES}' ELSE '' END reason,
        CASE WHEN kn IS NULL THEN 0 ELSE 1 END::BIGINT n_matches, n AS "count" FROM grp LEFT JOIN known ON lemma = kn""",
    "pipeline_summary": f"""WITH {_SPANS}, {_KNOWN}, {_CONF}, {_GROUPS}, r AS (SELECT n, kn FROM grp LEFT JOIN known ON lemma = kn)
        SELECT (SELECT count(*) FROM latin) total_candidates, count(*) unique_candidates, count(kn) identified_count, count(*) - count(kn) unidentified_count, 0::BIGINT skipped_resolution, count(*) search_calls FROM r""",
}
_NAMES = (
    "latin_mentions latin_confidence normalize_tokens search_variants gazetteer_mappings gazetteer_record gazetteer_mentions overlap_best candidate_groups dedup_results occurrence_explode response_matches identify merge_top5 "
    "cache_upsert ttl_cache_lookup word_chunks sliding_chunks sentence_spans sentence_context expanded_context gazetteer_candidates llm_mentions gazetteer_matches paragraph_chunks page_chunks json_repair encoding_score estimate resolved_results pipeline_summary"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: " ".join(sql.split("\n")) for name, sql in ORACLES.items()}
