"""Overlapping candidates to one survivor a cluster, survivors to groups by lemma and compatible taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = {"gazetteer": 3, "latin_regex": 2, "llm": 1}


def priority(method: Column) -> Column:
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(method == name, value).otherwise(out)
    return out


def clusters(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """candidates with cluster: spans that touch or overlap, in chains; one pass over each document's spans in order."""
    w = Window.partitionBy(id_col).orderBy("start_char", "end_char", "seq")
    reach = F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = candidates.withColumn("_new", F.when(F.col("start_char") <= reach, 0).otherwise(1))
    return fresh.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def best_of_clusters(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The survivor of each cluster: highest confidence, then method, then length, then first."""
    w = Window.partitionBy(id_col, "cluster").orderBy(
        F.desc("confidence"), F.desc(priority(F.col("method"))), F.desc(F.col("end_char") - F.col("start_char")), "start_char", "end_char", "seq"
    )
    return clusters(candidates, id_col).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "cluster")


def groups(survivors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each unique name: doc_id, group_idx, normalized, lemmatized, method, confidence, occurrences,
    gazetteer_taxon_ids, skip_resolution.

    Per lemma, in span order, a candidate joins the first group whose taxa it fits (either has none, or they overlap). The
    last member of highest (confidence, method) speaks for the group; the group is skipped if any member is.
    """
    member = F.struct("start_char", "end_char", "seq", "normalized", "method", priority(F.col("method")).alias("prio"), "confidence", F.col("gazetteer_taxon_ids").alias("ids"), "skip", "line_number", "source_text", "source_context")
    each = survivors.groupBy(id_col, "lemmatized").agg(F.array_sort(F.collect_list(member)).alias("c"))
    fields = dict(each.dtypes)["c"]
    each = each.withColumn("_empty", F.from_json(F.lit("[]"), f"array<struct<ids:array<bigint>,m:{fields}>>"))
    folded = """aggregate(c, _empty, (acc, e) ->
        transform(array(array_position(transform(acc, b -> size(e.ids) = 0 or size(b.ids) = 0 or arrays_overlap(b.ids, e.ids)), true)), pos ->
            if(pos = 0,
               concat(acc, array(named_struct('ids', e.ids, 'm', array(e)))),
               transform(acc, (b, i) -> if(i = pos - 1,
                   named_struct('ids', case when size(b.ids) = 0 then e.ids when size(e.ids) = 0 then b.ids else array_sort(array_union(b.ids, e.ids)) end, 'm', concat(b.m, array(e))),
                   b))))[0])"""
    built = each.select(id_col, "lemmatized", F.expr("c[0].start_char").alias("_first"), F.posexplode(F.expr(folded)).alias("_pos", "b"))
    speaker = F.array_max(F.transform("b.m", lambda e, i: F.struct(e["confidence"].alias("confidence"), e["prio"].alias("prio"), i.alias("i"), e["normalized"].alias("normalized"), e["method"].alias("method"))))
    order = Window.partitionBy(id_col).orderBy("_first", "lemmatized", "_pos")
    return (
        built.withColumn("_s", speaker)
        .select(
            id_col, (F.row_number().over(order) - 1).alias("group_idx"), F.col("_s.normalized").alias("normalized"), "lemmatized", F.col("_s.method").alias("method"), F.col("_s.confidence").alias("confidence"),
            F.transform("b.m", lambda e: F.struct(e["line_number"].alias("line_number"), e["source_text"].alias("source_text"), e["source_context"].alias("source_context"))).alias("occurrences"),
            F.col("b.ids").alias("gazetteer_taxon_ids"), F.exists("b.m", lambda e: e["skip"]).alias("skip_resolution"),
        )
    )


def with_skip(candidates: DataFrame, taxa: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """candidates with skip: a dictionary candidate all of whose taxa have a record with name and rank."""
    if taxa is None:
        return candidates.withColumn("skip", F.lit(False))
    full = taxa.where("coalesce(taxon_name, '') <> '' and coalesce(taxon_rank, '') <> ''").select(F.col("taxon_id").alias("_tid")).distinct().withColumn("_full", F.lit(True))
    own = candidates.where("method = 'gazetteer' and size(gazetteer_taxon_ids) > 0").select(id_col, "seq", F.explode("gazetteer_taxon_ids").alias("_tid"))
    complete = own.join(full, "_tid", "left").groupBy(id_col, "seq").agg(F.bool_and(F.coalesce("_full", F.lit(False))).alias("skip"))
    return candidates.join(complete, [id_col, "seq"], "left").withColumn("skip", F.coalesce("skip", F.lit(False)))
