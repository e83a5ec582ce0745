import random

from binomia.operators import merge
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, seq int, start_char int, end_char int, lemmatized string, normalized string, method string, confidence double, gazetteer_taxon_ids array<bigint>"
PRIORITY = {"gazetteer": 3, "latin_regex": 2, "llm": 1}


def full(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("skip", F.col("seq") % 5 == 4).withColumn("line_number", F.lit(1)).withColumn("source_text", F.concat(F.lit("t"), F.col("seq").cast("string"))).withColumn("source_context", F.lit(""))


def simple(*spans):
    return [(1, i, s, e, lemma, lemma, m, c, ids) for i, (s, e, m, c, ids, lemma) in enumerate(spans)]


def run(spark, rows):
    return merge.groups(merge.best_of_clusters(full(spark, rows))).orderBy("doc_id", "group_idx").collect()


def test_made_cases(spark):
    got = run(spark, simple((0, 5, "llm", 0.6, [], "a"), (2, 6, "gazetteer", 0.9, [1], "b")))
    assert [(r.method, r.confidence) for r in got] == [("gazetteer", 0.9)]
    assert [r.method for r in run(spark, simple((0, 5, "llm", 0.8, [], "a"), (2, 6, "latin_regex", 0.8, [], "a")))] == ["latin_regex"]
    assert len(run(spark, simple((0, 4, "gazetteer", 1.0, [1], "a"), (6, 10, "gazetteer", 1.0, [2], "a")))) == 2
    assert len(run(spark, simple((0, 4, "gazetteer", 1.0, [1], "a"), (6, 10, "llm", 0.6, [], "a")))) == 1
    assert len(run(spark, simple((0, 4, "llm", 0.6, [], "a"), (4, 8, "llm", 0.5, [], "b")))) == 1
    assert [r.gazetteer_taxon_ids for r in run(spark, simple((0, 1, "gazetteer", 1.0, [1], "a"), (2, 3, "llm", 0.6, [], "a"), (4, 5, "gazetteer", 1.0, [2], "a")))] == [[1], [2]]


def model(rows):
    """A plain statement of clustering and first-fit grouping."""
    out = {}
    for doc in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == doc), key=lambda r: (r[2], r[3], r[1]))
        survivors, cluster, reach = [], [], -1
        for r in [*own, None]:
            if r is None or cluster and r[2] > reach:
                survivors.append(min(cluster, key=lambda r: (-r[7], -PRIORITY[r[6]], -(r[3] - r[2]), own.index(r))))
                cluster = []
            if r:
                cluster.append(r)
                reach = max(reach, r[3])
        groups, first = {}, []
        for r in survivors:
            if r[4] not in first:
                first.append(r[4])
            for g in groups.setdefault(r[4], []):
                if not g["ids"] or not r[8] or set(g["ids"]) & set(r[8]):
                    g["ids"] = r[8] if not g["ids"] else g["ids"] if not r[8] else sorted(set(g["ids"]) | set(r[8]))
                    g["m"].append(r)
                    break
            else:
                groups[r[4]].append({"ids": r[8], "m": [r]})
        flat = []
        for lemma in first:
            for g in groups[lemma]:
                best = max(enumerate(g["m"]), key=lambda x: (x[1][7], PRIORITY[x[1][6]], x[0]))[1]
                flat.append((best[5], lemma, best[6], best[7], [f"t{r[1]}" for r in g["m"]], g["ids"], any(r[1] % 5 == 4 for r in g["m"])))
        out[doc] = flat
    return out


def test_against_a_plain_statement(spark):
    r = random.Random(7)
    rows = []
    for doc in range(120):
        for seq in range(r.randint(0, 14)):
            start = r.randint(0, 60)
            lemma = r.choice("abc")
            rows.append((doc, seq, start, start + r.randint(1, 6), lemma, lemma.upper() + str(seq), r.choice(list(PRIORITY)), r.choice([0.6, 0.7, 0.9]), sorted(r.sample(range(4), r.randint(0, 2)))))
    got = {}
    for x in run(spark, rows):
        got.setdefault(x.doc_id, []).append((x.normalized, x.lemmatized, x.method, x.confidence, [o.source_text for o in x.occurrences], x.gazetteer_taxon_ids, x.skip_resolution))
    assert got == {k: v for k, v in model(rows).items() if v}


def test_skip(spark):
    taxa = spark.createDataFrame([(1, "Tilia", "genus"), (2, "", "genus")], "taxon_id bigint, taxon_name string, taxon_rank string")
    rows = simple((0, 1, "gazetteer", 1.0, [1], "a"), (2, 3, "gazetteer", 1.0, [1, 2], "a"), (4, 5, "gazetteer", 1.0, [], "a"), (6, 7, "llm", 1.0, [1], "a"), (8, 9, "gazetteer", 1.0, [1, 5], "a"))
    got = merge.with_skip(spark.createDataFrame(rows, SCHEMA), taxa).orderBy("seq").collect()
    assert [r.skip for r in got] == [True, False, False, False, False]
