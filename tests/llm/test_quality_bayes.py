import math
from collections import defaultdict

import numpy as np
from binomia.llm import quality_bayes as Q


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, judged on the other half."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.classified(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    good = [r for r in got if r.quality == 1]
    assert np.mean([r.kept for r in good]) > 0.99


def test_sparse_sites_shrink_to_the_prior(spark):
    """The same neutral document in a good site, a bad site and one of its own."""
    rows = [(i, "good", "a", 3.0) for i in range(200)] + [(i, "bad", "b", -3.0) for i in range(200)] + [(0, "lone", "c", -3.0)]
    got = {r.host: r for r in Q.sites(spark.createDataFrame(rows, "doc_id bigint, host string, path string, z double"), "host", "path", "z").collect()}
    assert got["good"].host_mean > 0.9 and got["bad"].host_mean < 0.1
    assert got["bad"].host_mean < got["lone"].host_mean < got["lone"].prior + 0.01


def test_site_moves_the_score(spark):
    text = "Some words of a text, " * 9
    rows = [(i, "Fine words here, of all sorts and kinds " * 4 + str(i), "g", "p") for i in range(40)] + [(100 + i, "### $$$ %%% &&& " * 20 + str(i), "b", "p") for i in range(40)] + [(200, text, "g", "p"), (201, text, "b", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in Q.classified(docs, labels).collect()}
    assert got[200].evidence == got[201].evidence and got[200].score > got[201].score
    assert all(got[i].kept for i in range(40)) and not any(got[100 + i].kept for i in range(40))


def test_edges(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    out = Q.classified(odd_docs, none).collect()
    assert len(out) == odd_docs.count() and all(r.kept for r in out)
    odd_labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (None, 1), (7, None), (5, 7), (77, 1)], "doc_id bigint, quality int")
    assert len(Q.classified(odd_docs, odd_labels).collect()) == odd_docs.count()
    kept = Q.keep_good(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert Q.classified(no_docs, none).collect() == []
    assert Q.keep_good(no_docs, odd_labels).collect() == []


def test_posteriors_against_brute_force(spark):
    """Sums, prior, strengths and shrunk scores anew in plain Python, from the evidence of each document."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.classified(docs.withColumnsRenamed({"source": "_site_n"}), labels, host_col="_site_n").collect()
    model = Q.fit(docs, labels)
    z = {r.doc_id: r._z for r in Q._evidence(docs, "text", model, "_z").collect()}
    p = {k: 1 / (1 + math.exp(-v)) for k, v in z.items()}
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in rows:
        paths[r.host, r.path].append(p[r.doc_id])
        hosts[r.host].append(p[r.doc_id])
    prior = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups):
        n = sum(map(len, groups.values()))
        spread = sum(len(g) * (sum(g) / len(g) - prior) ** 2 for g in groups.values()) / n - prior * (1 - prior) * len(groups) / n
        return min(max(prior * (1 - prior) / max(spread, 1e-9) - 1, 2.0), 10_000.0)

    k_host, k_path = strength(hosts), strength(paths)
    logit = lambda x: math.log(x / (1 - x))
    assert len(rows) == docs.count()
    for r in rows:
        host = (sum(hosts[r.host]) + k_host * prior) / (len(hosts[r.host]) + k_host)
        others = paths[r.host, r.path]
        path = (sum(others) - p[r.doc_id] + k_path * host) / (len(others) - 1 + k_path)
        score = 1 / (1 + math.exp(-(z[r.doc_id] + 0.5 * (logit(min(max(path, 1e-6), 1 - 1e-6)) - logit(prior)))))
        assert abs(r.score - score) < 2e-6 and abs(r.evidence - z[r.doc_id]) < 2e-6 and r.kept == (score >= 0.5)
