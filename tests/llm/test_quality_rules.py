import re
from collections import Counter

import duckdb
from binomia.llm import quality_rules, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def check(docs):
    got = quality_rules.quality_rules(docs).collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    return got


def test_counts_against_brute_force(sample):
    check(sample)


def test_edges(odd_docs):
    got = check(odd_docs)
    assert all(not r.kept for r in got if r.base_failed)


def test_empty(no_docs):
    assert quality_rules.quality_rules(no_docs).collect() == [] and quality_rules.keep_good(no_docs).collect() == []


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = registry.QUERIES["op3_quality_rules"](spark, sf).toPandas().sort_values("doc_id")
    want = c.execute(quality_rules.oracle_sql()).df().sort_values("doc_id")[list(got.columns)]
    assert got.to_records(index=False).tolist() == want.to_records(index=False).tolist()


def test_good_documents_stay_and_bad_ones_go(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1 and not r.base_failed], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_keep_good_keeps_columns(odd_docs, sample):
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = {r.doc_id for r in quality_rules.keep_good(sample).select("doc_id").collect()}
    assert ids == {r.doc_id for r in quality_rules.quality_rules(sample).where("kept").collect()}


def test_main_path_is_native(sample):
    plan = quality_rules.keep_good(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
