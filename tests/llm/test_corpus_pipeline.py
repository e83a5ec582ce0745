import corpus_pipeline
from binomia.llm import packing, pii, quality_bayes, quality_rules
from test_near_copies import brute_first

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, sample):
    """Each stage's rows are those that its rule, stated anew here, leaves of its predecessor's."""
    docs, kept = sample, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == sample.columns and dict(out.dtypes) == dict(sample.dtypes)
        rows = out.collect()
        kept[name] = {r.doc_id: r for r in rows}
        assert len(rows) == len(kept[name])
        docs = spark.createDataFrame(rows, sample.schema)
        if name == "quality_classifier":
            good = quality_bayes.classified(sample, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()
            assert set(kept[name]) == {r.doc_id for r in good}
        elif name == "quality_rules":
            verdicts = quality_rules.quality_rules(sample).where("kept").collect()
            assert set(kept[name]) == set(before) & {r.doc_id for r in verdicts}
        elif name == "simhash_near_dedup":
            assert set(kept[name]) == brute_first([(i, r.text) for i, r in before.items()]) and len(kept[name]) < len(before)
        else:
            assert {i: r.text for i, r in kept[name].items()} == {i: pii.redact(r.text) for i, r in before.items()}
            assert all(r.n_chars == len(r.text) for r in kept[name].values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    sizes = {p.doc_id: p.doc_tokens for p in pieces}
    assert set(sizes) == set(kept["pii"]) and sum(p.length for p in pieces) == sum(sizes.values())
    assert packing.CAPACITY >= max(p.length for p in pieces)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_edges(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() >= 0
