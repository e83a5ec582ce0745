import hashlib

from binomia import catalog

SF = "/root/testdata/sf0.001"


def test_expanded_context_covers_all_mentions(spark):
    got = {(r.doc_id, r.start_char): r for r in catalog.expanded_context(spark, SF).collect()}
    mentions = catalog.latin_mentions(spark, SF).collect()
    assert len(got) == len(mentions) and {m.start_char % 3 for m in mentions} == {0, 1, 2}
    docs = {}
    for r in catalog.segment.sentences(catalog._docs(spark, SF)).collect():
        docs.setdefault(r.doc_id, []).append(r)
    for m in mentions:
        sents = sorted(docs[m.doc_id], key=lambda r: r.sent_idx)
        at = next(i for i, s in enumerate(sents) if s.start <= m.start_char < s.end or s.start < m.end_char <= s.end)
        wide = " ".join(s.text for s in sents[max(0, at - 1) : at + 2])
        assert got[m.doc_id, m.start_char].context_md5 == hashlib.md5(wide.encode()).hexdigest()


def test_gazetteer_mappings_cover_all_brands(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        want.setdefault((r.p_brand, r.p_name.lower()), []).append(r.p_partkey)
    got = {(r.locale, r.name): r for r in catalog.gazetteer_mappings(spark, SF).collect()}
    assert set(got) == set(want) and len({brand for brand, _ in want}) > 3
    for key, ids in want.items():
        assert got[key].ids == ",".join(map(str, sorted(ids))) and got[key].n_ids == len(ids) and got[key].first_id == min(ids)
