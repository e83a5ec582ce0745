import datetime
import json

import pytest
from binomia.operators import assemble, llm_names, matches
from binomia.plans import pipeline
from binomia.plans.config import Config, LlmConfig, load_config, parse_config
from binomia.sources import providers, store, text_files
from pyspark.sql import functions as F

TAXA = [(54586, "Tilia", "genus", "48460/47126")]
NAMES = [(1, 54586, "Липа", "липа", "липа", "ru", True, None), (2, 54586, "Lindens", "linden", "linden", "en", True, None)]


def response(*results):
    return json.dumps({"results": list(results)})


@pytest.fixture
def gaz(spark):
    return pipeline.Gazetteer(spark.createDataFrame(TAXA, store.TAXA), spark.createDataFrame(NAMES, store.NAMES))


@pytest.fixture
def search(spark):
    rows = [
        ("quercus robur", "ru", response({"id": 7, "name": "Quercus robur", "rank": "species", "matched_term": "Quercus robur", "score": 3.5, "ancestors": [{"rank": "family", "name": "Fagaceae"}], "preferred_common_name": {"name": "English oak"}, "names": [{"name": "Дуб", "locale": "ru"}]})),
        ("acer negundo", "ru", response({"id": 8, "name": "Other", "matched_term": "x"}, {"id": 9, "name": "Another", "matched_term": "y"})),
        ("box elder", "ru", response({"id": 10, "name": "Acer negundo", "rank": "species", "score": 1})),
    ]
    return providers.table_searcher(spark.createDataFrame(rows, "query string, locale string, response_json string"), "ru")


def test_flow(spark, gaz, search):
    docs = spark.createDataFrame([(1, "Липа и ещё раз липа. А ещё Quercus robur."), (2, "Мы видели Acer negundo."), (3, "Tilia platyphyllos"), (4, None)], "doc_id bigint, text string")
    reply = json.dumps({"common_names_loc": ["Клён"], "common_names_en": ["Box elder", ], "latin_names": []})
    asked = []

    def llm(prompts):
        asked.append(1)
        return prompts.where("user like 'Candidate: acer negundo%'").select("prompt_key", F.lit(reply).alias("raw"))

    config = Config(confidence=0.5, locale="ru", llm_enricher=LlmConfig("ollama", "m"))
    out = pipeline.analyze(docs, config, gaz, pipeline.Providers(search, enricher_llm=llm, enricher_prompt="{{locale}}"))
    got = {(r.doc_id, r.lemmatized): r for r in out.results.collect()}
    assert set(got) == {(1, "липа"), (1, "quercus robur"), (2, "acer negundo"), (3, "tilia platyphyllos")}
    lipa, oak, acer, none = (got[k] for k in ((1, "липа"), (1, "quercus robur"), (2, "acer negundo"), (3, "tilia platyphyllos")))
    assert (lipa["count"], lipa.identified, lipa.calls, lipa.result_idx, lipa.matches[0].taxon_common_name_en) == (2, True, 0, 0, "Lindens")
    assert (oak.identified, oak.calls, oak.reason, oak.candidate_names, oak.result_idx) == (True, 1, "", [], 1)
    assert oak.matches[0].taxonomy.family == "Fagaceae" and oak.matches[0].taxonomy.species == "Quercus robur" and oak.matches[0].taxon_common_name_loc == "Дуб"
    assert acer.identified and acer.calls == 3 and [m.taxon_id for m in acer.matches][0] == 10 and acer.llm_response.common_names_en == ["Box elder"]
    assert not none.identified and none.reason == matches.NO_MATCHES and none.candidate_names == ["tilia platyphyllos"] and none.matches == []
    s = out.summary.first()
    assert (s.total_candidates, s.unique_candidates, s.identified_count, s.unidentified_count, s.skipped_resolution, s.search_calls) == (5, 4, 3, 1, 1, 5)
    doc = json.loads(assemble.to_json(out.results.where("doc_id = 1").orderBy("result_idx")))
    assert doc["version"] == "1.0" and doc["results"][0]["count"] == 2 and "taxon_names" not in doc["results"][0]["matches"][0]
    assert len(json.loads(assemble.to_json(out.results.where("doc_id = 1"), full=True))["results"]) == 3


def test_llm_mentions(spark, gaz, search):
    docs = spark.createDataFrame([(1, "Липа растет.\nВстречалась ель.")], "doc_id bigint, text string")
    llm = lambda prompts: prompts.select("prompt_key", F.lit('```json\n{"candidates": [{"name": " ель ", "context": ""}, {"name": ""}, {"name": "Сосна", "context": "c"},]}\n```').alias("raw"))
    config = Config(confidence=0.0, locale="ru", llm_extractor=LlmConfig("ollama", "m"))
    got = {r.source_text: r for r in pipeline.candidates(docs, config, gaz, pipeline.Providers(search, llm)).collect()}
    assert (got["ель"].start_char, got["ель"].line_number, got["ель"].source_context, got["ель"].confidence) == (25, 2, "Встречалась ель.", 0.6)
    assert (got["Сосна"].start_char, got["Сосна"].end_char, got["Сосна"].source_context) == (0, 5, "c") and got["Липа"].method == "gazetteer"


def test_missing_gazetteer(spark, search):
    docs = spark.createDataFrame([(1, "Quercus robur")], "doc_id bigint, text string")
    with pytest.raises(FileNotFoundError):
        pipeline.analyze(docs, Config(0.5, "ru"), None, pipeline.Providers(search))
    out = pipeline.analyze(docs, Config(0.8, "ru", degraded_mode=True), None, pipeline.Providers(search))
    assert out.results.count() == 0 and out.summary.first().unique_candidates == 1


def test_estimate(spark, gaz):
    docs = spark.createDataFrame([(1, "Липа. Quercus robur!"), (2, "")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pipeline.estimate(docs, Config(0.5, "ru", llm_extractor=LlmConfig("ollama", "m")), gaz).collect()}
    assert (got[1].sentences, got[1].chunks, got[1].gazetteer_candidates, got[1].regex_candidates, got[1].api_calls, got[1].estimated_seconds) == (2, 1, 1, 1, 1, 3.0)
    assert (got[2].unique_candidates, got[2].api_calls, got[2].estimated_seconds) == (1, 1, 1.0)


def test_decisions(spark):
    m = lambda i, name, score=1.0: f"named_struct('taxon_id', {i}L, 'taxon_name', '{name}', 'taxon_rank', '', 'taxonomy', cast(null as {matches.TAXONOMY}), 'taxon_common_name_en', cast(null as string), 'taxon_common_name_loc', '', 'taxon_matched_name', '', 'taxon_url', '', 'score', {score}D, 'taxon_names', array('Ёль'))"
    df = spark.sql(f"select array({m(1, 'a', 2.0)}, {m(2, 'b', 3.0)}) x, array({m(1, 'c', 9.0)}, {m(3, 'd', 2.0)}, {m(4, 'e', 1.0)}, {m(5, 'f', 0.5)}, {m(6, 'g', 0.1)}) y")
    merged = df.select(matches.merge_matches(F.col("x"), F.col("y"))).first()[0]
    assert [(r.taxon_id, r.taxon_name) for r in merged] == [(2, "b"), (1, "a"), (3, "d"), (4, "e"), (5, "f")]
    hit = lambda n: df.select(matches.is_identified(F.col("x"), F.lit(n), F.lit("-"))).first()[0]
    assert hit("ель") and hit("b") and not hit("z")


def test_cache(spark, tmp_path):
    cache = store.ResponseCache(spark, f"file://{tmp_path}/c", ttl_days=1)
    now = datetime.datetime(2024, 1, 10)
    calls = []

    def ask(queries):
        calls.append(sorted(r.query for r in queries.collect()))
        return queries.select("query", F.lit("ru").alias("locale"), F.lit(response({"id": 1, "name": "X"})).alias("response_json"), F.lit(now).alias("created_at"))

    search = pipeline.cached_search(cache, ask, "ru", now)
    q = spark.createDataFrame([("a",), ("b",)], "query string")
    assert search(q).count() == 2 and search(q).count() == 2 and calls == [["a", "b"], []]
    later = pipeline.cached_search(cache, ask, "ru", now + datetime.timedelta(days=1, seconds=1))
    later(q)
    assert calls[-1] == ["a", "b"] and cache.table().count() == 2
    assert store.ResponseCache(spark, f"file://{tmp_path}/c").get(now + datetime.timedelta(days=7)).count() == 2
    spark.createDataFrame([(2, 9)], "schema_version int, version int").write.mode("append").parquet(f"file://{tmp_path}/c/meta.parquet")
    with pytest.raises(ValueError, match="version mismatch"):
        store.ResponseCache(spark, f"file://{tmp_path}/c")


def test_gazetteer_store(spark, gaz, tmp_path):
    store.write_gazetteer(f"file://{tmp_path}/g", gaz.taxa, gaz.names)
    taxa, names = store.open_gazetteer(spark, f"file://{tmp_path}/g")
    assert taxa.count() == 1 and [r.taxon_id for r in store.taxon_ids(names, "липа", "ru").collect()] == [54586] and store.taxon_ids(names, "none", "ru").count() == 0
    spark.createDataFrame([(2,)], "schema_version int").write.mode("overwrite").parquet(f"file://{tmp_path}/g/meta.parquet")
    with pytest.raises(ValueError, match="version mismatch"):
        store.open_gazetteer(spark, f"file://{tmp_path}/g")


def test_text_files(spark, tmp_path):
    for name, raw in {"u.txt": "Привет".encode(), "c.TXT": "тест слова".encode("cp1251"), "k.txt": "тест слова".encode("koi8-r"), "b.txt": bytes([0xFF, 0x80]), "x.pdf": b"x", "big.txt": b"x" * 1024}.items():
        (tmp_path / name).write_bytes(raw)
    assert text_files.load_text(spark, f"{tmp_path}/u.txt").first().text == "Привет"
    assert text_files.load_text(spark, f"{tmp_path}/c.TXT").first().text == "тест слова"
    assert text_files.load_text(spark, f"{tmp_path}/k.txt").first().text == "тест слова"
    for name, error, mb in (("x.pdf", ValueError, 2), ("none.txt", FileNotFoundError, 2), ("big.txt", ValueError, 0.0001)):
        with pytest.raises(error):
            text_files.load_text(spark, f"{tmp_path}/{name}", mb)


def test_config(tmp_path):
    c = parse_config({"confidence": 0.5, "locale": "ru", "inaturalist": {"burst_limit": 2}, "llm_enricher": {"provider": "ollama", "model": "m"}})
    assert c.inaturalist.burst_limit == 2 and c.llm_enricher.timeout == 30 and c.llm_extractor is None
    for bad in ({}, {"confidence": 2, "locale": "ru"}, {"confidence": 1, "locale": "r"}, {"confidence": 1, "locale": "ru", "x": 1}, {"confidence": True, "locale": "ru"}, {"confidence": 1, "locale": "ru", "llm_extractor": {"provider": "p", "model": "m"}}):
        with pytest.raises(ValueError, match="Invalid config"):
            parse_config(bad)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.json")


def test_token_bucket_and_http():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = providers.TokenBucket(1.0, 2, lambda: now[0], sleep)
    for _ in range(4):
        bucket.acquire()
    assert abs(sum(slept) - 2) < 1e-6
    replies = iter([(429, ""), (500, ""), (200, "ok")])
    assert providers.fetch("u", {}, 1, 3, lambda *a: next(replies), lambda s: None) == "ok"
    with pytest.raises(RuntimeError, match="404"):
        providers.fetch("u", {}, 1, 3, lambda *a: (404, ""), lambda s: None)
    assert providers.reply_of("ollama", 200, '{"message": {"content": "x"}}') == "x" and providers.reply_of("anthropic", 200, '{"content": [{"text": "y"}]}') == "y"
    for status, body in ((500, ""), (200, "{}"), (200, "x")):
        with pytest.raises(providers.LlmError):
            providers.reply_of("openai", status, body)
    with pytest.raises(ValueError, match="Unknown LLM provider"):
        providers.request_of("x", "m", None, "", "", "")


def test_checkpoints(spark, tmp_path):
    a, b = Config(0.5, "ru"), Config(0.6, "ru")
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, text string")
    keyed = pipeline.checkpoint_keys(docs, a)
    assert {r.doc_id: r.key for r in keyed.collect()} == {1: pipeline.checkpoint_key("x", a), 2: pipeline.checkpoint_key("y", a)} and pipeline.checkpoint_key("x", b) != pipeline.checkpoint_key("x", a)
    held = pipeline.StageStore(spark, f"file://{tmp_path}/s")
    held.save(keyed.where("doc_id = 1"))
    assert [r.doc_id for r in held.pending(keyed).collect()] == [2] and [r.doc_id for r in held.load(keyed).collect()] == [1]
    held.clear()
    assert held.pending(keyed).count() == 2


def test_streaming(spark, tmp_path):
    from binomia.operators import latin
    from binomia.streaming import documents

    spark.createDataFrame([(1, "Tilia cordata"), (2, "none")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/in")
    q = documents.extract_stream(spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/in"), latin.latin_mentions, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert [r.source_text for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["Tilia cordata"]


def test_build(spark):
    checklist = spark.createDataFrame([("Tilia",), ("Acer",), ("Known",)], "taxon_name string")
    have = spark.createDataFrame([(5, "Known", "genus", None)], store.TAXA)
    todo = store.missing_taxa(checklist, have)
    responses = spark.createDataFrame([("Tilia", response({"id": 3, "name": "Tilia", "rank": "genus", "names": [{"name": "Липа", "locale": "ru"}, {"name": "Linde", "locale": "de"}]}, {"id": 4, "name": "Tiliaceae"}))], "query string, response_json string")
    taxa, names, tags = store.build(todo, responses, ["ru", "en"], "tree")
    assert [tuple(r)[:3] for r in taxa.collect()] == [(3, "Tilia", "genus")] and [(r.name_normalized, r.locale, r.is_preferred) for r in names.collect()] == [("липа", "ru", True)] and tags.count() == 1


def test_prompt():
    assert llm_names.with_locale("a {{locale}} {{locale}}", "ru") == "a ru ru"
