import pytest
from binomia.functions import text as T
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("Ёж İ", "еж i̇"), ("", ""), ("TILIA", "tilia")])
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize) == want


@pytest.mark.parametrize(("text", "want"), [("Липа-ёлка 5 Tília", "липа ёлка t lia"), ("42 !", ""), ("Ёж Quercus", "ёж quercus")])
def test_lemmatize_without_lemmas(spark, text, want):
    assert one(spark, text, T.lemmatize) == want


def test_lemmatize_with_lemmas(spark):
    lemmas = F.create_map(F.lit("липы"), F.lit("липа"), F.lit("ёлки"), F.lit("ёлка"), F.lit("oaks"), F.lit("oak"))
    assert one(spark, "Липы ёлки Oaks ёж", lambda c: T.lemmatize(c, lemmas)) == "липа елка oaks еж"


def test_search_variants(spark):
    assert one(spark, "Ёлка Обыкновенная", T.search_variants) == ["ёлка обыкновенная", "елка обыкновенная"]
    assert one(spark, "Tilia-X", T.search_variants) == ["tilia-x", "tilia x"]
    assert one(spark, "", T.search_variants) == []


def test_cyrillic_score(spark):
    assert one(spark, "аЁ яZ", T.cyrillic_score) == 5


def test_json_repair(spark):
    ddl = "k bigint"
    for raw, want in (('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('{"k": 3, }', 3), ("not-json", None), (' ```\n{"k": 4}```', None)):
        assert one(spark, raw, lambda c: T.parse_json(c, ddl, "k")["k"]) == want


def test_find_span(spark):
    for text, name, want in (("a Tilia b", "Tilia", (2, 7)), ("a tilia b", "TILIA", (2, 7)), ("abc", "xyz", (0, 3)), ("", "x", (0, 1))):
        s, e = T.find_span(F.lit(text), F.lit(name))
        assert tuple(spark.range(1).select(s.alias("s"), e.alias("e")).first()) == want


def test_filter_names(spark):
    df = spark.createDataFrame([(["  Липа ", "липа", "", None, "Ёль", "Липа"],)], "x array<string>")
    assert df.select(T.filter_names(F.col("x"), F.lit("липа"))).first()[0] == ["Ёль"]
    assert df.select(T.filter_names(F.lit(None).cast("array<string>"))).first()[0] == []


def test_words_and_lines(spark):
    assert one(spark, " a b\n c ", T.word_count) == 3
    df = spark.createDataFrame([("l1\nl2\nl3", 4)], "t string, s int")
    assert df.select(T.line_number(F.col("t"), F.col("s")), T.line_at(F.col("t"), F.lit(2))).first() == (2, "l2")
