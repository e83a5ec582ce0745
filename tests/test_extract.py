import re

import pytest
from binomia.functions.spans import pattern_spans
from binomia.operators import chunking, gazetteer, latin, segment
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


LATIN = [
    ("We saw Tilia cordata.", [("Tilia cordata", 7, 1)]), ("This is in situ and should be ignored.", []), ("We saw Ab ca in the notes.", []), ("Mr. Tilia cordata visited yesterday.", []), ("Line one\nTilia cordata.", [("Line one", 0, 1), ("Tilia cordata", 9, 2)]),
    ("We saw tilia cordata near the river.", []), ("met von Tilia cordata", [("Tilia cordata", 8, 1)]), ("Tilia cordata in bloom", []), ("Status quo ante", [("Status quo ante", 0, 1)]), ("Et cetera", []),
    ("Prof . \n Tilia cordata Dr. Acer campestre", []), ("ЯTilia cordata и Quercus robur", [("Quercus robur", 17, 1)]), ("", []), ("\x01Tilia cordata\x02", [("Tilia cordata", 1, 1)]),
]


def test_latin_mentions(spark):
    got = {}
    for r in latin.latin_mentions(docs(spark, *[t for t, _ in LATIN])).collect():
        got.setdefault(r.doc_id, []).append((r.source_text, r.start_char, r.line_number))
    for i, (text, want) in enumerate(LATIN):
        assert sorted(got.get(i, [])) == want, text


def test_latin_confidence(spark):
    known = spark.createDataFrame([("TILIA cordata",)], "name string")
    found = latin.latin_mentions(docs(spark, "Tilia cordata, Acer campestre"))
    assert {r.source_text: r.confidence for r in latin.with_confidence(found, known).collect()} == {"Tilia cordata": 0.9, "Acer campestre": 0.7}
    assert latin.with_confidence(found, None).where("confidence <> 0.7").count() == 0


def test_spans_against_python(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.start_char, r.end_char, r.source_text) for r in pattern_spans(sample, r"(?U)\b\w{3,5}\b").collect()}
    assert got == {(r.doc_id, *m.span(), m[0]) for r in sample.collect() for m in re.finditer(r"\b\w{3,5}\b", r.text)}


def test_sentences(spark):
    text = "One two.  Three?! \"Four.\" Five… six\n. é"
    got = segment.sentences(docs(spark, text, "", "  ", "no end")).collect()
    assert [(r.start, r.text) for r in got if r.doc_id == 0] == [(0, "One two."), (10, "Three?!"), (18, '"Four."'), (26, "Five…"), (32, "six\n."), (38, "é")]
    assert [r.text for r in got if r.doc_id == 3] == ["no end"] and not [r for r in got if r.doc_id in (1, 2)]


def test_context(spark):
    d = docs(spark, "Yes. We saw Tilia cordata here. No.\nnext line.")
    found, spans = latin.latin_mentions(d), segment.sentences(d)
    assert segment.with_context(found, spans, d).first().source_context == "We saw Tilia cordata here."
    assert segment.with_context(found, spans.limit(0), d).first().source_context == "Yes. We saw Tilia cordata here. No."
    assert segment.expanded_context(found, spans).first().expanded_context == "Yes. We saw Tilia cordata here. No."
    assert segment.expanded_context(found, spans.limit(0)).first().expanded_context is None


NAMES = "id bigint, taxon_id bigint, name string, name_normalized string, name_lemmatized string, locale string, is_preferred boolean"


def test_gazetteer_mentions(spark):
    names = spark.createDataFrame([
        (1, 1, "Tilia cordata", "tilia cordata", "tilia cordata", "ru", True), (2, 2, "Липа", "липа", "липа", "ru", True), (3, 4, "Липа", "липа", "липа", "ru", False),
        (4, 3, "Ели", "ели", "ель", "ru", True), (5, 9, "Oak", "oak", None, "en", True), (6, 7, "", "", None, "ru", True),
    ], NAMES)
    d = docs(spark, "We saw Tilia cordata today.", "ЛИПА и ель, oak.", "Tilia")
    got = {(r.doc_id, r.source_text): (r.confidence, r.gazetteer_taxon_ids, r.start_char, r.line_number) for r in gazetteer.gazetteer_mentions(d, names, "ru").collect()}
    assert got == {(0, "Tilia cordata"): (1.0, [1], 7, 1), (1, "ЛИПА"): (0.8, [2, 4], 0, 1), (1, "ель"): (0.9, [3], 7, 1)}


def test_full_record(spark):
    taxa = spark.createDataFrame([(1, "Tilia", "genus", None), (2, "Acer", "genus", None)], "taxon_id bigint, taxon_name string, taxon_rank string, ancestry string")
    names = spark.createDataFrame([(1, 1, "Linden", "linden", None, "en", False), (2, 1, "Lime", "lime", None, "en", True), (3, 1, "Липа", "липа", None, "ru", False), (4, 1, "", "", None, "ru", True), (5, 1, "Linde", "linde", None, "de", True)], NAMES)
    got = {r.taxon_id: (r.common_en, r.common_loc) for r in gazetteer.full_records(taxa, names, "ru").collect()}
    assert got == {1: ("Lime", "Липа"), 2: (None, None)}


@pytest.mark.parametrize(
    ("text", "strategy", "least", "most", "by_sentences", "want"),
    [
        ("one two\n\nthree four five", "paragraph", 5, 500, True, ["one two three four five"]),
        ("1 2 3 4 5 6 7", "page", 5, 5, False, ["1 2 3 4 5", "6 7"]),
        ("a b c. d e f.", "page", 1, 3, True, ["a b c.", "d e f."]),
        ("a b\n\n1 2 3. 4 5 6. 7\n\nc", "paragraph", 4, 5, True, ["a b", "1 2 3.", "4 5 6. 7", "c"]),
        ("a b\n\n1 2 3 4 5 6 7\n\nc", "paragraph", 4, 5, False, ["a b", "1 2 3 4 5", "6 7", "c"]),
        ("", "paragraph", 5, 50, True, []),
    ],
)
def test_chunks(spark, text, strategy, least, most, by_sentences, want):
    got = chunking.chunks(docs(spark, text), strategy, least, most, by_sentences=by_sentences).orderBy("idx").collect()
    assert [r.chunk for r in got] == want


def test_sliding_windows(spark):
    ws = " ".join(map(str, range(230)))
    got = spark.range(1).select(chunking.sliding(F.lit(ws), 100, 50)).first()[0]
    assert [c.split()[0] for c in got] == ["0", "50", "100", "150"] and got[-1].split()[-1] == "229"
    with pytest.raises(ValueError, match="Unknown chunk strategy"):
        chunking.chunks(docs(spark, "x"), "line")


def test_spans_with_any_ids_and_marks(spark):
    """Rows with repeated or null ids are rows of their own; control characters of the text come out as they were."""
    rows = [(1, "See Quercus robur."), (1, "Hi\n\x01 Tilia cordata here.\x02 Dr. Pinus mugo"), (None, "Betula nana"), (None, "A\nBetula nana"), (2, None), (3, "")]
    own = spark.createDataFrame(rows, "doc_id int, text string")
    found = pattern_spans(own, "[A-Z][a-z]+ [a-z]+|[^a-zA-Z. \\n]").collect()
    got = sorted(((r.doc_id, r.start_char, r.end_char, r.source_text, r.line_number) for r in found), key=str)
    want = [(1, 4, 17, "Quercus robur", 1), (1, 3, 4, "\x01", 2), (1, 5, 18, "Tilia cordata", 2), (1, 24, 25, "\x02", 2), (1, 30, 40, "Pinus mugo", 2), (None, 0, 11, "Betula nana", 1), (None, 2, 13, "Betula nana", 2)]
    assert got == sorted(want, key=str)
    assert "\x01" in "".join(r.text for r in segment.sentences(own).collect())


def test_spans_move_nothing(spark):
    own = spark.createDataFrame([(1, "Quercus robur " * 3000)], "doc_id int, text string")
    found = latin.latin_mentions(own)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.start_char for r in pattern_spans(own, "Quercus").collect()] == [14 * i for i in range(3000)]


def test_title_far_before_a_name(spark):
    """A title counts across any number of full stops and spaces."""
    own = spark.createDataFrame([(1, "Dr" + "." * 200 + " Pinus mugo"), (2, "Dr" + " " * 90 + "." + " Pinus mugo"), (3, "word. Pinus mugo")], "doc_id int, text string")
    assert [r.doc_id for r in latin.latin_mentions(own).collect()] == [3]
