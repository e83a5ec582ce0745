"""Quality rules: how far a document's characters and common words diverge from its language's.

Two histograms of each whole text, one of character classes and one of the language's common words (with a bin for all
other words), are compared with the language's reference by Jensen-Shannon distance (base 2, its square root). A
document is kept if both distances are within limits; short documents, whose histograms are noisy, have wider limits,
and below MIN_WORDS no distance is tested. The counts of the base rules (symbols, repeated lines, words in repeated
three-word windows) come along.

DataFrame functions only. Repeated windows are found within the row: window hashes are packed with their positions,
sorted as longs, and compared with their neighbours, so the work is n log n in the words of one text and nothing is
shuffled. Each step is a column that the next refers to more than once, which keeps Catalyst from inlining it into
lambdas, where it would run once an element.

Defined results: a null text has no words and fails the base rules, like an empty one; a language without a reference
(or none) is held against the nearest of all references; rows with null ids and repeated rows are judged like others; an
empty table gives no rows. Columns other than doc_id, text and lang are not read (keep_good() returns them untouched).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused_name

# Shares of character classes (lower case, upper case, digit, white space, punctuation, other) and of the
# most common words, measured over the documents labelled good of the 0.1 test tables.
REFERENCES = {
    "de": {
        "classes": [0.8103, 0.0128, 0.0004, 0.1546, 0.0218, 0.0001],
        "words": {"der": 0.0547, "die": 0.0287, "und": 0.0230, "in": 0.0167, "den": 0.0143, "von": 0.0116, "zu": 0.0099, "das": 0.0096, "mit": 0.0080, "sich": 0.0077, "des": 0.0067, "auf": 0.0065, "für": 0.0058, "ist": 0.0053, "im": 0.0049, "der.": 0.0049, "die,": 0.0047, "dem": 0.0047, "nicht": 0.0046, "eine": 0.0045},
    },
    "en": {
        "classes": [0.7952, 0.0138, 0.0006, 0.1667, 0.0236, 0.0001],
        "words": {"the": 0.0553, "of": 0.0286, "and": 0.0232, "to": 0.0168, "a": 0.0138, "in": 0.0117, "is": 0.0105, "that": 0.0092, "it": 0.0079, "for": 0.0077, "was": 0.0068, "on": 0.0065, "with": 0.0058, "as": 0.0052, "be": 0.0048, "by": 0.0048, "of,": 0.0045, "the.": 0.0045, "this": 0.0045, "are": 0.0045},
    },
    "es": {
        "classes": [0.8011, 0.0135, 0.0008, 0.1615, 0.0230, 0.0001],
        "words": {"de": 0.0551, "la": 0.0288, "que": 0.0222, "el": 0.0165, "en": 0.0142, "y": 0.0114, "los": 0.0105, "se": 0.0090, "las": 0.0086, "del": 0.0076, "un": 0.0069, "por": 0.0068, "con": 0.0057, "no": 0.0055, "una": 0.0050, "su": 0.0048, "para": 0.0047, "la,": 0.0045, "de.": 0.0044, "al": 0.0044},
    },
    "fr": {
        "classes": [0.7946, 0.0140, 0.0008, 0.1667, 0.0238, 0.0001],
        "words": {"de": 0.0551, "la": 0.0300, "le": 0.0221, "et": 0.0169, "les": 0.0140, "des": 0.0118, "en": 0.0113, "un": 0.0095, "du": 0.0079, "une": 0.0072, "que": 0.0066, "pour": 0.0064, "est": 0.0062, "dans": 0.0051, "qui": 0.0050, "de.": 0.0047, "la,": 0.0046, "par": 0.0044, "au": 0.0044, "sur": 0.0043},
    },
}
#: Least words for a distance to count; below LONG_WORDS the SHORT limits hold.
MIN_WORDS, LONG_WORDS = 50, 100
CLASS_LIMIT, SHORT_CLASS_LIMIT = 0.22, 0.28
WORD_LIMIT, SHORT_WORD_LIMIT = 0.27, 0.38
REPEAT_PERCENT = 50
WS = " \t\n\x0b\f\r"
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"\x20\x09-\x0D", r".,;:'\x22!?()-"]


def _count(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def _mixed(p: Column, q: Column) -> Column:
    """The summand of 2 x divergence for one bin."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return part(p) + part(q)


def _distance(parts: Column) -> Column:
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def assessed(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> tuple[DataFrame, dict[str, str]]:
    """docs with all its columns and those of the rules; the latter's names by what they hold."""
    names = {k: unused_name(f"_q_{k}", docs.columns) for k in ("t", "w", "h", "b", "p", "q", "f", "cc", "lang", "n", "wc", "sym", "dup", "rep", "failed", "dc", "dw", "kept")}
    c = {k: F.col(v) for k, v in names.items()}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn(names["t"], text)
    out = out.withColumn(names["lang"], F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string"))
    out = out.withColumn(names["w"], F.filter(F.split(F.trim(c["t"], F.lit(WS)), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    # Each of these refers to w, h, b or p several times: see above.
    size = F.size(c["w"])
    window = lambda i: F.xxhash64(F.get(c["w"], i), F.get(c["w"], i + 1), F.get(c["w"], i + 2))
    out = out.withColumns({
        names["n"]: size.cast("long"),
        names["wc"]: F.length(F.array_join(c["w"], "")).cast("long"),
        names["h"]: F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), window)).otherwise(F.array().cast("array<bigint>")),
        names["b"]: F.length(F.bin(size)),
    })
    common = sorted({w for r in REFERENCES.values() for w in r["words"]})
    known = F.filter(F.transform(c["w"], lambda x: F.lower(x)), lambda x: x.isin(common))
    out = out.withColumns({
        names["p"]: F.sort_array(F.transform(c["h"], lambda h, i: F.call_function("shiftleft", F.call_function("shiftright", h, c["b"]), c["b"]).bitwiseOR(i.cast("long")))),
        names["f"]: known,
    })
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), c["b"]) - 1

    def same(x: Column, other: Column) -> Column:
        shift = lambda v: F.call_function("shiftright", v, c["b"])
        at = lambda v: F.get(c["h"], v.bitwiseAND(mask).cast("int"))
        return F.coalesce((shift(x) == shift(other)) & (at(x) == at(other)), F.lit(False))

    repeated = F.filter(c["p"], lambda x, j: same(x, F.get(c["p"], j - 1)) | same(x, F.get(c["p"], j + 1)))
    out = out.withColumn(names["q"], F.when(F.size(c["p"]) > F.size(F.array_distinct(c["h"])), F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(mask)))).otherwise(F.array().cast("array<bigint>")))
    covered = F.transform(c["q"], lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(c["q"], j + 1) - p, F.lit(3).cast("long"))))
    lines = F.filter(F.split(c["t"], "\n"), lambda x: F.length(F.trim(x, F.lit(WS))) > 0)
    out = out.withColumns({
        names["sym"]: _count(c["t"], r"#*$%&|<>").cast("long"),
        names["dup"]: F.when(F.contains(c["t"], F.lit("\n")), F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]).otherwise(0).cast("long"),
        names["rep"]: F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
        names["cc"]: F.array(*[_count(c["t"], k).cast("double") for k in CLASSES]),
    })
    chars = F.greatest(F.length(c["t"]), F.lit(1)).cast("double")
    shares = F.concat(F.transform(c["cc"], lambda x: x / chars), F.array((F.length(c["t"]) - F.aggregate(c["cc"], F.lit(0.0), lambda a, x: a + x)) / chars))

    def class_distance(lang: str) -> Column:
        ref = F.array(*[F.lit(x) for x in REFERENCES[lang]["classes"]])
        return _distance(F.zip_with(shares, ref, _mixed))

    def word_distance(lang: str) -> Column:
        words = REFERENCES[lang]["words"]
        total = F.greatest(c["n"], F.lit(1)).cast("double")
        counts = F.array(*[(F.size(c["f"]) - F.size(F.array_remove(c["f"], F.lit(w)))) / total for w in words])
        with_rest = F.transform(F.array(counts), lambda p: F.concat(p, F.array(F.lit(1.0) - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))))[0]
        ref = F.array(*[F.lit(x) for x in words.values()], F.lit(1.0 - sum(words.values())))
        return _distance(F.zip_with(with_rest, ref, _mixed))

    def by_language(distance) -> Column:
        chosen = F.array_min(F.array(*[distance(k) for k in REFERENCES]))
        for k in REFERENCES:
            chosen = F.when(c["lang"] == k, distance(k)).otherwise(chosen)
        return chosen

    out = out.withColumns({
        names["failed"]: (c["n"] < 50) | (c["rep"] * 100 > c["n"] * REPEAT_PERCENT),
        names["dc"]: by_language(class_distance),
        names["dw"]: by_language(word_distance),
    })
    limit = lambda far, near: F.when(c["n"] >= LONG_WORDS, far).otherwise(near)
    good = (c["n"] < MIN_WORDS) | ((c["dc"] <= limit(CLASS_LIMIT, SHORT_CLASS_LIMIT)) & (c["dw"] <= limit(WORD_LIMIT, SHORT_WORD_LIMIT)))
    return out.withColumn(names["kept"], ~c["failed"] & good), names


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the two distances, for each row of docs."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(lang_col).alias("lang")] if lang_col else []))
    out, names = assessed(own, "text", "lang" if lang_col else None)
    shown = {"n": "n_words", "wc": "word_chars", "sym": "n_symbols", "dup": "n_dup_lines", "rep": "n_repeat_words", "failed": "base_failed", "kept": "kept", "dc": "class_distance", "dw": "word_distance"}
    verdict = F.struct(*[F.col(names[k]).alias(v) for k, v in shown.items()])
    return out.select("doc_id", F.explode_outer(F.array(verdict)).alias("_v")).select("doc_id", "_v.*")  # see keep_good()


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    out, names = assessed(docs, text_col, lang_col)
    kept = unused_name("_kept", out.columns)
    # As a plain filter the verdict would be pushed below the columns it is made of, with all of them inlined; a
    # generator's output is not.
    return out.select(*docs.columns, F.explode_outer(F.array(names["kept"])).alias(kept)).where(kept).select(*docs.columns)


def oracle_sql() -> str:
    """The same result in DuckDB, from the same constants."""

    def distance(p: list[str], q: list[float]) -> str:
        part = lambda x, m: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END)"
        return "sqrt(greatest((" + " + ".join(part(a, f"(({a} + {b}) / 2)") + " + " + part(f"{b}", f"(({a} + {b}) / 2)") for a, b in zip(p, q, strict=True)) + ") / 2, 0))"

    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    pattern = lambda k: k.replace("'", "''")
    shares = [f"(c{i} / chars)" for i in range(len(CLASSES))] + ["((chars - c0 - c1 - c2 - c3 - c4) / chars)"]
    word_case, class_case = [], []
    for k, r in REFERENCES.items():
        names = [f"coalesce(k[{quoted(w)}], 0)" for w in r["words"]]
        p = [f"({x} / total)" for x in names] + [f"(1 - ({' + '.join(names)}) / total)"]
        word_case.append((k, distance(p, [*r["words"].values(), 1.0 - sum(r["words"].values())])))
        class_case.append((k, distance(shares, r["classes"])))
    case = lambda xs: "CASE " + " ".join(f"WHEN lang = '{k}' THEN {x}" for k, x in xs) + " ELSE least(" + ", ".join(x for _, x in xs) + ") END"
    common = ", ".join(quoted(w) for w in sorted({w for r in REFERENCES.values() for w in r["words"]}))
    return rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, lang, coalesce(text, '') t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) i FROM d),
n AS (SELECT r, count(*) n, sum(length(w)) wc FROM w GROUP BY r),
k AS (SELECT r, map_from_entries(list((w, c))) k FROM (SELECT r, lower(w) w, count(*) c FROM w WHERE lower(w) IN ({common}) GROUP BY ALL) GROUP BY r),
g AS (SELECT r, i, w a, lead(w) OVER x b, lead(w, 2) OVER x c FROM w WINDOW x AS (PARTITION BY r ORDER BY i)),
e AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) m FROM g WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT j) rep FROM (SELECT r, unnest([i, i + 1, i + 2]) j FROM e WHERE m > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) dup FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
a AS (SELECT d.doc_id, d.lang, coalesce(n, 0)::BIGINT n_words, coalesce(wc, 0)::BIGINT word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT n_symbols, coalesce(dup, 0)::BIGINT n_dup_lines, coalesce(rep, 0)::BIGINT n_repeat_words,
  greatest(length(t), 1)::DOUBLE chars, greatest(coalesce(n, 0), 1)::DOUBLE total, coalesce(k, MAP {{}}) k,
  {", ".join(f"length(regexp_replace(t, '[^{pattern(c)}]+', '', 'g'))::DOUBLE c{i}" for i, c in enumerate(CLASSES))}
  FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words base_failed, {case(class_case)} class_distance, {case(word_case)} word_distance FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {MIN_WORDS} OR (class_distance <= CASE WHEN n_words >= {LONG_WORDS} THEN {CLASS_LIMIT} ELSE {SHORT_CLASS_LIMIT} END
  AND word_distance <= CASE WHEN n_words >= {LONG_WORDS} THEN {WORD_LIMIT} ELSE {SHORT_WORD_LIMIT} END)) kept
FROM b"""
