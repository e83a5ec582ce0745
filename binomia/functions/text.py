"""Column functions over names and texts. Positions are code points, 0-based, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a word of a name: Latin and Cyrillic letters only.
NAME_WORD = "[A-Za-zА-Яа-яЁё]+"
CYRILLIC = "[А-Яа-яЁё]"
ANY_SPACE = r"(?U)\s+"


def normalize(c: Column) -> Column:
    """Lower case, then ё as е."""
    return F.translate(F.lower(c), "ё", "е")


def lemmatize(c: Column, lemmas: Column | None = None) -> Column:
    """Words' lemmas joined by spaces; lemmas is a map column from lower-case word to lemma, Cyrillic words alone use it.

    Without lemmas a word is just lower-cased and keeps its ё.
    """

    def one(word: Column) -> Column:
        lower = F.lower(word)
        if lemmas is None:
            return lower
        return F.when(word.rlike(CYRILLIC), normalize(F.coalesce(F.try_element_at(lemmas, lower), lower))).otherwise(lower)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(NAME_WORD), F.lit(0)), one), " ")


def search_variants(c: Column, lemmas: Column | None = None) -> Column:
    """Distinct query strings in order: lower case, normalised, lemma, normalised lemma; no empty ones."""
    lemma = lemmatize(c, lemmas)
    return F.array_distinct(F.filter(F.array(F.lower(c), normalize(c), lemma, normalize(lemma)), lambda x: x != ""))


def cyrillic_score(c: Column) -> Column:
    """Two points for a lower-case Cyrillic letter, one for a capital."""
    return 2 * F.regexp_count(c, F.lit("[а-яё]")) + F.regexp_count(c, F.lit("[А-ЯЁ]"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def words(c: Column) -> Column:
    """Runs between any white space."""
    return F.filter(F.split(c, ANY_SPACE), lambda x: x != "")


def strip_space(c: Column) -> Column:
    """Without any Unicode white space at the ends (trim() knows the space alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def line_number(text: Column, start: Column) -> Column:
    before = F.substring(text, F.lit(1), start)
    return (1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int")


def line_at(text: Column, number: Column) -> Column:
    """The line of this 1-based number."""
    return F.get(F.split(text, "\n"), number - 1)


def find_span(text: Column, name: Column) -> tuple[Column, Column]:
    """(start, end) of the first occurrence: exact, else ignoring case, else at 0 with the name's length."""
    at = F.position(name, text)
    lower = F.position(F.lower(name), F.lower(text))
    start = F.when(at > 0, at - 1).when(lower > 0, lower - 1).otherwise(0)
    return start, start + F.length(name)


def strip_fences(c: Column) -> Column:
    """A reply without its code fence; only if it begins with one."""
    inner = strip_space(F.regexp_replace(F.regexp_replace(c, r"^```[a-zA-Z]*\n", ""), r"```$", ""))
    return F.when(F.startswith(c, F.lit("```")), inner).otherwise(c)


def without_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


def parse_json(c: Column, ddl: str, probe: str) -> Column:
    """from_json of a reply; if that leaves field `probe` null, once more without trailing commas."""
    text = strip_fences(c)
    first, second = F.from_json(text, ddl), F.from_json(without_trailing_commas(text), ddl)
    return F.when(first[probe].isNotNull(), first).otherwise(second)


def filter_names(names: Column, candidate: Column | None = None) -> Column:
    """Trimmed, non-empty, distinct names in order; without those that normalise to the candidate."""
    trimmed = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), strip_space), lambda x: x != "")
    if candidate is not None:
        trimmed = F.filter(trimmed, lambda x: normalize(x) != candidate)
    return F.array_distinct(trimmed)
