"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Base kinds (email, ip, card, phone) hold as soon as pattern and validator agree. The method adds kinds of its own: iban
(mod-97), ssn and local_phone (which need a context word nearby) and secret (a value after password, token or key).
Every span has a score: the kind's prior, more for a context word within CONTEXT code points, and a validator's bonus;
spans of added kinds below THRESHOLD are dropped. Text positions are code points, end exclusive. Patterns run in linear
time on any text: no run of letters or digits is scanned from each of its positions.

Defined results: a null text has no spans, like an empty one; rows with null ids and repeated rows are searched like
others; an empty table gives no rows; redacted() leaves null texts null and other columns untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, unused_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone", "secret")
CONTEXT, THRESHOLD = 48, 0.6
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.6, "phone": 0.7, "iban": 0.5, "ssn": 0.3, "local_phone": 0.3, "secret": 0.7}
CHECKED = {"card": 0.3, "iban": 0.4}
NEARBY = 0.35
CONTEXT_WORDS = {
    "email": r"e-?mail|contact|correo|courriel",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": r"iban|account|konto|compte|cuenta",
    "ssn": r"ssn|social security",
    "local_phone": r"phone|tel\b|tel[.:]|call|mobile|fax|telefon|téléphone|teléfono",
}
_CONTEXT = {k: re.compile(v, re.I) for k, v in CONTEXT_WORDS.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"\b(?:password|passwd|passwort|token|secret|api[_-]?key)[ ]?[=:][ ]?[\"']?([^\s\"']{8,})", re.I)
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, domain with a dot; each @ is met once and looks back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed in KINDS."""
    found: list[tuple[int, int, str, bool]] = []
    if "@" in text:
        found += [(s, e, "email", False) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), "ip", False) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [(*m.span(), "card", True) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(*m.span(), "phone", False) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        found += [(*m.span(), "iban", True) for m in _IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)]
        found += [(*m.span(), "ssn", False) for m in _SSN.finditer(text)]
        found += [(*m.span(), "local_phone", False) for m in _LOCAL_PHONE.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret", False) for m in _SECRET.finditer(text)]
    out = []
    for start, end, kind, checked in found:
        near = kind in _CONTEXT and bool(_CONTEXT[kind].search(text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]))
        score = min(1.0, PRIOR[kind] + NEARBY * near + CHECKED.get(kind, 0) * checked)
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((start, end, kind, score))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [[{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in find(t or "")] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, _SPANS)], names=["doc_id", "spans"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(own, run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(text: str) -> str:
    """text with each found span (overlapping ones as one, named by the first) replaced by its kind in brackets."""
    out, at, name = [], 0, ""
    start = end = -1
    for s, e, kind, _ in find(text):
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out += [text[at:start], name]
            at = end
        start, end, name = s, e, f"[{kind.upper()}]"
    if end >= 0:
        out += [text[at:start], name]
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with its columns; found spans are replaced in the text, and length_col, if docs has it, follows."""
    clean = unused_name("_redacted", docs.columns)
    names = docs.columns

    @F.pandas_udf("string")
    def replaced(texts):
        return texts.map(redact, na_action="ignore")

    out = docs.withColumn(clean, replaced(F.col(text_col).cast("string")))

    def shown(name: str) -> Column:
        if name == text_col:
            return F.col(clean).alias(name)
        if name == length_col:
            return F.when(F.col(clean).isNull(), F.col(name)).otherwise(F.length(clean)).cast(docs.schema[name].dataType).alias(name)
        return F.col(name)

    return out.select(*[shown(c) for c in names])
