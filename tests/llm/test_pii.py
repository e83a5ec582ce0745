import re

from binomia.llm import pii, registry
from hypothesis import given, settings
from hypothesis import strategies as st

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], list(PATTERNS).index(x[2])))


def base(text):
    return [x[:3] for x in pii.find(text) if x[2] in PATTERNS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+% 0123456789()é\n", max_size=60))
def test_base_against_brute_force(text):
    assert base(text) == brute(text)


def test_base_on_made_cases():
    for text in ("a@b.c@d.e x@y x@y.z", "999.1.1.1.5 01.02.003.255 1.2.3.4.5.6.7.8", "4111 1111-1111 1111 4111111111111112", "+1 (499) 555-6503, +1 2 3", "5500005555555559@x.y +49 30 1234567890", "ü@ä.de é.x@ex.com"):
        assert base(text) == brute(text)


def test_added_kinds():
    assert [x[2] for x in pii.find("IBAN DE89 3704 0044 0532 0130 00")] == ["iban"]
    assert [x[2] for x in pii.find("DE89 3704 0044 0532 0130 01")] == []
    assert [x[2] for x in pii.find("my ssn is 123-45-6789")] == ["ssn"] and pii.find("part 123-45-6789") == []
    assert [x[2] for x in pii.find("call me: 415-555-2671")] == ["local_phone"] and pii.find("code 415-555-2671") == []
    assert pii.find('token = "5310e9c025948e06"')[0][:3] == (9, 25, "secret")


def test_linear_on_long_runs():
    import time

    began = time.monotonic()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" + "(" * 200_000, "1 " * 100_000, "A" * 100_000 + "@" * 1000):
        pii.find(text)
    assert time.monotonic() - began < 20


def test_query(spark, sample):
    import hashlib

    got = {r.doc_id: r for r in registry.QUERIES["op5_pii"](spark, "/root/testdata/sf0.001").collect()}
    for r in sample.collect():
        want = brute(r.text)
        assert [got[r.doc_id][f"n_{k}"] for k in PATTERNS] == [sum(x[2] == k for x in want) for k in PATTERNS]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest()


def test_redaction(spark, odd_docs, no_docs):
    assert pii.redact("mail a@b.com or +1 (499) 555-6503.") == "mail [EMAIL] or [PHONE]."
    assert pii.redact("") == "" and pii.redact("clean text") == "clean text"
    out = pii.redacted(odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    assert sorted(map(str, out.collect())) == sorted(str(r) if r.text is None or r.n_chars == len(r.text) else str(type(r)(**(r.asDict() | {"n_chars": len(r.text)}))) for r in odd_docs.collect())
    assert pii.redacted(no_docs).collect() == [] and pii.spans(no_docs).collect() == []
    dirty = spark.createDataFrame([(1, "x a@b.com", 9)], "doc_id bigint, text string, n_chars bigint")
    assert pii.redacted(dirty).collect()[0][1:] == ("x [EMAIL]", 9)
    assert len(pii.spans(odd_docs).collect()) == odd_docs.count()


def test_long_secret_is_redacted_whole():
    for value in ("k" * 600, "eyJhbGciOi." * 400, "é" * 5000):
        text = f"before token={value} after"
        assert [x[:3] for x in pii.find(text) if x[2] == "secret"] == [(13, 13 + len(value), "secret")]
        assert pii.redact(text) == "before token=[SECRET] after"
