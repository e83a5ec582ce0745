import hashlib
import random

import numpy as np
import pyarrow as pa
import tiktoken
from binomia.llm import byte_bpe, registry
from hypothesis import given, settings
from hypothesis import strategies as st

V = byte_bpe.load(*byte_bpe.default_vocabulary())
T = tiktoken.Encoding("own", pat_str=byte_bpe.default_vocabulary()[1], mergeable_ranks=V.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ab'\n\t,.!1é日"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=5))
def test_encoding_is_the_librarys(texts):
    for text, ids in zip(texts, V.encode_batch(pa.array(texts)), strict=True):
        assert ids.tolist() == T.encode_ordinary(text)
        assert V.decode(ids) == text.encode()


def test_long_pieces():
    for text in ("a" * 4000, " " * 2000, "ab" * 2000, "<|endoftext|>"):
        assert V.encode(text) == T.encode_ordinary(text)


def test_appends_and_edits():
    r = random.Random(5)
    data = bytes(r.choice(b"theandofing") for _ in range(1500))
    table = byte_bpe.PrefixTable(V, data[:700])
    table.append(data[700:])
    assert table.tokens() == byte_bpe.PrefixTable(V, data).tokens()
    for start, end, new in ((0, 3, b"xy"), (300, 300, b"hello"), (700, 760, b""), (1480, 1500, b"q")):
        work = table.replace(start, end, new)
        data = data[:start] + new + data[end:]
        assert table.data == data and table.tokens() == byte_bpe.PrefixTable(V, data).tokens()
        assert work <= 600


def test_roundtrip(spark, odd_docs, no_docs):
    got = byte_bpe.decode(byte_bpe.encode(odd_docs)).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got) == sorted((r.doc_id or 0, (r.text or "").encode()) for r in odd_docs.collect())
    by_id = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got}
    assert by_id[8] == T.encode_ordinary(next(r.text for r in odd_docs.collect() if r.doc_id == 8)) and by_id[2] == []
    assert byte_bpe.decode(byte_bpe.encode(no_docs)).collect() == []


def test_query(spark, sample):
    got = {r.doc_id: r for r in registry.QUERIES["op4_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in sample.collect():
        ids = T.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
