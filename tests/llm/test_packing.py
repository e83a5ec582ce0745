import binascii

import numpy as np
import pyarrow as pa
from binomia.llm import packing, registry
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(packing.default_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 64]))
def test_pack(sizes, capacity):
    pieces, by_doc, by_sequence = packing.pack(sizes, capacity), {}, {}
    for doc, start, length, sequence, offset in pieces:
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for own, total in ((by_doc, dict(enumerate(sizes))), (by_sequence, None)):
        for key, parts in own.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == total[key] if total else at == capacity or at & (at - 1) == 0 and at < capacity
    assert len(by_doc) == len(sizes)


def test_costs_are_balanced():
    """Equal documents, two to a sequence: none gets three while another has one."""
    pieces = packing.pack([32] * 64, 64)
    assert len({(d, s) for d, s, *_ in pieces}) == 64 and all(n == 32 for _, _, n, _, _ in pieces)


def check(rows, pieces):
    want = {}
    for r in rows:
        want.setdefault(r.doc_id, []).append([*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 0])
    got = {}
    for p in pieces:
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    for doc, lists in want.items():
        for ids in lists:
            parts = got[(doc, len(ids))]
            assert sum(n for _, n, _ in parts) % len(ids) == 0
            for start, length, crc in parts:
                if len(lists) == 1:
                    assert crc == binascii.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
    used = {}
    for p in pieces:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_query(spark, sample):
    check(sample.collect(), registry.QUERIES["op7_packing"](spark, "/root/testdata/sf0.001").collect())


def test_edges(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    check(odd_docs.collect(), packing.packed(odd_docs).withColumn("ids_crc32", F.crc32("ids")).collect())
    assert packing.packed(no_docs).collect() == []


BITS = ["a", "B", "word", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\u00a0", "\u3000", "\u00e9", "1", "23", "'s", ".", ",", "<|endoftext|>", "<|", "\U0001f600", "\u4e2d", "\r\n", "\x1c", "\x85", "\u200b"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=30).map("".join), max_size=20))
def test_ids_are_the_tokenizers(texts):
    """White space of all kinds and the special string, against the tokenizer as it comes from its file."""
    flat, bounds = packing.token_ids(pa.array(texts, pa.string()), packing.default_vocabulary())
    for i, text in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_strings(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3), (3, "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert 50256 in TOKENIZER.encode(rows[0][1], add_special_tokens=False).ids
    check(docs.collect(), packing.packed(docs, digest=True).collect())


def test_block_is_encoded_in_parts(monkeypatch):
    """No more than a part's bytes are encoded at once (or one text); ids are those of the whole block."""
    texts = [f"some words {i} of a text, " * (i % 40) for i in range(300)] + [None, "", "one long text " * 900]
    block, path = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), packing.default_vocabulary()
    ids, bounds = packing.token_ids(block.column("text"), path)
    sizes, whole = [], packing.token_ids
    monkeypatch.setattr(packing, "PART_BYTES", 4096)
    monkeypatch.setattr(packing, "token_ids", lambda part, p: sizes.append((len(part), sum(len(x or "") for x in part.to_pylist()))) or whole(part, p))
    got, at = packing.block_ids(block, path)
    assert (got == ids).all() and (at == bounds).all()
    assert len(sizes) > 10 and all(rows == 1 or n <= 4096 for rows, n in sizes)
