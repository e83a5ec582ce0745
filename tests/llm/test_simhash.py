import random
import re

import pytest
import xxhash
from binomia.llm import graph, simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    if len(words) == 3:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    """Smallest member of each value's component, over a set of values."""
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= radius:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}


def expected(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    label = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return sorted(((i, f"{f:016x}", least.get(label[f])) for i, f in fps), key=str)


def test_masks_cover_all_close_pairs():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7 and all(36 <= m.bit_count() <= 37 for m in masks)
    for i in range(64):
        for j in range(i, 64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_documents_against_brute_force(sample):
    got = sorted(map(tuple, simhash.near_duplicates(sample).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in sample.collect()])


def test_edges(odd_docs):
    got = sorted(map(tuple, simhash.near_duplicates(odd_docs).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("pairwise", [2, 16])
def test_links_join_what_brute_force_joins(spark, pairwise):
    """Random values with crowds around some of them, so that buckets of both kinds occur."""
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(60)}
    for base in list(values)[:6]:
        values |= {base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for _ in range(60)}
    signed = [(simhash._signed(x),) for x in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), pairwise=pairwise)
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    label = brute_components(values)
    groups, found = {}, {}
    for x in values:
        groups.setdefault(label[x], set()).add(simhash._signed(x))
        found.setdefault(got.get(simhash._signed(x), simhash._signed(x)), set()).add(simhash._signed(x))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u bigint, v bigint")
    assert {r.label for r in simhash.components(edges).collect()} == {0}


def test_long_chain_of_shuffled_values(spark, monkeypatch):
    """Values as fingerprints are, in no order along the chain; rounds are logarithmic in its length."""
    r, turns = random.Random(4), []
    ids = [r.getrandbits(64) - 2**63 for _ in range(5000)]
    one = graph._contracted
    monkeypatch.setattr(graph, "_contracted", lambda *a: turns.append(a) or one(*a))
    got = graph.components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "u bigint, v bigint")).collect()
    assert len(got) == 5000 and {x.label for x in got} == {min(ids)} and len(turns) <= 25


def test_shapes_against_brute_force(spark):
    """Stars, rings, cliques and single links, with values in no order, repeated and reversed links, loops and nulls."""
    r = random.Random(6)
    edges = []
    for size in (2, 3, 40, 90):
        for shape in ("star", "ring", "clique"):
            n = [r.getrandbits(62) for _ in range(min(size, 12) if shape == "clique" else size)]
            edges += {"star": [(n[0], x) for x in n[1:]], "ring": list(zip(n, n[1:] + n[:1], strict=True)), "clique": [(a, b) for a in n for b in n if a < b]}[shape]
    edges += [(b, a) for a, b in edges[::3]] + edges[::5] + [(7, 7), (None, 3), (4, None)]
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = label.get(a, a), label.get(b, b)
            label |= {k: min(x, y) for k in {a, b, *(k for k, v in label.items() if v in (x, y))}}
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == label
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_keep_first(odd_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 8, 9, 10] and ids.count(None) == 2


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_keep_first_where_ids_repeat(spark, similarity):
    """Different texts of one id are documents of their own; a copy under a larger id goes, and so does a repeated row."""
    a, b = " ".join(f"one{i}" for i in range(60)), " ".join(f"two{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (2, b, "y"), (1, a, "x"), (3, a, "z"), (4, "own words here", "z"), (None, a, "n")], "doc_id bigint, text string, _fp string")
    got = sorted(map(tuple, simhash.keep_first(docs, similarity=similarity).collect()), key=str)
    assert got == sorted([(1, a, "x"), (1, b, "x"), (4, "own words here", "z"), (None, a, "n")], key=str)
