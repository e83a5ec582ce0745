import itertools
import random

import corpus_pipeline
import pytest
from binomia.llm import near_copies


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_first(rows):
    """The smallest ids of the components of pairs with a Jaccard similarity of 0.8 or more."""
    sets = {i: brute_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) > 0:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("pairwise", [2, 32])
def test_made_copies_against_brute_force(spark, pairwise):
    """Near copies around the limit, a large group of them, chains, and a line that most texts share."""
    r = random.Random(5)
    line = [f"line{i}" for i in range(12)]
    texts = []
    for base in range(25):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([6, 40, 120]))] + line * (base % 2)
        texts += [words] + [edited(r, words, r.randrange(5)) for _ in range(80 if base == 3 else 3)]
        texts.append(edited(r, texts[-1], 2))
    r.shuffle(texts)
    rows = list(enumerate(map(" ".join, texts)))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), pairwise=pairwise).collect()
    assert len(got) == len(rows) and {x.component_id for x in got} == brute_first(rows)


def test_stage_drops_similar_texts_beyond_two_bits(spark):
    """The stage on documents of sf0.01, where pairs with a similarity of 0.8 lie five bits and more apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.dedup(spark, docs, "/root/testdata/sf0.01")
    assert {x.doc_id for x in kept.collect()} == brute_first([(x.doc_id, x.text) for x in docs.collect()])


def test_sketches_bound_what_sets_share():
    r = random.Random(8)
    for _ in range(300):
        a = {r.getrandbits(64) for _ in range(r.choice([0, 1, 9, 70, 600]))}
        b = {x for x in a if r.random() < 0.9} | {r.getrandbits(64) for _ in range(r.choice([0, 3, 200]))}
        x, y = (near_copies.np.array(sorted(s), near_copies.np.uint64) for s in (a, b))
        most = near_copies.at_most(near_copies.sketch(x), near_copies.sketch(y))
        assert most is None and not (a and b) or len(a & b) <= most <= min(len(a), len(b))
    same = near_copies.np.arange(3000, dtype=near_copies.np.uint64)  # all in one range: too many for a byte
    assert near_copies.sketch(same) == b"" and near_copies.at_most(b"", near_copies.sketch(same)) is None


def test_odd_rows(odd_docs, no_docs):
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(odd_docs).collect()}
    assert len(near_copies.near_copies(odd_docs).collect()) == 13
    assert got[2] == got[3] == got[4] == 2 and got[5] == got[6] == 5 and got[7] == 7
    assert near_copies.near_copies(no_docs).collect() == [] and near_copies.keep_first(no_docs).collect() == []


def test_simhash_brings_close_sets_together(spark):
    """All sets within five bits of SimHash share a bucket; the pairs confirmed there are near copies and join most of them."""
    r = random.Random(11)
    rows = []
    for _ in range(40):
        words = [f"w{r.randrange(500)}" for _ in range(300)]
        rows += [" ".join(words)] + [" ".join(edited(r, words, 1 + k)) for k in range(3)]
    texts = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    own = near_copies._sets_of(texts)
    each = own.groupBy("fp").agg(*[near_copies.F.first(c).alias(c) for c in ("n", "bits", "sketch")], near_copies.F.min("doc_id").alias("first"))
    sets = {x.doc_id: x for x in own.collect()}
    for i, t in enumerate(rows):
        hashes = near_copies.shingles(t.encode()).tolist()
        assert sets[i].bits & 2**64 - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    together = {}
    for x in near_copies.alike(each).collect():
        together.setdefault(x.token, set()).add(x.fp)
    met = {frozenset(p) for s in together.values() for p in itertools.combinations(s, 2)}
    close = {frozenset((a.fp, b.fp)) for a, b in itertools.combinations(sets.values(), 2) if ((a.bits ^ b.bits) & 2**64 - 1).bit_count() <= 5}
    assert close and close <= met
    of = {x.fp: near_copies.shingles(rows[i].encode()) for i, x in sets.items()}
    found = near_copies.by_simhash(each, texts).collect()
    shared = lambda a, b: len(near_copies.np.intersect1d(of[a], of[b]))
    assert all(5 * shared(x.u, x.v) >= 4 * (len(of[x.u]) + len(of[x.v]) - shared(x.u, x.v)) for x in found)
    joined = near_copies.components(spark.createDataFrame(found)).collect()
    assert len(joined) - len({x.label for x in joined}) >= 60  # of 120


def test_pairs_of_a_crowd_are_given_once(spark):
    """Texts that share many shingles and are no near copies: their pairs come once and not for each shingle."""
    r = random.Random(12)
    words = [f"c{i}" for i in range(120)]
    rows = list(enumerate(" ".join(edited(r, words, 2)) for _ in range(60)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    met = near_copies.buckets(texts, len(rows))
    m = met.groupBy("token").agg(near_copies.F.count("*").alias("m")).where("m > 1")
    t = near_copies._ratio(0.8)
    split = near_copies._placed(met.join(m, "token").withColumn("label", near_copies.F.col("fp")), t)
    pairs = near_copies._crossing(split, t, 2).selectExpr("least(u, v) as u", "greatest(u, v) as v")
    assert 0 < pairs.count() <= 3 * pairs.distinct().count()
    assert {x.component_id for x in near_copies.near_copies(texts, pairwise=2).collect()} == brute_first(rows)


def test_a_family_of_edited_copies_is_not_paired_off(spark, monkeypatch):
    """Edited copies of one text, most pairs of which are not near copies: the last round has few candidates."""
    r = random.Random(13)
    base = [f"f{i}" for i in range(150)]
    rows = list(enumerate(" ".join(edited(r, base, r.choice([1, 2, 2, 3, 4]))) for _ in range(240)))
    met, likely = [], near_copies._likely
    monkeypatch.setattr(near_copies, "_likely", lambda pairs, *rest: met.append(pairs.selectExpr("least(u, v)", "greatest(u, v)").distinct().count()) or likely(pairs, *rest))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == brute_first(rows)
    assert met[-1] < 5 * len(rows)


@pytest.mark.parametrize("typical", [1, 64])
@pytest.mark.parametrize("similarity", [0.8, 0.6, 1])
def test_a_family_is_settled_whatever_its_typical_set(spark, monkeypatch, typical, similarity):
    """Families of edited copies, of two bases' and of unlike texts: the links found join what brute force joins, and are links."""
    monkeypatch.setattr(near_copies, "TYPICAL", typical)
    r = random.Random(14)
    bases = [[f"b{k}x{i}" for i in range(n)] for k, n in enumerate([90, 90, 30, 7])]
    made = [(1, edited(r, bases[0], r.randrange(6))) for _ in range(40)]
    made += [(2, edited(r, bases[r.randrange(2)], r.randrange(4))) for _ in range(30)]
    made += [(3, edited(r, bases[2], 1)[: r.randrange(20, 31)]) for _ in range(20)]
    made += [(4, [f"u{r.randrange(10**6)}" for _ in range(r.choice([3, 40]))]) for _ in range(10)] + [(4, bases[3]), (4, bases[3][1:])]
    rows = list({" ".join(words): (i, " ".join(words), family) for i, (family, words) in enumerate(made)}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, family long")
    texts = docs.select("doc_id", "text")
    each = near_copies._sets_of(texts).withColumnRenamed("doc_id", "first")
    families = each.join(docs, each["first"] == docs["doc_id"]).selectExpr("fp", "fp as label", "family")
    t = near_copies._ratio(similarity)
    near, may = near_copies._relatives(near_copies._differences(families, texts, each, t), t)
    id_of = {x.fp: x["first"] for x in each.collect()}
    near, may = ({tuple(sorted((id_of[e.u], id_of[e.v]))) for e in d.collect()} for d in (near, may))
    sets, family = {i: brute_shingles(text) for i, text, _ in rows}, {i: f for i, _, f in rows}
    linked = {
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if family[a] == family[b] and (t.numerator + t.denominator) * len(sets[a] & sets[b]) >= t.numerator * (len(sets[a]) + len(sets[b]))
    }

    def groups(edges):
        root = {i: i for i in sets}
        for a, b in sorted(edges):
            old, new = root[a], root[b]
            root = {i: new if x == old else x for i, x in root.items()}
        return {frozenset(i for i in sets if root[i] == x) for x in root.values()}

    assert near <= linked and groups(near | may & linked) == groups(linked)
    assert bool(linked) == (similarity < 1)
