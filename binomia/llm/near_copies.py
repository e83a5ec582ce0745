"""Groups of near copies by SimHash of word shingles, confirmed and completed by their exact Jaccard similarity.

Two texts link if the sets of their five-word shingles (as XXH64) have a Jaccard similarity of 0.8 or more; groups are
the components of these links. Candidates come first from SimHash: each set has a 64-bit fingerprint, and sets whose
fingerprints agree under one of 63 covering masks meet, which all within five bits do (simhash.py) and many of those beyond.

Pairs of a similarity just above 0.8 lie some ten bits apart, up to twenty, where masks that lose none would be hundreds of
thousands of tables. So what the bits leave apart is completed by prefix filtering, which loses no pair: with all shingles in one
order, two sets that are this similar share one among the first n - ceil(0.8 n) + 1 of each. Shingles that are frequent
in a sample of the texts come last in that order; the sample bears on the cost alone, any order gives the same groups.

Prefix shingles are dealt out by their hash once, those of several sets stay. A candidate pair is first held against
sketches (counts of hashes in equal ranges, some eight to a range), whose common part bounds the intersection from above; what
passes is confirmed by the intersection itself, for which texts of the sets in question alone are shingled again.

Equal sets cost one row. In each of two rounds, of SimHash buckets and of prefix buckets, a set is compared with a few leaders
of its buckets, which joins large groups of near copies at a cost in proportion to their size.

Sets that meet in large buckets are mostly edited copies of one text, many of them not quite near copies of one another. They are
told apart in families, each with a typical set: what most of some members have. How much two members share follows from where they
differ from it: all whose differences are few enough are near copies of the member with the fewest, and two others must differ from the typical set
in the same shingles, which are few and are dealt out in their turn. This settles every pair of a family, whatever its typical set.
Last, the pairs of each bucket that are still in different components and in no common family are all compared: a large bucket of unlike texts
that share a rare shingle costs pairs.

Defined results: a null text has no words, like an empty one, and all of these are copies of one another; a text of at
most five words is one shingle; rows with a null id are grouped like others but all stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, dropped, mapped, slices, written
from .graph import components
from .simhash import SEED, first_rows, labelled, masked, of_hashes, with_component

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Sets whose SimHashes differ in so many bits at most meet under a mask; more differing bits are left to the prefixes.
RADIUS = 5
#: Buckets of at most so many sets are compared pair by pair.
PAIRWISE = 32
#: With how many leaders of its buckets a set is compared at most: of the SimHash masks, then of the prefixes.
LEADERS = (4, 32)
#: Of so many members at most a family's typical set is made; any set gives the same groups.
TYPICAL = 64
#: So many of a set's shingles are looked at for an earlier one that a pair shares.
BEFORE = 8
#: About so many texts are read to find frequent shingles, of which so many at most are remembered.
SAMPLE, FREQUENT = 4000, 50_000
#: Parts that the rows of a frequent shingle are dealt out to.
SALTS = 64
_BYTES = 4 << 20


def shingles(raw: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct XXH64 of a UTF-8 text's shingles, ascending."""
    held = raw.lower().split()
    if not held:
        return np.empty(0, np.uint64)
    joined = b" ".join(held)
    if len(held) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
    ends = np.cumsum(lengths + 1) - 1
    cuts = map(slice, (ends - lengths)[: 1 - words].tolist(), ends[words - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), dtype=np.uint64, count=len(held) - words + 1))


def digest(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)


def _ratio(similarity: float) -> Fraction:
    if not 0.5 <= similarity <= 1:
        raise ValueError("a similarity from 0.5 to 1 is asked for")
    return Fraction(similarity).limit_denominator(1000)


def prefix(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 hashes by (count in the sample, hash)."""
    n, t = len(hashes), _ratio(similarity)
    if not n:
        return hashes
    rank = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: n + (-t.numerator * n // t.denominator) + 1]]


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes lie in each of 2^b equal ranges, one byte each; four to eight hashes a range. Empty where a byte is
    too small for a count."""
    bits = (len(hashes) // 8).bit_length()
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if len(hashes) and counts.max() < 256 else b""


def at_most(a: bytes, b: bytes) -> int | None:
    """What two sets of these sketches can have in common at most; None if the sketches don't tell."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sets_of(texts: DataFrame) -> DataFrame:
    """(doc_id, fp, n, bits, sketch): fp stands for the whole set, n is its size, bits is its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _BYTES):
            rows = [(digest(s), len(s), of_hashes(s), sketch(s)) for s in (shingles(raw or b"") for raw in as_bytes(part.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), _longs([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), _longs([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.binary())],
                names=["doc_id", "fp", "n", "bits", "sketch"],
            )

    return mapped(texts, run, "doc_id long, fp long, n long, bits long, sketch binary")


def alike(each: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(token, fp, n, p, q, r, label, before): the sets that share a covering mask's key of their SimHash with another, in the form of
    placed prefix buckets of sets that are components of their own."""
    rows = each.where("n > 0").select("fp", masked("bits", radius).alias("b")).select(F.xxhash64("b.t", "b.key").alias("token"), "fp")
    own = Window.partitionBy("token")
    met = rows.withColumns({"low": F.min("fp").over(own), "high": F.max("fp").over(own)}).where("low <> high").select("token", "fp")
    return written(met.join(each.select("fp", "n"), "fp").selectExpr("token", "fp", "n", "0L as p", "0L as q", "0L as r", "fp as label", "cast(array() as array<bigint>) as before"), "near-alike")


def _frequent(texts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of shingles that occur in several texts of the sample."""
    share = max(1, rows // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _BYTES):
            for raw in as_bytes(part.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(raw or b"").view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    met = mapped(some, run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    hashes, counts = np.array([r.h for r in met], np.int64).view(np.uint64), np.array([r.n for r in met], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def buckets(texts: DataFrame, rows: int, similarity: float = SIMILARITY) -> DataFrame:
    """(token, fp, n, p): the prefix shingles that several sets have; p is the shingle's place in the set's prefix."""
    known, counts = _frequent(texts, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a set is given once a task
        for part in slices(batches, "text", _BYTES):
            found = []
            for raw in as_bytes(part.column("text")):
                s = shingles(raw or b"")
                fp = digest(s)
                if len(s) and fp not in done:
                    done.add(fp)
                    found.append((prefix(s, known, counts, similarity), fp, len(s)))
            if not found:
                continue
            tokens, sizes = np.concatenate([f[0] for f in found]), np.array([len(f[0]) for f in found])
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hot = known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens if len(known) else np.zeros(len(tokens), bool)
            fps = np.repeat(np.array([f[1] for f in found], np.uint64), sizes)
            what = (np.repeat(np.array([f[2] for f in found], np.int64), sizes) << 32) | (places << 1) | hot
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(what)], names=["token", "fp", "what"])

    own = mapped(texts.select("text"), run, "token long, fp long, what long")
    # A frequent shingle is known to be shared; its rows need not meet and are dealt out to several tasks.
    hot = F.col("what").bitwiseAND(F.lit(1)) == 1
    dealt = Window.partitionBy("token", "salt")
    met = own.withColumn("salt", F.when(hot, F.pmod("fp", F.lit(SALTS))).otherwise(0)).withColumns({"low": F.min("fp").over(dealt), "high": F.max("fp").over(dealt)})
    met = met.where(hot | (F.col("low") != F.col("high"))).select("token", "fp", "what").distinct()
    return written(met.selectExpr("token", "fp", "shiftright(what, 32) as n", "shiftright(what & 4294967295L, 1) as p"), "near-buckets")


def _possible(a: str, b: str, t: Fraction, first: bool = False) -> str:
    """Whether two sets that share a shingle, at place p of the order in each, have sizes and places for the similarity t.
    What they share before it lies in open buckets of both, of which q come before. With first, they share none that is
    among the `before` of both: these are the last before it in an order that both have, so that whatever they do share is
    older than all of one set's, of which r are left."""
    most = f"least({a}.q, {b}.q{f', greatest({a}.r, {b}.r)' if first else ''}) + least({a}.n - {a}.p, {b}.n - {b}.p)"
    return f"{a}.fp <> {b}.fp and {t.numerator + t.denominator} * ({most}) >= {t.numerator} * ({a}.n + {b}.n)"


def _first(a: str, b: str, t: Fraction) -> str:
    """_possible() where no earlier bucket of a few gives the same pair."""
    return f"not arrays_overlap({a}.before, {b}.before) and {_possible(a, b, t, first=True)}"


def _placed(split: DataFrame, t: Fraction) -> DataFrame:
    """split with q, how many shingles of the set's open buckets come before this one; without rows that no partner of any
    size can make up for. A shingle that two sets share and that comes before another of their common prefix shingles
    is in both prefixes, so its bucket is open while they are in different components: other places count for nothing.
    before: the last few of these shingles; r: how many come before those."""
    own = Window.partitionBy("fp").orderBy("p")
    placed = split.withColumns({"q": F.row_number().over(own) - 1, "before": F.collect_list("token").over(own.rowsBetween(-BEFORE, -1))})
    return placed.withColumn("r", F.col("q") - F.size("before")).where(t.denominator * (F.col("q") + F.col("n") - F.col("p")) >= t.numerator * F.col("n"))


def _likely(pairs: DataFrame, each: DataFrame, t: Fraction) -> DataFrame:
    """The distinct (u, v) of pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for a, b, m, n in zip(*(part.column(k).to_pylist() for k in ("sa", "sb", "na", "nb")), strict=True):
                most = at_most(a, b)
                keep.append(most is None or (t.numerator + t.denominator) * most >= t.numerator * (m + n))
            yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    own = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a, b = each.select(F.col("fp").alias("u"), F.col("n").alias("na"), F.col("sketch").alias("sa")), each.select(F.col("fp").alias("v"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return written(mapped(own.join(a, "u").join(b, "v"), run, "u long, v long"), "near-pairs")


def _hashes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, hashes) for each fp of nodes (fp, first): its set is read from a text of that id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _BYTES):
            sets = [shingles(raw or b"") for raw in as_bytes(part.column("text"))]
            right = np.array([digest(s) for s in sets], np.uint64).view(np.int64) == part.column("fp").to_numpy()
            held = [s.view(np.int64) for s, ok in zip(sets, right, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([part.column("fp").filter(pa.array(right)), pa.array(held, pa.list_(pa.int64()))], names=["fp", "hashes"])

    own = texts.join(nodes.select("fp", F.col("first").alias("_first")), F.col("doc_id").eqNullSafe(F.col("_first"))).select("fp", "text")
    return written(mapped(own, run, "fp long, hashes array<long>").groupBy("fp").agg(F.first("hashes").alias("hashes")), "near-sets")


def _confirmed(pairs: DataFrame, texts: DataFrame, each: DataFrame, t: Fraction) -> DataFrame:
    """The (u, v) of pairs with a Jaccard similarity of t or more."""
    pairs = _likely(pairs, each, t)
    nodes = pairs.select(F.col("u").alias("fp")).unionAll(pairs.select("v")).distinct().join(each.select("fp", "first"), "fp")
    sets = _hashes(texts, written(nodes, "near-nodes"))
    a, b = sets.select(F.col("fp").alias("u"), F.col("hashes").alias("hu")), sets.select(F.col("fp").alias("v"), F.col("hashes").alias("hv"))
    both = pairs.join(a, "u").join(b, "v").withColumn("shared", F.size(F.array_intersect("hu", "hv")).cast("long"))
    enough = (t.numerator + t.denominator) * F.col("shared") >= t.numerator * (F.size("hu") + F.size("hv"))
    out = written(both.where(enough).select("u", "v"), "near-links")
    dropped(sets)
    dropped(pairs)
    return out


def _nominated(split: DataFrame, t: Fraction, turn: int, leaders: int) -> DataFrame:
    """At most so many (u, v) for each set: of its buckets' leaders in other components, those it shares most buckets with
    or, of prefix buckets, whose first shared shingle comes first. All buckets choose their leaders by the same order, so that
    near copies find the same few."""
    row, order = F.struct("fp", "n", "p", "q", "r", "label", "before"), F.xxhash64("fp", F.lit(turn))
    # One leader for each residue of the order: chosen by a minimum, so that no bucket is gathered.
    lead = split.groupBy("token", F.pmod(order, F.lit(leaders)).alias("part")).agg(F.min_by(row, order).alias("y")).groupBy("token").agg(F.collect_list("y").alias("ys"))
    met = split.select("token", row.alias("x")).join(lead, "token").select("x", F.explode(F.expr(f"filter(ys, y -> x.label <> y.label and {_first('x', 'y', t)})")).alias("y"))
    shared = met.groupBy(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).agg(F.count("*").alias("k"), F.min(F.expr("x.p + y.p")).alias("p"))
    best = Window.partitionBy("u").orderBy(F.desc("k"), "p", "v")
    return shared.withColumn("at", F.row_number().over(best)).where(F.col("at") <= leaders).select("u", "v")


def _families(split: DataFrame, t: Fraction, pairwise: int) -> DataFrame:
    """(fp, label, family): sets of large buckets, by the leader that most of these have; families of more than pairwise sets.
    A set that meets its leader in less than a quarter of its prefix is unlike it and in no family: its pairs are compared."""
    big = split.where(F.col("m") > pairwise)
    lead = big.groupBy("token").agg(F.min_by("fp", F.xxhash64("fp")).alias("lead"))
    met = big.join(lead, "token").groupBy("fp", "n", "label", "lead").agg(F.count("*").alias("k")).where(4 * t.denominator * F.col("k") >= (t.denominator - t.numerator) * F.col("n"))
    own = met.groupBy("fp", "label").agg(F.max_by("lead", F.struct("k", "lead")).alias("family"))
    large = own.groupBy("family").agg(F.count("*").alias("m")).where(F.col("m") > pairwise).select("family")
    return written(own.join(large, "family").select("fp", "label", "family"), "near-families")


def _differences(families: DataFrame, texts: DataFrame, each: DataFrame, t: Fraction) -> DataFrame:
    """(fp, label, family, apart, w): apart are the shingles in which a set and its family's typical set differ. Two members
    that have s of these in common are as similar as t if 2 (a + b) s >= w + w', where t is a / b."""
    sets = _hashes(texts, written(families.join(each.select("fp", "first"), "fp").select("fp", "first"), "near-nodes"))
    own = sets.join(families, "fp")
    order = F.xxhash64("fp")
    some = families.groupBy("family", F.pmod(order, F.lit(TYPICAL))).agg(F.min_by("fp", order).alias("fp"))
    sizes = some.groupBy("family").agg(F.count("*").alias("m"))
    counts = sets.join(some.select("fp", "family"), "fp").select("family", F.explode("hashes").alias("h")).groupBy("family", "h").agg(F.count("*").alias("k"))
    typical = counts.join(sizes, "family").where("2 * k > m").groupBy("family").agg(F.collect_list("h").alias("typical"))
    held = own.join(typical, "family", "left").withColumn("typical", F.coalesce("typical", F.array().cast("array<bigint>")))
    held = held.withColumns({"more": F.array_except("hashes", "typical"), "less": F.array_except("typical", "hashes")})
    # In common: the typical set less what either lacks, plus what both lack or both add.
    w = f"{2 * (t.numerator + t.denominator)}L * size(less) + {2 * t.numerator}L * size(hashes) - {t.numerator + t.denominator}L * size(typical)"
    out = written(held.select("fp", "label", "family", F.concat("more", "less").alias("apart"), F.expr(w).alias("w")), "near-apart")
    dropped(sets)
    return out


def _placed_apart(apart: DataFrame, t: Fraction) -> DataFrame:
    """(family, h, fp, label, w, core, left): shingles of _differences() that a set may share with a partner as the first of those
    they share, where left counts it and what comes after, rare ones first. core: near copies of the family's member with the least w."""
    twice = 2 * (t.numerator + t.denominator)
    own = _cored(apart)
    outside = own.where("not core").groupBy("family").agg(F.min("w").alias("outside"))
    # The least w of a partner: two of the core need not meet.
    own = own.join(outside, "family").withColumn("other", F.when(F.col("core"), F.col("outside")).otherwise(F.col("least.w")))
    own = own.where(twice * F.size("apart") >= F.col("w") + F.col("other"))
    rows = own.select("family", "fp", "label", "w", "core", "other", F.size("apart").alias("size"), F.explode("apart").alias("h"))
    rows = rows.withColumn("often", F.count("*").over(Window.partitionBy("family", "h")))
    rows = rows.withColumn("left", F.col("size") - F.row_number().over(Window.partitionBy("fp").orderBy("often", "h")) + 1)
    return rows.where((F.col("often") > 1) & (twice * F.col("left") >= F.col("w") + F.col("other"))).select("family", "h", "fp", "label", "w", "core", "left")


def _cored(apart: DataFrame) -> DataFrame:
    least = apart.groupBy("family").agg(F.min(F.struct("w", "fp")).alias("least"))
    return apart.join(least, "family").withColumn("core", F.col("w") + F.col("least.w") <= 0)


def _relatives(apart: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Of _differences(): (u, v) that are as similar as t, from the member with the least w; and all other (u, v) of one family
    and different components that may be."""
    near = _cored(apart).where("core and fp <> least.fp").select(F.least("fp", "least.fp").alias("u"), F.greatest("fp", "least.fp").alias("v"))
    row, rows = F.struct("fp", "label", "w", "core", "left"), written(_placed_apart(apart, t), "near-placed")
    x, y = rows.select("family", "h", row.alias("x")), rows.where("not core").select("family", "h", row.alias("y"))
    may = f"x.label <> y.label and (x.core or x.fp < y.fp) and x.w + y.w <= {2 * (t.numerator + t.denominator)}L * least(x.left, y.left)"
    return near, x.join(y, ["family", "h"]).where(may).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))


def _crossing(split: DataFrame, t: Fraction, pairwise: int, families: DataFrame | None = None) -> DataFrame:
    """All (u, v) of one bucket and different components, those of large buckets only where they share none of a few before;
    without those of one of families (fp, family)."""
    split = split.withColumn("family", F.lit(None).cast("long")) if families is None else split.join(families.select("fp", "family"), "fp", "left")
    row = F.struct("fp", "n", "p", "q", "label", "family")
    apart = "x.label <> y.label and coalesce(x.family <> y.family, true)"
    whole = F.expr(f"flatten(transform(xs, x -> transform(filter(xs, y -> y.fp > x.fp and {apart} and {_possible('x', 'y', t)}), y -> struct(x.fp as u, y.fp as v))))")
    small = split.where(F.col("m") <= pairwise).groupBy("token").agg(F.collect_list(row).alias("xs")).select(F.explode(whole).alias("e")).select("e.u", "e.v")
    big = split.where(F.col("m") > pairwise)
    row = F.struct("fp", "n", "p", "q", "r", "label", "family", "before")

    def largest(column: str) -> DataFrame:
        shares = big.where(F.col(column).isNotNull()).groupBy("token", column).agg(F.count("*").alias("k"))
        return shares.groupBy("token").agg(F.max(F.struct("k", F.col(column).alias("of"))).alias(f"main_{column}"))

    # Of each pair one is outside the largest component, and one outside the largest family: the smaller rest is taken.
    main = largest("label").join(largest("family"), "token", "left")
    outside = "if(main_label.k >= coalesce(main_family.k, 0L), label <> main_label.of, coalesce(family <> main_family.of, true))"
    rest = big.join(main, "token").where(outside).select("token", row.alias("y"))
    more = big.select("token", row.alias("x")).join(rest, "token").where(f"{apart} and {_first('x', 'y', t)}")
    return small.unionByName(more.select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")))


def _remaining(split: DataFrame, texts: DataFrame, each: DataFrame, t: Fraction, pairwise: int) -> DataFrame:
    """The (u, v) that join whatever similar sets split still has in different components."""
    families = _families(split, t, pairwise)
    if families.isEmpty():
        return _confirmed(_crossing(split, t, pairwise), texts, each, t)
    near, pairs = _relatives(_differences(families, texts, each, t), t)
    return _confirmed(_crossing(split, t, pairwise, families).unionByName(pairs), texts, each, t).unionByName(near)


def by_simhash(each: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, leaders: int = LEADERS[0]) -> DataFrame:
    """(u, v): confirmed pairs among those whose SimHashes agree under a mask. each: (fp, first, n, bits, sketch)."""
    t, split = _ratio(similarity), alike(each)
    found = _confirmed(_nominated(split, t, 0, leaders), texts, each, t)
    dropped(split)
    return found


def links(each: DataFrame, texts: DataFrame, met: DataFrame, similarity: float = SIMILARITY, pairwise: int = PAIRWISE, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """(u, v): enough confirmed pairs to join whatever a chain of similar sets joins. each: as for by_simhash(); met: of buckets()."""
    t, found = _ratio(similarity), by_simhash(each, texts, similarity, leaders[0])
    for turn in range(1, len(leaders) + 1):
        labels = components(found).select(F.col("node").alias("fp"), "label")
        named = met.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        open_ = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low <> high").select("token", "m")
        split = written(_placed(named.join(open_, "token"), t), "near-split")
        last = turn == len(leaders)
        new = _remaining(split, texts, each, t, pairwise) if last else _confirmed(_nominated(split, t, turn, leaders[turn]), texts, each, t)
        dropped(split)
        found = written(found.unionByName(new).distinct(), "near-links")
    return found


def _groups(docs: DataFrame, id_col: str, text_col: str, similarity: float, pairwise: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and labelled() of its sets."""
    texts = _texts(docs, id_col, text_col)
    own = written(_sets_of(texts), "near-sets-of")
    each = written(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch")), "near-distinct")
    met = buckets(texts, own.count(), similarity)
    return own.select("doc_id", "fp"), labelled(own, links(each, texts, met, similarity, pairwise))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, component_id) for every row of docs; component_id is the group's smallest doc_id."""
    return with_component(*_groups(docs, id_col, text_col, similarity, pairwise)).select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without the near copies: of each group the row with its smallest id stays (see simhash.first_rows())."""
    own, groups = _groups(docs, id_col, text_col, similarity, PAIRWISE)
    return first_rows(docs, own, groups, id_col, lambda raw: digest(shingles(raw)), text_col)
