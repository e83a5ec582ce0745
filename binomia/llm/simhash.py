"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Fingerprints of 64 bits come from the word shingles of whole texts. Two fingerprints link if they differ in at
most ``radius`` bits. Covering masks (bit positions dealt to the vectors of F2^(radius+1), one mask for each
non-zero vector) make every such pair agree under some mask, so candidates lose no pair. Buckets of few
fingerprints are compared pair by pair; the fingerprints of larger ones meet in the one-bit neighbours they share,
which links exactly the pairs within two bits at 65 rows a fingerprint, however large the group is.

Only distinct fingerprints take part, so exact copies cost one row; components come from graph.py.

Defined results: a null text has no words, like an empty one; texts without words have fingerprint zero and link as
any other; rows with a null id are returned and take the smallest id of their component, null if it has none; repeated
rows give repeated result rows; an empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped, slices, unused_name, written
from .graph import components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Buckets of at most so many fingerprints are compared pair by pair.
PAIRWISE = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BLOCK = 1 << 17


def _counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each of the 64 bits is set."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BITS for j in range(8)])


def _majority(counts: np.ndarray, n: int) -> int:
    bits = (counts * 2 > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def of_hashes(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingles' hashes (uint64), zero of none."""
    return _majority(_counts(hashes), len(hashes))


def fingerprint(raw: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half of the shingles' XXH64."""
    words = raw.lower().split()  # bytes: A-Z only, and the ASCII white space 09-0D, 20
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle_words + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        cuts = map(slice, starts[at:to].tolist(), ends[at + shingle_words - 1 : to + shingle_words - 1].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(seed)), dtype=np.uint64, count=to - at)
        counts += _counts(hashes)
    return _majority(counts, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = [fingerprint(raw or b"", shingle_words) for raw in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 masks; any two values that differ in at most radius bits agree under at least one.

    Position i holds a vector of radius+1 bits; mask v keeps the positions whose vector has odd parity with v. The
    vectors of at most radius differing positions leave some v orthogonal to all of them: that mask keeps none of them.
    """
    vectors = (1 << (radius + 1)) - 1
    held = [i % vectors + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (held[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def masked(fp: str, radius: int) -> Column:
    """The (t, key) of a fingerprint under each covering mask, one a row."""
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))]))


def links(fps: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """(u, v), u < v: enough links to join whatever differs in at most radius bits (and none that differs in more than a
    path of such links). fps has a column fp of distinct values."""
    if radius not in (1, 2):
        raise ValueError("links() joins within one or two bits")
    rows = fps.select("fp", masked("fp", radius).alias("b")).select("fp", "b.t", "b.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(sizes, ["t", "key"]), "simhash-buckets")

    pairs = F.expr(f"flatten(transform(fs, x -> transform(filter(fs, y -> y > x and bit_count(x ^ y) <= {radius}), y -> struct(x as u, y as v))))")
    near = met.where(F.col("n") <= pairwise).groupBy("t", "key").agg(F.collect_list("fp").alias("fs")).select(F.explode(pairs).alias("e")).select("e.u", "e.v")

    # Within two bits means one shared one-bit neighbour (or being one); a neighbour has 65 such fingerprints at most.
    flips = [0] + [_signed(1 << i) for i in range(64)]
    crowded = met.where(F.col("n") > pairwise).select("fp").distinct()
    if radius == 1:
        around = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("near")).where("near >= fp")
        star = around.join(crowded.select(F.col("fp").alias("near")), "near").where("near > fp").select(F.col("fp").alias("u"), F.col("near").alias("v"))
    else:
        around = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("near"))
        star = (
            around.groupBy("near").agg(F.collect_list("fp").alias("fs")).where(F.size("fs") > 1)
            .select(F.array_min("fs").alias("u"), F.explode("fs").alias("v")).where("u < v")
        )
    return near.unionByName(star).distinct()


def labelled(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, first, root) for each distinct fp of own (doc_id, fp): its smallest id, and what its component is known by."""
    each = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(edges)
    return written(each.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("root")), "simhash-labelled")


def with_component(own: DataFrame, groups: DataFrame) -> DataFrame:
    """own (doc_id, fp) with component_id, the smallest id of its component in groups (of labelled())."""
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = written(groups.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-ids")
    return own.join(ids, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    own = written(fingerprints(docs, id_col, text_col, shingle_words), "simhash-fps")
    found = with_component(own, labelled(own, links(own.select("fp").distinct(), radius)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, own: DataFrame, groups: DataFrame, id_col: str, fingerprint: Callable[[bytes], int], text_col: str) -> DataFrame:
    """docs without the rows that are not the first of their component. own: (doc_id, fp) of docs; groups: of labelled();
    fingerprint(): the fp of a text.

    First is the smallest id, then the smallest fp. Where no id repeats, the rows that go leave by their ids alone; rows
    whose id repeats are told apart by their texts' fp, and of those that agree in both one stays (least by a hash of
    all columns). Rows without an id stay.
    """
    mark = unused_name("_fp", docs.columns)
    firsts = groups.where("first is not null").groupBy("root").agg(F.min(F.struct("first", "fp")).alias("f")).select(F.col("f.first").alias("doc_id"), F.col("f.fp").alias("fp"))
    firsts = written(firsts, "simhash-firsts")
    repeated = written(own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "simhash-repeated")
    own_id = F.col(id_col).cast("long")
    goes = own.where("doc_id is not null").select("doc_id").join(firsts.select("doc_id"), "doc_id", "left_anti")
    if repeated.isEmpty():
        leave = goes.select(F.col("doc_id").alias(mark))
        return docs.join(leave, own_id == F.col(mark), "left_anti")
    leave = goes.unionAll(repeated).distinct().select(F.col("doc_id").alias(mark))
    kept = docs.join(leave, own_id == F.col(mark), "left_anti")

    @F.pandas_udf("long")
    def fp_of(texts):
        return texts.map(lambda t: _signed(fingerprint((t or "").encode()))).astype("int64")

    again = docs.join(repeated.select(F.col("doc_id").alias(mark)), own_id == F.col(mark), "left_semi").withColumn(mark, fp_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    one = again.join(firsts.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_f")), (own_id == F.col("_id")) & (F.col(mark) == F.col("_f"))).select(*[again[c] for c in docs.columns], F.struct("_id", "_f").alias(mark))
    hashed = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in docs.columns])
    least = one.groupBy(mark).agg(F.min_by(F.struct(*docs.columns), hashed).alias("r"))
    return kept.unionByName(least.select("r.*"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """docs without the near copies: of each component the row with its smallest id stays (see first_rows()).

    Components are those of near_duplicates(); with a similarity, those of texts whose five-word shingles have at least
    this Jaccard similarity: fingerprints under wider masks, then what their bits do not show (see near_copies.py).
    """
    if similarity is not None:
        from .near_copies import keep_first

        return keep_first(docs, id_col, text_col, similarity)
    own = written(fingerprints(docs, id_col, text_col), "simhash-fps")
    return first_rows(docs, own, labelled(own, links(own.select("fp").distinct())), id_col, fingerprint, text_col)
