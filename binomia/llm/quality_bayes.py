"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A logistic regression over byte-class shares, compressibility and length gives each document's evidence; it is fitted on
at most MAX_TRAIN labelled rows (those with the smallest hash of the id), the one bounded sample here. The evidence of
all documents is summed by (host, path) and by host with partial aggregation. Each level's posterior mean is shrunk to
the level above (path to host, host to the global prior) by a strength estimated from the spread between groups, so
sparse sites fall back on the prior. A document's score adds what its path, without the document itself, says beyond the
prior. The site table joins by broadcast while it has at most BROADCAST_SITES rows, else by a shuffled join, which
adaptive execution splits for hot sites.

Defined results: a null text is read as empty; null host or path count as one site of their own; without usable labels of
both classes the evidence is neutral and everything is kept; labels that contradict one another are all used; rows
with null ids and repeated rows are scored like others; an empty table gives no rows; other columns pass untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped, slices, unused_name, written

MAX_TRAIN = 20_000
BROADCAST_SITES = 100_000
SITE_WEIGHT = 0.5
THRESHOLD = 0.5
STRENGTH = (2.0, 10_000.0)
CLIP = 8.0

_CLASS = np.full(256, 7, dtype=np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"?()-", b"!#*$%&|<>")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 8
FEATURES = 9 + 6


def features(raw: bytes) -> np.ndarray:
    """Byte-class shares, compression ratio, log length, words and their length, lines, and short or long flags."""
    n = len(raw)
    if not n:
        return np.zeros(FEATURES)
    share = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9) / n
    words = max(1.0, (share[3] + share[4]) * n + 1)
    packed = len(zlib.compress(raw, 1)) / n
    return np.concatenate([share, [packed, packed * packed, np.log1p(n), np.log1p(words), min(30.0, n / words) / 10, np.log1p(share[4] * n)]])


def _evidence(docs: DataFrame, text_col: str, model: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None, name: str, with_text: bool = True) -> DataFrame:
    """docs, without its texts if so asked, with the model's log-odds of being good in column `name`."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shown = [f for f in docs.schema.fields if with_text or f.name != text_col]
    kept = [f.name for f in shown]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            if model is None:
                z = np.zeros(part.num_rows)
            else:
                mean, scale, w, b = model
                rows = np.stack([features(x or b"") for x in as_bytes(part.column(text_col))])
                z = np.clip((rows - mean) / scale @ w + b, -CLIP, CLIP)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(z)], names=[*kept, name])

    return mapped(docs, run, StructType([*shown, StructField(name, DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Logistic regression (Newton steps, ridge) on a bounded sample of labelled documents; None without two classes."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = [features(x or b"").tolist() for x in as_bytes(part.column("_text"))]
            yield pa.RecordBatch.from_arrays([part.column("_y"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    # max_train bounds the broadcast side; ids that repeat in docs could exceed it, so the rows that come back are bounded too.
    met = mapped(own.join(F.broadcast(some), "_id").select("_y", "_text"), run, "y int, x array<double>").limit(2 * max_train).toPandas()
    if met.y.nunique() < 2:
        return None
    x, y = np.stack(met.x.to_numpy()), met.y.to_numpy().astype(np.float64)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1])


def _shrunk(total, n, above, strength):
    return (total + strength * above) / (n + strength)


def sites(evidence: DataFrame, host_col: str, path_col: str, log_odds: str) -> DataFrame:
    """(host, path, n, total, host_mean, k_path, prior): the sums of each path and what its level is shrunk to."""
    p = 1 / (1 + F.exp(-F.col(log_odds)))
    by_path = evidence.groupBy(F.col(host_col).alias("host"), F.col(path_col).alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("total"))
    by_path = written(by_path, "bayes-paths")
    by_host = written(by_path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("total").alias("htotal")), "bayes-hosts")
    # Three numbers, whatever the input: the prior and how much each level's groups differ.
    prior = by_host.agg(((F.sum("htotal") + 1) / (F.sum("hn") + 2)).alias("x")).first()["x"] or 0.5

    def strength(groups: DataFrame, n: str, total: str) -> float:
        """prior x (1 - prior) / spread - 1, the spread of group means less what chance makes of it."""
        q = prior * (1 - prior)
        spread = F.sum(F.col(n) * (F.col(total) / F.col(n) - prior) ** 2) / F.sum(n) - q * F.count("*") / F.sum(n)
        found = groups.agg(spread.alias("x")).first()["x"]
        return min(max(q / max(found or 0.0, 1e-9) - 1, STRENGTH[0]), STRENGTH[1])

    k_host, k_path = strength(by_host, "hn", "htotal"), strength(by_path, "n", "total")
    levels = by_path.join(by_host.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return levels.select("host", "path", "n", "total", _shrunk(F.col("htotal"), F.col("hn"), prior, k_host).alias("host_mean"), F.lit(k_path).alias("k_path"), F.lit(prior).alias("prior"))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, names: tuple[str, str]) -> DataFrame:
    evidence_name, score_name = names
    model = fit(docs, labels, id_col, text_col)
    own = docs.select(F.col(host_col), F.col(path_col), F.col(text_col))
    levels = written(sites(_evidence(own, text_col, model, evidence_name, with_text=False), host_col, path_col, evidence_name), "bayes-sites")
    small = levels.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    site = {c: unused_name(f"_site_{c}", [*docs.columns, *names]) for c in levels.columns}
    s = levels.select(*[F.col(c).alias(site[c]) for c in levels.columns])
    s = F.broadcast(s) if small else s
    out = _evidence(docs, text_col, model, evidence_name)
    out = out.join(s, out[host_col].eqNullSafe(s[site["host"]]) & out[path_col].eqNullSafe(s[site["path"]]), "left")
    of = lambda c: F.col(site[c])
    p = 1 / (1 + F.exp(-F.col(evidence_name)))
    logit = lambda x: F.log(x / (1 - x))
    others = _shrunk(of("total") - p, of("n") - 1, of("host_mean"), of("k_path"))
    bounded = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = SITE_WEIGHT * (logit(bounded(others)) - logit(bounded(of("prior"))))
    score = 1 / (1 + F.exp(-(F.col(evidence_name) + shift)))
    return out.select(*docs.columns, F.col(evidence_name), score.alias(score_name))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, host, path, evidence, score, kept) for each row of docs; score is the posterior probability of good."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    out = _scored(own, labels.withColumnRenamed(id_col, "doc_id"), "doc_id", "text", "host", "path", ("evidence", "score"))
    return out.select("doc_id", "host", "path", F.round("evidence", 6).alias("evidence"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with docs' own columns."""
    names = unused_name("_evidence", docs.columns), unused_name("_score", docs.columns)
    return _scored(docs, labels, id_col, text_col, host_col, path_col, names).where(F.col(names[1]) >= threshold).select(*docs.columns)
