"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece exactly one last token is possible in the encoding of that prefix. It is found from the
tokens that end there: one is right if it is the whole prefix, or if it may follow the last token stored for the prefix
before it, which holds if the pair's bytes encode to just that pair. Walking back from the end gives the encoding. The
table makes appends exact (it only grows) and lets an edit keep what stands before it and, once it agrees again over the
longest token's length, what stands after it.

Texts are cut into pieces by the vocabulary's pattern first; a piece that is a token itself stays whole.

Defined results: a null text encodes like an empty one, to no ids; rows with null ids and repeated rows are encoded like
others; an empty table gives no rows; other columns are not read. Work and memory are linear in a text's bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memory, by_line, ids_of_texts, ragged
from .common import mapped, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bounds of what a worker remembers.
PAIRS, PIECES, KNOWN = 500_000, 200_000, 200_000
#: Texts that are encoded at once.
BLOCK_BYTES = 6 << 20


class PrefixTable:
    """The last token of each byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of data[start:end]; returns how many prefixes were computed anew."""
        start, end = min(start, len(self.data)), min(end, len(self.data))
        old_data, old_last, reach = self.data, self.last, self.vocabulary.longest
        self.data, self.last = old_data[:start] + new + old_data[end:], old_last[:start]
        shift, agreed = len(new) - (end - start), 0
        for i in range(start, len(self.data)):
            self.vocabulary.extend(self.data, self.last, i + 1)
            was = i - shift
            # agreement counts where all bytes that a token ending here can hold lie after the edit
            same = was - reach >= end and self.last[i] == old_last[was]
            agreed = agreed + 1 if same else 0
            if agreed >= reach:
                self.last += old_last[was + 1 :]
                return i + 1 - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        return self.vocabulary.walk(self.last)


class Vocabulary:
    """Ranks of a byte-level vocabulary: token bytes to id, ids in merge order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.longest = max(map(len, ranks))
        self.size = [0] * (max(ranks.values()) + 1)
        self.bytes = [b""] * len(self.size)
        for token, i in ranks.items():
            self.bytes[i], self.size[i] = token, len(token)
        self.pairs: dict[int, bool] = {}
        self.single: dict[int, bool] = {}
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.lengths = np.array(self.size, dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known: dict[str, bytes] = {}
        self.memory = Memory(self.encode_lines, lambda texts: [np.array(self.encode(t), dtype=np.uint32) for t in texts], KNOWN)

    def merged(self, data: bytes) -> list[bytes]:
        """data by the merges themselves; for short data only, to judge pairs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        key = before << 20 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.bytes[before], self.bytes[token]
            found = self.pairs[key] = self.merged(a + b) == [a, b]
        return found

    def stands(self, token: int) -> bool:
        """Whether the token's bytes encode to itself."""
        found = self.single.get(token)
        if found is None:
            found = self.single[token] = len(self.merged(self.bytes[token])) == 1
        return found

    def extend(self, data: bytes, last: list[int], to: int | None = None) -> None:
        """Fills last, the table of data's prefixes, up to prefix `to` (all of them by default)."""
        ranks, longest, pairs, follows, stands = self.ranks, self.longest, self.pairs, self.follows, self.stands
        for end in range(len(last) + 1, (len(data) if to is None else to) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    if stands(token):
                        last.append(token)
                        break
                    continue
                before = last[start - 1]
                ok = pairs.get(before << 20 | token)
                if ok if ok is not None else follows(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def walk(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at > 0:
            token = last[at - 1]
            out.append(token)
            at -= self.size[token]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            out += self.encode_piece(piece.encode())
        return out

    def encode_sorted(self, pieces: list[str]) -> list[bytes]:
        """Ids of many pieces; in byte order, each keeps the table of the prefix that it shares with the one before."""
        out, before, last = [b""] * len(pieces), b"", []
        for data, i in sorted((p.encode(), i) for i, p in enumerate(pieces)):
            whole = self.ranks.get(data)
            if whole is not None:
                ids = [whole]
            else:
                shared, most = 0, min(len(before), len(data))
                while shared < most and before[shared] == data[shared]:
                    shared += 1
                del last[shared:]
                self.extend(data, last)
                before, ids = data, self.walk(last)
            out[i] = np.array(ids, dtype="<u4").tobytes()
        return out

    def encode_lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, count for each line); pieces repeat more than lines do and are remembered for themselves."""
        pieces = self.pieces("\n".join(lines))
        if len(self.known) > PIECES:
            self.known = {}
        missing = [p for p in dict.fromkeys(pieces) if p not in self.known]
        self.known.update(zip(missing, self.encode_sorted(missing), strict=True))
        raw = [self.known[p] for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        ends = np.zeros(int(sizes.sum()), dtype=bool)
        ends[np.cumsum(sizes)[np.fromiter((p == "\n" for p in pieces), dtype=bool, count=len(pieces))] - 1] = True
        return by_line(np.frombuffer(b"".join(raw), dtype="<u4"), ends, lines)

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        last: list[int] = []
        self.extend(data, last)
        return tuple(self.walk(last))

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.flat, self.starts, self.lengths, ids.astype(np.int64)).tobytes()

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        flat, bounds = ids_of_texts(texts, self.memory)
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


@cache
def load(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file; once a worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Vocabulary(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in a binary column."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path, pattern)
        for part in slices(batches, "text", BLOCK_BYTES):
            ids = [x.astype("<u4").tobytes() for x in own.encode_batch(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids binary")


def decode(tokens: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; null ids decode like none."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path, pattern)
        for part in slices(batches, "ids"):
            out = [own.decode(np.frombuffer(x or b"", dtype="<u4")) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return mapped(tokens.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def recoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids, decoded): decode(encode(docs)) in one pass, so that one worker a task holds a vocabulary."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path, pattern)
        for part in slices(batches, "text", BLOCK_BYTES):
            ids = own.encode_batch(part.column("text"))
            columns = [part.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids binary, decoded binary")
