"""Cost-balanced packing of token documents into sequences of fixed capacity.

A document's cost in a sequence is estimated as linear x tokens + quadratic x tokens^2. Whole multiples of the capacity
become sequences of their own; what remains of each document is taken by descending cost and given to the sequence of
lowest cost with room, by preference one that holds it whole, else cut. A block of documents opens just as many full
sequences as its remainders fill, and sequences of powers of two for the rest, so nothing is padded at all. Blocks are
runs of rows within a partition, bounded in bytes and rows: no shuffle, bounded memory, and any hot key is just rows.

Ids are the tokenizer's own, special strings in a text included: they become their special ids, as it does by itself.

Defined results: a null text has the closing id alone, like an empty one; rows with null ids and repeated rows are packed
like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memory, by_line, ids_of_texts
from .common import mapped, slices

CAPACITY = 1024
END_ID = 0
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
VOCABULARY = "byte_bpe_50k.json"
#: Sequences that are looked at for one that holds a piece whole.
TRIES = 4
#: A block's bounds: texts are packed with those of their block.
BLOCK_BYTES, BLOCK_ROWS = 10 << 20, 8192
#: A block is encoded in parts of so many bytes, as what that takes besides the ids is several times the text.
PART_BYTES = 2 << 20
#: Units that a worker remembers between blocks, and how many are encoded as one text.
KNOWN, LINES = 500_000, 10_000


def pack(sizes: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of documents with these token counts."""
    out, sequence, rest = [], 0, []
    for doc, n in enumerate(sizes):
        for start in range(0, n - capacity + 1, capacity):
            out.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    total = sum(n for n, _, _ in rest)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    used = [0] * len(rooms)
    heap = [(0.0, i) for i in range(len(rooms))]
    cost = lambda n: linear * n + quadratic * n * n
    for n, doc, start in sorted(rest, key=lambda x: (-cost(x[0]), x[1])):
        while n:
            tried = []
            while heap and len(tried) < TRIES:
                tried.append(heapq.heappop(heap))
                if rooms[tried[-1][1]] - used[tried[-1][1]] >= n:
                    break
            at = len(tried) - 1 if rooms[tried[-1][1]] - used[tried[-1][1]] >= n else 0
            had, i = tried.pop(at)
            for x in tried:
                heapq.heappush(heap, x)
            take = min(n, rooms[i] - used[i])
            out.append((doc, start, take, sequence + i, used[i]))
            used[i] += take
            if used[i] < rooms[i]:
                heapq.heappush(heap, (had + cost(take), i))
            n, start = n - take, start + take
    return out


@cache
def _tokenizer(path: str) -> tuple[Memory, object, tuple[str, ...]]:
    """The memory over a tokenizer file, its encoding of whole texts, and its special strings; once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    ids_of = lambda texts: [np.array(x.ids, dtype=np.uint32) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
    line_end = int(ids_of(["\n"])[0][0])

    def encode(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [lines[at : at + LINES] for at in range(0, len(lines), LINES)]
        found = [by_line(ids, ids == line_end, part) for part in parts for ids in ids_of(["\n".join(part)])]
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    return Memory(encode, ids_of, KNOWN), ids_of, tuple(sorted(t.content for t in own.get_added_tokens_decoder().values()))


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, bounds) of texts, as the tokenizer itself encodes them, its special strings included."""
    memory, whole, special = _tokenizer(path)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    strange = np.zeros(len(texts), dtype=bool)
    for s in special:
        strange |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    if not strange.any():
        return ids_of_texts(texts, memory)
    flat, bounds = ids_of_texts(pc.if_else(pa.array(strange), "", texts), memory)
    own = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    for i, ids in zip(np.flatnonzero(strange), whole(texts.filter(pa.array(strange)).to_pylist()), strict=True):
        own[i] = ids
    return np.concatenate(own), np.cumsum([0, *map(len, own)])


def block_ids(block: pa.RecordBatch, path: str) -> tuple[np.ndarray, np.ndarray]:
    """token_ids() of a block's column text, part by part."""
    found = [token_ids(part.column("text"), path) for part in slices(iter([block]), "text", PART_BYTES, BLOCK_ROWS)]
    return np.concatenate([ids for ids, _ in found]), np.cumsum(np.concatenate([[0], *(np.diff(bounds) for _, bounds in found)]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit; with digest their CRC-32 as
    ids_crc32 instead), doc_tokens, sequence_id, offset."""
    path = vocabulary or default_vocabulary()
    what = "ids_crc32" if digest else "ids"
    schema = f"doc_id long, start long, length long, {what} {'long' if digest else 'binary'}, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", BLOCK_BYTES, BLOCK_ROWS):
            flat, bounds = block_ids(part, path)
            flat = np.insert(flat, bounds[1:], end_id).astype("<u4", copy=False)
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pack(sizes.tolist(), capacity), strict=True))
            raw, at = memoryview(flat).cast("B"), 4 * (bounds[doc] + start)
            cuts = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            shown = pa.array([zlib.crc32(x) for x in cuts], pa.int64()) if digest else pa.array([bytes(x) for x in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), shown, pa.array(sizes[doc]), pa.array(first + sequence), pa.array(offset)],
                names=["doc_id", "start", "length", what, "doc_tokens", "sequence_id", "offset"],
            )
            first += int(sequence.max()) + 1

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
