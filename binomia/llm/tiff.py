"""TIFF media: documents stored as images, and images read page by page.

read_pages() walks the image file directories (classic and BigTIFF, either byte order, loops refused), decodes strips and
tiles stored plain or by PackBits, LZW or deflate, undoes the horizontal predictor, and gives one row a page. stored()
writes each text's bytes, filled up with 255 to whole lines, as a one-page 8-bit image: deflated strips with the
horizontal predictor. Strips bound what is decoded at once; a page's samples must fit a worker.

Defined results: a null text is stored like an empty one, as one line of 255; rows with null ids and repeated rows are
handled like others; an empty table gives no rows; a null or broken image gives one row with its error and no samples,
after the pages before the fault, and so does a page that claims more bytes than its file or a Spark value (MAX_PAGE_BYTES) can
hold; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, as_bytes, slices

WIDTH = 576
STRIP_BYTES = 64 * 1024
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

# Field types of the format, struct codes by number.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
# Tags of the format that are read here.
WIDTH_TAG, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 322, 323, 324, 325


# -- codecs ------------------------------------------------------------------------------------------------------------


def unpackbits(data: bytes, need: int | None = None) -> bytes:
    """The decoded bytes; with need, decoding ends once there are so many."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and (need is None or len(out) < need):
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128 and i < n:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def unlzw(data: bytes, need: int | None = None) -> bytes:
    """The format's LZW: most significant bit first, codes widen one early, 256 clears, 257 ends. With need, decoding ends
    once there are so many bytes."""
    out = bytearray()
    table: list[bytes] = []
    before, held, bits, width = b"", 0, 0, 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = [bytes((i,)) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("LZW data does not begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise ValueError("a wrong LZW code")
        out += entry
        if need is not None and len(out) >= need:
            break
        if before:
            table.append(before + entry[:1])
        before = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table = {bytes((i,)): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    size, run = 258, b""
    for i in range(len(data)):
        more = run + data[i : i + 1]
        if more in table:
            run = more
            continue
        put(table[run])
        table[more] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif size >= 1 << width:
            width += 1
        run = data[i : i + 1]
    if run:
        put(table[run])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


#: Bytes that one stored byte can stand for at most: what a page claims beyond that cannot be there.
_GAIN = {NONE: 1, PACKBITS: 64, LZW: 2600, DEFLATE: 1040, OLD_DEFLATE: 1040}
#: Decoded bytes of a page; Spark holds no value of 2 GB.
MAX_PAGE_BYTES = 1 << 30
#: What a page's decoding may raise on broken files.
_BROKEN = (ValueError, TypeError, KeyError, IndexError, ArithmeticError, MemoryError, struct.error, zlib.error)


def _decoded(data: bytes, compression: int, need: int) -> bytes:
    """The first need bytes or more; a compressed part that holds more is not blown up beyond what decoding needs."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpackbits(data, need)
    if compression == LZW:
        return unlzw(data, need)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, need))
    raise ValueError(f"compression {compression} is not read")


# -- reading -----------------------------------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each image file directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF byte order")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 42:
        at, count, entry, inline, big = struct.unpack_from(order + "I", data, 4)[0], "H", 12, 4, False
    elif magic == 43:
        at, count, entry, inline, big = struct.unpack_from(order + "Q", data, 8)[0], "Q", 20, 8, True
    else:
        raise ValueError("no TIFF magic number")
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        at += struct.calcsize("<" + count)
        fields = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at)
            size = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
            code = TYPES.get(kind)
            if code:
                total = size * struct.calcsize("<" + code)
                where = at + (12 if big else 8)
                if total > inline:
                    where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
                if where + total > len(data):
                    raise ValueError("a field lies outside the file")
                fields[tag] = (data[where : where + total],) if code == "s" else struct.unpack_from(f"{order}{size * len(code)}{code[0]}", data, where)
            at += entry
        fields[-1] = (order,)
        yield fields
        at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]


def samples(data: bytes, fields: dict[int, tuple]) -> np.ndarray:
    """The samples of one page: (height, width, samples a pixel), as stored, predictor undone."""
    one = lambda tag, default=None: fields.get(tag, (default,))[0]
    width, height, order = one(WIDTH_TAG), one(HEIGHT), fields[-1][0]
    if not width or not height:
        raise ValueError("a page without size")
    bits, depth = fields.get(BITS, (1,)), one(SAMPLES, 1)
    if len(set(bits)) != 1 or bits[0] not in (1, 2, 4, 8, 16, 32):
        raise ValueError(f"samples of {bits} bits are not read")
    bits, compression, predictor, planes = bits[0], one(COMPRESSION, NONE), one(PREDICTOR, 1), depth if one(PLANAR, 1) == 2 else 1
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not read")
    if compression not in _GAIN:
        raise ValueError(f"compression {compression} is not read")
    if depth < 1 or any(f in fields and not fields[f][0] for f in (TILE_WIDTH, TILE_HEIGHT, ROWS_PER_STRIP)):
        raise ValueError("samples, strips or tiles of no size")
    per = depth // planes
    tiled = TILE_OFFSETS in fields
    if tiled:
        part_w, part_h, offsets, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILE_OFFSETS], fields[TILE_SIZES]
    else:
        part_w, part_h, offsets, sizes = width, min(one(ROWS_PER_STRIP, height), height), fields[STRIP_OFFSETS], fields[STRIP_SIZES]
    if not part_w or not part_h:
        raise ValueError("tiles without size")
    # A tile is filled up at the edges: it may hold more samples than its page.
    claimed, held = max(height, part_h) * max(width, part_w) * depth * max(bits, 8) // 8, sum(sizes)
    if claimed > MAX_PAGE_BYTES or height * width * depth * bits // 8 > _GAIN[compression] * held + 64:
        raise ValueError("a page of more bytes than the file or a row can hold")
    across, down = -(-width // part_w), -(-height // part_h)
    if len(offsets) != across * down * planes or len(sizes) != len(offsets):
        raise ValueError("the strips or tiles do not cover the page")
    kind = np.dtype({8: "u1", 16: order + "u2", 32: order + "u4"}.get(bits, "u1"))
    page = np.empty((height, width, depth), dtype=kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        if at + size > len(data):
            raise ValueError("a strip or tile lies outside the file")
        plane, rest = divmod(k, across * down)
        y, x = rest // across * part_h, rest % across * part_w
        rows = part_h if tiled else min(part_h, height - y)
        line = -(-part_w * per * bits // 8)
        raw = _decoded(data[at : at + size], compression, rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, dtype=np.uint8, count=rows * line).reshape(rows, line)
        if bits < 8:
            each = np.unpackbits(block, axis=1).reshape(rows, -1, bits)
            block = (each @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8))[:, : part_w * per]
        else:
            block = np.frombuffer(block.tobytes(), dtype=kind).astype(page.dtype)
        block = block.reshape(rows, part_w, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=page.dtype)
        h, w = min(rows, height - y), min(part_w, width - x)
        page[y : y + h, x : x + w, plane * per : plane * per + per] = block[:h, :w]
    return page


def feature(page: np.ndarray) -> str:
    """What the page looks like: mean, deviation, entropy of the values, and the mean step between neighbours."""
    flat = page.reshape(-1).astype(np.float64) if page.dtype != np.uint8 else page.reshape(-1)
    counts = np.bincount(page.reshape(-1), minlength=256) if page.dtype == np.uint8 else np.unique(page, return_counts=True)[1]
    share = counts[counts > 0] / max(1, flat.size)
    step = np.abs(np.diff(page.astype(np.int16) if page.dtype == np.uint8 else page.astype(np.float64), axis=1))
    return f"w={page.shape[1]};h={page.shape[0]};mean={flat.mean():.4f};std={flat.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={step.mean() if step.size else 0.0:.4f}"


# -- writing -----------------------------------------------------------------------------------------------------------


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, strip_bytes: int = STRIP_BYTES, order: str = "<", level: int = 1) -> bytes:
    """A classic TIFF of 8-bit pages (height, width, samples a pixel)."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    pack = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, level)}[compression]
    for page in pages:
        height, width, depth = page.shape
        parts = []
        if tile:
            rows = tile[0]
            for y in range(0, height, tile[0]):
                for x in range(0, width, tile[1]):
                    block = np.zeros((*tile, depth), dtype=np.uint8)
                    own = page[y : y + tile[0], x : x + tile[1]]
                    block[: own.shape[0], : own.shape[1]] = own
                    parts.append(block)
        else:
            rows = max(1, strip_bytes // (width * depth))
            parts = [page[y : y + rows] for y in range(0, height, rows)]
        offsets, sizes = [], []
        for block in parts:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, depth), dtype=np.uint8))
            raw = pack(np.ascontiguousarray(block).tobytes())
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw
        fields = [(WIDTH_TAG, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * depth), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if depth == 3 else 1]), (SAMPLES, 3, [depth]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_SIZES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_SIZES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) & 1)
                where = struct.pack(order + "I", len(out))
                out += raw
            else:
                where = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + where
        out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def stored_form(raw: bytes, width: int = WIDTH) -> bytes:
    """The image of a text's bytes, filled up with 255 to a positive number of whole lines."""
    size = max(1, -(-len(raw) // width)) * width
    page = np.frombuffer(raw.ljust(size, b"\xff"), dtype=np.uint8).reshape(-1, width, 1)
    return write([page])


# -- operators ---------------------------------------------------------------------------------------------------------

_PAGES = "page_index int, width int, height int, channels int, samples binary, feature string, error string"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raws = [x or b"" for x in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raws], pa.int64()), pa.array([stored_form(x) for x in raws], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pages(images: DataFrame, media_col: str = "media") -> DataFrame:
    """images with all its columns, a row for each page: its index, size, samples (row by row), feature, error."""
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(_PAGES)

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def decoded(media: bytes) -> Iterator[tuple]:
        k = -1
        try:
            for k, fields in enumerate(directories(media)):
                page = samples(media, fields)
                yield k, page.shape[1], page.shape[0], page.shape[2], page.tobytes(), feature(page), None
            if k < 0:
                raise ValueError("no page")
        except _BROKEN as e:
            yield k + 1, None, None, None, None, None, str(e) or type(e).__name__

    def batch(part: pa.RecordBatch, source: list[int], rows: list[tuple]) -> pa.RecordBatch:
        own = part.take(pa.array(source, pa.int64()))
        added = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*own.columns, *added], names=[*own.schema.names, *extra.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, media_col):
            source, rows, held = [], [], 0
            for i in range(part.num_rows):
                for row in decoded(part.column(media_col)[i].as_py() or b""):
                    if rows and held + len(row[4] or b"") > BATCH_BYTES:
                        yield batch(part, source, rows)
                        source, rows, held = [], [], 0
                    source.append(i)
                    rows.append(row)
                    held += len(row[4] or b"")
            if rows:
                yield batch(part, source, rows)

    return images.mapInArrow(run, StructType([*images.schema.fields, *extra.fields]))
