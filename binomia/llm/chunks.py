"""Token ids of batches of texts by their distinct units: a unit is encoded once, remembered, and gathered by position.

A unit runs from one space that stands between two non-spaces to the next. The split pattern of the byte-level
vocabularies has a boundary before each such space, so that units encode alone as they do in their text. Distinct units
are found and looked up by Arrow; those not yet known are encoded as lines of one text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space of any kind but the line feed, as RE2 has it (and Python's four separators, which is the safe side).
_OTHER = r"\t\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SIMPLE = f"^[^\\n{_OTHER}]+$"
_BEGINS, _ENDS, _STRANGE = f"^[^\\n{_OTHER}]", f"[^\\n{_OTHER}]$", f"[{_OTHER}]|\\n\\n\\n"
#: What may stand as a line among others: its line feeds are pieces of their own, and so is the one that ends it.
_LINE = re.compile(r" ?\S+(?:\n\n?\S+)*")
#: Marks that are a piece of their own at a unit's end, after a Latin letter.
TAILS = ",.;:!?"

Lines = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """flat[starts[c] : starts[c] + lengths[c]] for each c of codes, end to end."""
    each = lengths[codes]
    total = int(each.sum())
    at = np.repeat(starts[codes] - (np.cumsum(each) - each), each)
    at += np.arange(total, dtype=np.int64)
    return flat[at]


def by_line(ids: np.ndarray, line_end: np.ndarray, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count for each line) of lines that were encoded as one text; line_end marks the ids that are line feeds."""
    inner = np.fromiter((x.count("\n") for x in lines), dtype=np.int64, count=len(lines))
    stops = np.flatnonzero(line_end)
    if len(stops) != inner.sum() + len(lines) - 1:
        raise ValueError("the vocabulary's pattern does not keep line feeds apart")
    ends = np.append(stops[(np.cumsum(inner) + np.arange(len(lines)))[:-1]], len(ids))
    counts = np.diff(ends, prepend=-1) - 1
    return np.delete(ids, ends[:-1]), counts


class Memory:
    """Ids of lines, at most `most` of them between two batches: when there are more, those of the last batch stay."""

    def __init__(self, encode: Lines, alone: Callable[[list[str]], list[np.ndarray]], most: int):
        self.encode, self.alone, self.most = encode, alone, most
        self.keys = pa.array([], pa.large_string())
        tails = alone(list(TAILS))
        self.tails, self.tail_lengths = np.concatenate(tails).astype(np.uint32), np.array([len(x) for x in tails], dtype=np.int64)
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def look_up(self, keys: pa.Array) -> np.ndarray:
        """The place of each of these distinct lines; unknown ones are encoded."""
        found = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = found < 0
        if not new.any():
            return found
        missing = keys.filter(pa.array(new))
        flat, lengths = self.encode(missing.to_pylist())
        if len(self.keys) + len(missing) > self.most:
            known = found[~new]
            self.flat = ragged(self.flat, np.cumsum(self.lengths) - self.lengths, self.lengths, known)
            self.keys, self.lengths = self.keys.take(pa.array(known)), self.lengths[known]
            found[~new] = np.arange(len(known))
        found[new] = len(self.keys) + np.arange(len(missing))
        self.keys = pa.concat_arrays([self.keys, missing])
        self.flat, self.lengths = np.concatenate([self.flat, flat.astype(np.uint32)]), np.concatenate([self.lengths, lengths])
        return found

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of single units, not remembered: as lines where they can stand as such, else each by itself."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        lines, others = [], []
        for i, t in enumerate(texts):
            if t:
                (lines if _LINE.fullmatch(t) else others).append(i)
        if lines:
            flat, lengths = self.encode([texts[i] for i in lines])
            for i, ids in zip(lines, np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = ids
        if others:
            for i, ids in zip(others, self.alone([texts[i] for i in others]), strict=True):
                out[i] = ids
        return out


def stems(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lines without a mark that ends them after a Latin letter, that mark's place in TAILS or -1)."""
    sizes, raw = pc.binary_length(lines).to_numpy(), np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)
    ends = np.cumsum(sizes) + np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset] if len(lines) else sizes
    marks = np.full(256, -1, dtype=np.int64)
    marks[np.frombuffer(TAILS.encode(), dtype=np.uint8)] = np.arange(len(TAILS))
    tail = np.full(len(lines), -1, dtype=np.int64)
    long = np.flatnonzero(sizes > 2)
    last, before, first = (raw[ends[long] - k] for k in (1, 2, 3))
    ascii_letter = ((before | 32) >= 97) & ((before | 32) <= 122)
    wide = (first >= 0xC3) & (first <= 0xC8) & (before >= 0x80) & ~((first == 0xC3) & ((before == 0x97) | (before == 0xB7)))  # not the signs for times and divided
    tail[long] = np.where(ascii_letter | wide, marks[last], -1)
    has = pa.array(tail >= 0)
    return pc.if_else(has, pc.utf8_slice_codeunits(lines, 0, -1), lines), tail


def ids_of_texts(texts: pa.Array, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, where each text's begin and the last one's end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds, values = bounds - bounds[0], lists.flatten()
    encoded = values.dictionary_encode()
    distinct, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    regular = pc.match_substring_regex(distinct, _SIMPLE).to_numpy(zero_copy_only=False)
    begins, ends = regular.copy(), regular.copy()
    if not regular.all():
        odd = np.flatnonzero(~regular)
        some = distinct.take(pa.array(odd))
        begins[odd], ends[odd], strange = (pc.match_substring_regex(some, x).to_numpy(zero_copy_only=False) for x in (_BEGINS, _ENDS, _STRANGE))
        regular[odd] = begins[odd] & ends[odd] & ~strange
    firsts = bounds[:-1]
    opens = np.ones(len(codes), dtype=bool)  # where a unit begins
    opens[1:] = ends[codes[:-1]] & begins[codes[1:]]
    opens[firsts] = True
    at = np.flatnonzero(opens)
    single = np.ones(len(at), dtype=bool)
    single[:-1] = np.diff(at) == 1
    single[-1] = at[-1] == len(codes) - 1
    plain = single & regular[codes[at]]
    plain[np.searchsorted(at, firsts)] = False
    own_codes = codes[at]
    # Known by their line: all units that are one chunk after a space.
    met = np.zeros(len(distinct), dtype=bool)
    met[own_codes[plain]] = True
    used = np.flatnonzero(met)
    lines, tail = stems(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), distinct.take(pa.array(used)), pa.scalar("", pa.large_string())))
    lines = lines.dictionary_encode()
    place, mark = np.zeros(len(distinct), dtype=np.int64), np.full(len(distinct), -1, dtype=np.int64)
    place[used], mark[used] = memory.look_up(lines.dictionary)[lines.indices.to_numpy(zero_copy_only=False)], tail
    # The rest: a text's first unit, and units that hold white space of other kinds.
    rest = np.flatnonzero(~plain)
    heads = np.zeros(len(values) + 1, dtype=bool)
    heads[firsts] = True
    strings, stops = [], np.append(at[1:], len(codes))
    for a, b in zip(at[rest].tolist(), stops[rest].tolist(), strict=True):
        strings.append(("" if heads[a] else " ") + (" ".join(values[a:b].to_pylist()) if b - a > 1 else distinct[int(codes[a])].as_py()))
    others = memory.many(strings)
    # One table: marks, remembered lines, the rest; each unit is an entry of it, or two with its mark.
    n_tails, n_known = len(memory.tail_lengths), len(memory.lengths)
    flat = np.concatenate([memory.tails, memory.flat, *others])
    lengths = np.concatenate([memory.tail_lengths, memory.lengths, np.fromiter(map(len, others), dtype=np.int64, count=len(others))])
    marked = np.where(plain, mark[own_codes], -1)
    entry = np.arange(len(at)) + np.concatenate([[0], np.cumsum(marked >= 0)[:-1]])
    chosen = np.empty(len(at) + int((marked >= 0).sum()), dtype=np.int64)
    chosen[entry] = n_tails + place[own_codes]
    chosen[entry[rest]] = n_tails + n_known + np.arange(len(rest))
    chosen[entry[marked >= 0] + 1] = marked[marked >= 0]
    out = ragged(flat, np.cumsum(lengths) - lengths, lengths, chosen)
    after = np.concatenate([[0], np.cumsum(lengths[chosen])])
    return out, after[np.append(entry, len(chosen))[np.searchsorted(at, bounds)]]
