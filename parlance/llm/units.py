"""Texts as units that a tokenizer treats apart from their neighbours.

Where a single space stands between two characters that are not white space, no
tokenizer used here joins or looks across the boundary before that space.  A text is
therefore the row of its units, and what a tokenizer makes of a unit is kept for later
texts of the same task.  The kept units are bounded in bytes; forgetting one costs time
only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
LONGEST = 64  # characters of a unit that is kept
ENTRY = 160  # bytes of a dictionary entry and its value


class Units:
    """``learn`` maps unit texts to values; ``values`` gives those of whole texts.

    A unit's text holds its leading space, the first unit of a text has none.  Inside, the
    part after the space is the key, and a first unit has a space behind it."""

    def __init__(self, learn: Callable[[list[str]], list], memory: int = 128 << 20):
        self.learn, self.half, self.size = learn, memory // 2, 0  # bytes, of known
        self.known: dict = {}
        self.older: dict = {}

    def values(self, texts: list[str]) -> list[list]:
        rows, new, odd, long = [], set(), {}, []
        for i, t in enumerate(texts):
            keys = t.split(" ")
            keys[0] += " "
            rows.append(keys)
            new |= set(keys).difference(self.known)
        for k in list(new):
            if k in self.older:
                self.known[k] = self.older[k]
                self.size += ENTRY + getsizeof(k)
                new.discard(k)
        bad = {k for k in new if not (bare := k[:-1] if k[-1:] == " " else k) or bare[0].isspace() or bare[-1].isspace()}
        if bad:  # white space beside a space, or at an end
            for i, keys in enumerate(rows):
                if not bad.isdisjoint(keys):
                    first, *rest = _BETWEEN.split(texts[i])
                    odd[i] = self.learn([first, *(" " + r for r in rest)])
            new -= bad
        if new:
            keys = list(new)
            for k, v in zip(keys, self.learn([k[:-1] if k[-1] == " " else " " + k for k in keys])):
                self.known[k] = v
                if len(k) > LONGEST:
                    long.append(k)
                else:
                    self.size += ENTRY + getsizeof(k)
        get = self.known.__getitem__
        out = [odd[i] if i in odd else list(map(get, keys)) for i, keys in enumerate(rows)]
        for k in long:
            del self.known[k]
        if self.size > self.half:
            self.older, self.known, self.size = self.known, {}, 0
        return out


class UnitIds:
    """The same for values that are arrays of unsigned 32-bit integers, for a column of
    texts at a time: Arrow finds the distinct units of a slice of texts, only those are
    looked up, and the arrays of the texts are gathered from theirs."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], memory: int = 128 << 20):
        self.learn, self.half, self.size = learn, memory // 2, 0  # bytes, of known
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _values(self, units: list[bytes]) -> list[bytes]:
        known, older = self.known, self.older
        out = list(map(known.get, units))
        gone = [i for i, v in enumerate(out) if v is None]
        again = [older.get(units[i]) for i in gone]
        new = [i for i, v in zip(gone, again) if v is None]
        fresh = dict(zip(new, self.learn([units[i].decode() for i in new])))
        for i, v in zip(gone, again):
            u = units[i]
            out[i] = v = fresh[i] if v is None else v
            if len(u) <= LONGEST:
                known[u] = v
                self.size += ENTRY + 33 + len(u)
        if self.size > self.half:
            self.older, self.known, self.size = known, {}, 0
        return out

    def texts(self, column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
        """(place of the first, values) of consecutive texts of about ``most`` bytes."""
        column = column.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield at, self._slice(column.slice(at, end - at), offsets[at: end + 1])
            at = end

    def _slice(self, column: pa.Array, offsets: np.ndarray) -> list[bytes]:
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        # a unit begins with its space; a text that begins with one has an empty first unit
        bounds = np.concatenate((starts, np.flatnonzero(data == 32)))
        order = np.argsort(bounds, kind="stable")
        bounds, owner = bounds[order], np.cumsum(order < len(starts)) - 1
        units = pa.Array.from_buffers(pa.large_binary(), len(bounds), [None, pa.py_buffer(np.append(bounds, len(data))), pa.py_buffer(data)]).dictionary_encode()
        distinct, index = units.dictionary.to_pylist(), units.indices.to_numpy()
        # bare white space, or white space beside the space or at an end: looked at where the
        # first or last byte is not of a plain character
        ends_of = np.frombuffer(units.dictionary.buffers()[1], np.int64)[: len(distinct) + 1]
        letters = np.append(np.frombuffer(units.dictionary.buffers()[2] or b"", np.uint8), np.uint8(32))
        first = letters[ends_of[:-1]]
        first = np.where(first == 32, letters[np.minimum(ends_of[:-1] + 1, len(letters) - 1)], first)
        last = letters[np.maximum(ends_of[1:] - 1, 0)]
        last = np.where(np.diff(ends_of) == 0, 32, last)
        bad = np.zeros(len(distinct), bool)
        for i in np.flatnonzero((first < 33) | (first > 126) | (last < 33) | (last > 126)).tolist():
            t = distinct[i].removeprefix(b" ").decode()
            bad[i] = not t or t[0].isspace() or t[-1].isspace()
        for i in np.flatnonzero(bad):
            distinct[i] = b"x"  # its texts are read another way below
        values = self._values(distinct)
        size = np.fromiter(map(len, values), np.int32, len(values)) // 4
        flat, place = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size, dtype=np.int32) - size
        n = size[index]
        until = np.cumsum(n, dtype=np.int64)
        # a slice has far fewer than 2^31 ids, unless one text has: then wider numbers
        kind = np.int32 if len(until) == 0 or until[-1] < 2**31 else np.int64
        first_id = place[index].astype(kind) - (until - n).astype(kind)
        ids = flat[np.repeat(first_id, n) + np.arange(until[-1] if len(n) else 0, dtype=kind)].tobytes()
        ends = np.append(np.flatnonzero(order < len(starts))[1:], len(bounds)) - 1  # last unit of each text
        cuts = [0, *(until[ends] * 4).tolist()]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in np.unique(owner[bad[index]]):
            first, *rest = _BETWEEN.split(column[int(i)].as_py())
            out[i] = b"".join(self.learn([first, *(" " + r for r in rest)]))
        return out


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together until a column has about ``most`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def groups(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts (null: empty) of about a megabyte, with the place of the first."""
    part, size, at = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        part.append(t)
        size += len(t)
        if size >= most:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part
