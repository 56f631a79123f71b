"""Byte-level BPE encoding and decoding in padded numpy matrices.

The pieces of a batch of texts that are not known yet are laid out as rows of integer
matrices, one matrix per length class.  In each round every row looks all its adjacent
pairs up in a hash table, merges its leftmost pair of the lowest rank and closes the gap;
rows without a pair leave.  The ids of units and pieces are kept for later texts of the
same task, within bounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.units import UnitIds

NONE = np.int32(2**31 - 1)
CELLS = 1 << 20  # of a matrix
KNOWN, MEMORY = 60_000, 48 << 20  # pieces kept beside the units; bytes of the units kept


class PairTable:
    """Open-addressing hash table: (left id, right id) -> id of the merged token.

    A pair is listed for every way to cut a token's bytes into two tokens, which is what
    looking up the joined bytes amounts to."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(r)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(len(key), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE)
        todo, slot, self.probes = np.arange(len(key)), self._slot(key), 0
        while len(todo):  # every pass places one of the keys that want a free slot
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], np.array(merged, np.int32)[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
        # tokens whose merges with a neighbour can rank below the token itself
        self.unsafe = {int(t) for a, b, m in zip(left, right, merged) for t in (a, b) if m < t}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is none (also for padding, which is negative)."""
        shape = left.shape
        key = ((left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)).ravel()
        slot, out = self._slot(key), np.full(key.shape, NONE)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & self.mask
            if not len(todo):
                break
        return out.reshape(shape)


class ByteBpe:
    """Encoder and decoder for the ranks of a vocabulary file (base64 token, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.known: dict[str, bytes] = {}
        self.units = UnitIds(self._learn_units, MEMORY)

    def _rounds(self, m: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Final rows of a matrix padded with -1."""
        out: list[np.ndarray] = [None] * len(m)
        at = np.arange(len(m))
        merged = self.pairs.get(m[:, :-1], m[:, 1:])
        while len(m):
            col = merged.argmin(axis=1)
            row = np.arange(len(m))
            best = merged[row, col]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[at[i]] = m[i, : size[i]].copy()
                go = ~done
                m, size, at, merged, col, best = m[go], size[go], at[go], merged[go], col[go], best[go]
                if not len(m):
                    break
                row = np.arange(len(m))
            m[row, col] = best
            # close the gap: columns right of the merged pair move one to the left
            width = m.shape[1]
            take = np.arange(width - 1)[None, :]
            m = np.where(take <= col[:, None], m[:, :-1], m[:, 1:])
            size = size - 1
            width = max(2, int(size.max()))
            if width < m.shape[1]:
                m = m[:, :width]
            elif m.shape[1] < 2:
                m = np.pad(m, ((0, 0), (0, 2 - m.shape[1])), constant_values=-1)
            # only the pairs beside the merge are new; the others move
            old = merged
            n = m.shape[1] - 1
            take = take[:, :n]
            merged = np.where(take < col[:, None], old[:, :n], np.pad(old, ((0, 0), (0, 1)), constant_values=NONE)[:, 1 : n + 1])
            for d in (-1, 0):
                c = col + d
                ok = (c >= 0) & (c < n)
                merged[row[ok], c[ok]] = self.pairs.get(m[row[ok], c[ok]], m[row[ok], c[ok] + 1])
        return out

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long row.  Its equal lowest pairs are merged together, from the left and
        without overlap: what a merge newly pairs ranks higher, so the other equal pairs would
        be next anyway.  The few tokens of which that is not true are merged singly."""
        merged = self.pairs.get(ids[:-1], ids[1:])
        while len(merged) and (best := merged.min()) != NONE:
            hit = np.flatnonzero(merged == best)
            if int(best) not in self.pairs.unsafe:
                # in a run of overlapping hits every second one counts
                run = np.concatenate(([0], np.flatnonzero(np.diff(hit) != 1) + 1))
                first = np.repeat(run, np.diff(np.concatenate((run, [len(hit)]))))
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            else:
                hit = hit[:1]
            ids[hit] = best
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids = ids[keep]
            kept = np.flatnonzero(keep)
            merged = merged[kept[:-1]] if len(kept) > 1 else merged[:0]
            at = np.searchsorted(kept, hit)
            near = np.unique(np.concatenate((at, at - 1)))
            near = near[(near >= 0) & (near < len(merged))]
            merged[near] = self.pairs.get(ids[near], ids[near + 1])
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces, in matrices of rows of like length."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                self.known[p] = self.byte[raw[0] : raw[0] + 1].astype("<u4").tobytes()
            elif len(raw) > 256:
                self.known[p] = self._long(self.byte[np.frombuffer(raw, np.uint8)]).astype("<u4").tobytes()
            else:
                by.setdefault(-(-len(raw) // 4) * 4, []).append((p, raw))
        for width, rows in by.items():
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                size = np.array([len(r) for _, r in part])
                flat = self.byte[np.frombuffer(b"".join(r for _, r in part), np.uint8)]
                m = np.full((len(part), width), -1, np.int32)
                m[np.arange(width)[None, :] < size[:, None]] = flat
                for (p, _), ids in zip(part, self._rounds(m, size)):
                    self.known[p] = ids.astype("<u4").tobytes()

    def _learn_units(self, units: list[str]) -> list[bytes]:
        split = [self.pattern.findall(u) for u in units]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.learn(list({p for s in split for p in s if p not in self.known}))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(place of the first, ids of each) of slices of the texts, as little-endian unsigned
        32-bit integers."""
        return self.units.texts(texts)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x for _, part in self.slices(pa.array(texts, pa.large_string())) for x in part]

    def decode(self, ids: bytes) -> bytes:
        get = self.tokens.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids binary`` (little-endian unsigned 32-bit) with
    the ids of the whole text as byte-level BPE by rank gives them, each match of the
    pattern on its own and without special tokens.  A null text counts as empty and has
    no ids; repeated rows and null ids are kept; other columns are not read.
    ``ranks_path`` must be readable on the executors."""
    def run(batches):
        bpe = coder(ranks_path, pattern)
        for b in batches:
            for at, part in bpe.slices(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), pa.array(part, pa.binary())], names=["doc_id", "ids"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The reverse: ``doc_id, data binary`` with the bytes the ids stand for."""
    def run(batches):
        bpe = coder(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(x.as_py() or b"") for x in b.column("ids")], pa.binary())], names=["doc_id", "data"])
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids in the same task: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``, one row per input row; nulls as in ``encode_documents``."""
    def run(batches):
        bpe = coder(ranks_path, pattern)
        for b in batches:
            for at, ids in bpe.slices(b.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
