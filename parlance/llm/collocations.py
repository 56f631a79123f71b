"""Phrase collocations from a weighted De Bruijn graph of word n-grams.

Nodes are runs of N-1 words, edges runs of N words: two nodes that overlap.  Counted are
edges and, where no edge begins, the shorter run that ends there: at the end of a piece of
text, or where the next word makes a run that cannot be frequent.  The shorter counts
follow from the flow through the nodes: a run of k words is followed by a word, and then
some run of k+1 words begins with it, or it ends; so its count is the flow of the runs it
begins plus the ends.  Edges of equal weight joined by nodes that nothing else enters or
leaves are compacted to paths by pointer doubling; a path has one weight, and a node inside
it can never beat the edge around it.

That a run cannot be frequent is proved by a table of hashed buckets of fixed size, in which
a pass over the texts counts all runs of two and of three words: a bucket below the least
count holds rare runs only, and no frequent phrase has a rare part.  Ending a run there
changes no frequent count.  The more text, the fuller the buckets and the longer the runs;
at worst every edge is shuffled once.  Words are told apart by their bytes, never by a hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.scan import top_per_key
from parlance.llm.text_hash import mix, word_hashes
from parlance.session import pinned

BUCKETS, RANGE = 1 << 26, 1 << 16  # of the table of rare runs: 8 MB as bits
CHUNK = 4 << 20  # bytes of text of one language that are counted together
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True
_GAP[[9, 32]] = True
_GAP |= _CUT
_TO_FIRST = np.uint64(0x9E3779B97F4A7C15)


class Chunk:
    """Words of some texts of one language: local ids, pieces, and the words themselves."""

    def __init__(self, texts: list[bytes], lang: str, buckets: int):
        a = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = ~_GAP[a]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[0::2], edges[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = a[inside]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        self.ids, self.words = words.indices.to_numpy().astype(np.int64), words.dictionary
        cuts = np.cumsum(_CUT[a], dtype=np.int32)[starts]
        self.next_in_piece = np.append(cuts[1:] == cuts[:-1], False)[: len(starts)]
        h = [x for *_, x in word_hashes(self.words.to_pylist())]
        self.hashes = np.concatenate(h) if h else np.zeros(0, np.uint64)
        self.buckets = np.uint64(buckets)
        self.salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))

    def run_buckets(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places where two and where three words of a piece begin, and their buckets."""
        out, at, h = [], np.arange(len(self.ids)), self.hashes[self.ids]
        whole = h
        for k in (2, 3):
            go = self.next_in_piece[at + k - 2]
            at, h = at[go], h[go]
            h = mix(h * _TO_FIRST + mix(whole[at + k - 1] + self.salt))
            out.append((at, (h % self.buckets).astype(np.int64)))
        return out


def _chunks(batches, buckets: int, most: int) -> Iterator[tuple[str, Chunk]]:
    """Texts (binary) by language, about ``most`` bytes together; a longer text comes alone."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            text = text.as_py()
            if not text:
                continue
            held.setdefault(lang, []).append(text)
            total += len(text)
            if total >= most:
                for k in list(held):
                    yield k, Chunk(held.pop(k), k, buckets)
                total = 0
    for k in list(held):
        yield k, Chunk(held.pop(k), k, buckets)


def _small(least: int) -> np.dtype:
    """Counts stop at ``least``, so a bucket takes a byte where that fits."""
    return np.dtype("u1" if least < 1 << 8 else "<u4")


def _bucket_sums(least: int, buckets: int, chunk: int):
    """Counts by bucket, up to ``least``, in compressed ranges; and the words by language."""
    def run(batches):
        table, words = np.zeros(buckets, _small(least)), {}
        for lang, c in _chunks(batches, buckets, chunk):
            words[lang] = words.get(lang, 0) + len(c.ids)
            for _, buckets_of in c.run_buckets():
                u, n = np.unique(buckets_of, return_counts=True)
                table[u] = np.minimum(table[u] + n, least)
        out = [(-1, k.encode(), n) for k, n in words.items()]
        if words:
            for r in range(-(-buckets // RANGE)):
                part = table[r * RANGE: (r + 1) * RANGE]
                if part.any():
                    out.append((r, zlib.compress(part.tobytes(), 1), 0))
        for i in range(0, max(len(out), 1), 256):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out[i: i + 256]], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["range", "data", "n"])
    return run


def _full_ranges(least: int):
    """Of each range, a bit for every bucket that reaches ``least``."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, data in zip(b.column("range").to_pylist(), b.column("data")):
                part = np.frombuffer(zlib.decompress(data.as_py()), _small(least)).astype(np.uint64)
                sums[r] = sums[r] + part if r in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(s >= least).tobytes() for s in sums.values()], pa.binary())], names=["range", "bits"])
    return run


def _joined(c: Chunk, at: np.ndarray, k: int) -> pa.Array:
    """The k words from each place on, joined by one space."""
    words = [c.words.take(pa.array(c.ids[at + j])) for j in range(k)]
    return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]


def _grams(bits: bytes, longest: int, buckets: int, chunk: int):
    """At every word the longest run, of ``longest`` words at most, that may be frequent;
    counted by chunk."""
    packed = np.frombuffer(bits, np.uint8)

    def full(at: np.ndarray) -> np.ndarray:
        return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def run(batches):
        for lang, c in _chunks(batches, buckets, chunk):
            n = len(c.ids)
            if not n:
                continue
            may = [np.ones(n, bool)]  # may[k - 1]: k words from here may be frequent
            for k, (at, b) in enumerate(c.run_buckets()[: longest - 1], 2):
                ok = np.zeros(n, bool)
                ok[at[full(b)]] = True
                may.append(ok if k == 2 else ok & may[-1] & np.append(may[-1][1:], False))
            while len(may) < longest:
                may.append(may[-1] & np.append(may[-1][1:], False))
            number, place = c.ids, np.arange(n)
            for k in range(1, longest + 1):
                if k > 1:  # number the runs of k words by (run of k-1 words, next word)
                    go = may[k - 1][place]
                    place = place[go]
                    _, number = np.unique(number[go] * len(c.words) + c.ids[place + k - 1], return_inverse=True)
                end = ~may[k][place] if k < longest else np.ones(len(place), bool)
                if end.any():
                    _, one, times = np.unique(number[end], return_index=True, return_counts=True)
                    text = _joined(c, place[end][one], k)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), pa.array(np.full(len(one), k, np.int32)), text.cast(pa.large_string()).cast(pa.string()), pa.array(times)],
                                                     names=["lang", "k", "phrase", "n"])
    return run


def _first(phrase: str, k) -> Column:
    return F.substring_index(phrase, " ", k)


def _summed(rows: DataFrame) -> DataFrame:
    return pinned(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))


class PhraseGraph:
    """Counts of all phrases of up to ``longest`` words that occur ``least`` times or more.

    ``counts[k]`` (lang, phrase, n) is exact where n >= ``least`` and never too high.
    ``words`` (lang, n) counts all words.  ``buckets`` (a multiple of 8) and ``chunk``, bytes
    that a task counts together, decide the work, not the counts."""

    def __init__(self, docs: DataFrame, least: int, longest: int, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, chunk: int = CHUNK):
        if longest < 2:
            raise ValueError("a phrase has two words or more")
        self.least, self.longest, self.spark = least, longest, docs.sparkSession
        rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
        sums = pinned(rows.mapInArrow(_bucket_sums(least, buckets, chunk), "range int, data binary, n long"))
        self.words = sums.where("range < 0").groupBy(F.col("data").cast("string").alias("lang")).agg(F.sum("n").alias("n"))
        parts = sums.where("range >= 0").repartition("range").mapInArrow(_full_ranges(least), "range int, bits binary")
        bits = bytearray(buckets // 8)  # of fixed size
        for r in parts.collect():
            bits[r.range * RANGE // 8: (r.range + 1) * RANGE // 8] = r.bits
        grams = rows.mapInArrow(_grams(bytes(bits), longest, buckets, chunk), "lang string, k int, phrase string, n long")
        grams = pinned(grams.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")))
        ends = lambda k: grams.where(F.col("k") == k).select("lang", "phrase", "n")
        self.counts = {longest: ends(longest)}
        for k in range(longest - 1, 0, -1):
            flow = self.counts[k + 1].select("lang", _first("phrase", k).alias("phrase"), "n")
            self.counts[k] = _summed(flow.unionByName(ends(k)))

    def frequent(self, k: int) -> DataFrame:
        return self.counts[k].where(F.col("n") >= self.least)

    def paths(self) -> DataFrame:
        """Frequent edges (lang, phrase, n) with the first edge of their path (``path``) and the
        distance to it (``at``).  An edge follows another where the node between them is
        entered and left by nothing else: both weights equal the node's count."""
        k = self.longest - 1
        edges = pinned(self.frequent(self.longest).withColumns({"left": _first("phrase", k), "right": _first("phrase", -k)}))
        nodes = self.frequent(k).select("lang", F.col("phrase").alias("right"), "n")
        ahead = edges.join(nodes, ["lang", "right", "n"]).select("lang", F.col("right").alias("left"), "n", F.col("phrase").alias("to"))
        at = pinned(edges.join(ahead, ["lang", "left", "n"], "left").select("lang", "phrase", "n", F.coalesce("to", "phrase").alias("path"), F.col("to").isNotNull().cast("long").alias("at")))
        while True:  # pointer doubling: a path of m edges takes log2 m rounds
            on = at.select("lang", F.col("phrase").alias("path"), F.col("path").alias("_path"), F.col("at").alias("_at")).where("_at > 0")
            if at.where("at > 0").join(on, ["lang", "path"], "left_semi").isEmpty():
                return at
            at = pinned(at.join(on, ["lang", "path"], "left").select("lang", "phrase", "n", F.coalesce("_path", "path").alias("path"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at")))

    def candidates(self) -> DataFrame:
        """Phrases (lang, k, phrase, a) of two words or more that no longer phrase covers with
        the same count.  A phrase one word longer is enough to look at, since counts never grow
        with length; nodes inside a path are covered by its edges."""
        paths = self.paths()
        out = paths.select("lang", F.lit(self.longest).alias("k"), "phrase", F.col("n").alias("a"))
        for k in range(self.longest - 1, 1, -1):
            here, above = self.frequent(k), self.frequent(k + 1)
            if k == self.longest - 1:
                inner = paths.where("at > 0").select("lang", _first("phrase", k).alias("phrase"))
                here, above = here.join(inner, ["lang", "phrase"], "left_anti"), paths
            cover = above.select("lang", F.explode(F.array(_first("phrase", k), _first("phrase", -k))).alias("phrase"), "n").distinct()
            out = out.unionByName(here.join(cover, ["lang", "phrase", "n"], "left_anti").select("lang", F.lit(k).alias("k"), "phrase", F.col("n").alias("a")))
        return out

    def scored(self) -> DataFrame:
        """Candidates with their lowest-scoring cut: ``lang, phrase, a, l, r, n, score``.  The
        products are decimals of 38 digits, the division keeps whole numbers."""
        parts = self.frequent(1)
        for k in range(2, self.longest):
            parts = parts.unionByName(self.frequent(k))
        parts = pinned(parts)
        cuts = self.candidates().withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        cuts = cuts.withColumns({"_l": F.expr("substring_index(phrase, ' ', cut)"), "_r": F.expr("substring_index(phrase, ' ', cut - k)")})
        for side, name in (("_l", "l"), ("_r", "r")):
            cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
        cuts = cuts.join(self.words, "lang")
        score = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) * 1000BD) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
        best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b"))
        return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang", **work: int) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts, A-Z lower-cased, are split at ``.,;:!?`` and \\x0A-\\x0D into pieces and those at
    space and tab into words.  A phrase has 2 to ``longest`` words of one piece and occurs
    ``least`` times or more in its language, overlaps and repeated rows included.  A null
    language is ``und``; null and empty texts have no words; an empty table gives no rows.
    Equal scores go by count, then by the phrase's bytes.  Other columns are not read."""
    rows = PhraseGraph(docs, least, longest, text_col, lang_col, **work).scored()
    ranked = top_per_key(rows, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrase_paths(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Long repeated phrases: the edges of every compacted path, one row each, in ``at`` order."""
    return PhraseGraph(docs, least, longest, text_col, lang_col).paths()
