"""Near-duplicates by MinHash: banding, signature verification, exact confirmation and
connected components.

Texts with one shingle set form a class, which one node stands for, so copies never make
pairs.  A node has HASHES minima of universal hash functions over its whole shingle set;
ROWS minima make a band, and nodes with an equal band meet in a bucket.  A pair of
similarity 0.75 misses all 48 bands of 4 rows with probability 1.2e-8.

Buckets are never multiplied out.  In every bucket the members are first compared with
the bucket's least node, which joins groups of near copies.  Where a bucket still holds
several components, the members outside the leader's component are held against all
others block by block: a task sees two blocks of signatures and lets out only the pairs
that agree, each in the first bucket the two share.  A bucket with more such pairs than a
few for each member is dense: its members' whole sets are sent to the block tasks, once for
each block, and pairs are confirmed there, until the block's labels are joined; only links
come out.  Components are joined as graphs of labels, so nodes are relabelled once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.graph import components
from parlance.llm.text_hash import mix, shingles, word_hashes
from parlance.llm.rows import keep_rows, text_key
from parlance.session import pinned

ROWS, BANDS = 4, 48
HASHES = ROWS * BANDS
BLOCK = 512  # members of a block of a bucket
DENSE_BLOCK = 128  # the same where sets are held
FEW = 4  # pairs let out for each member of a block
SLACK = 0.12  # a linked pair's signatures fall short by so much once in ten thousand
_SEEDS = np.random.PCG64(31_337).random_raw(2 * HASHES).astype(np.uint64)
_A, _B = (_SEEDS[:HASHES] | np.uint64(1))[:, None], _SEEDS[HASHES:][:, None]


def minima(values: np.ndarray) -> np.ndarray:
    """Upper halves of the minima of a x + b mod 2^64, one for each function."""
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(values), 2048):
        np.minimum(out, (values[None, i : i + 2048] * _A + _B).min(axis=1), out=out)
    return out >> np.uint64(32)


def _shingle_sets(column: pa.Array, words: int):
    """(place, shingle set) of every text; null is empty."""
    texts = [t.as_py() or b"" for t in column.cast(pa.binary())]
    for first, last, counts, h in word_hashes(texts, lower=True):
        at = np.concatenate(([0], np.cumsum(counts)))
        for i in range(first, last):
            yield i, shingles(h[at[i - first] : at[i - first + 1]], words)


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _marks(words: int):
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            rows = []
            for _, s in _shingle_sets(b.column("text"), words):
                if len(s):
                    m = minima(s)
                    k = mix((m.reshape(BANDS, ROWS) * _A.ravel()[: HASHES].reshape(BANDS, ROWS)).sum(axis=1, dtype=np.uint64))
                    rows.append((len(s), _digest(s), k.astype(np.int64), m.astype(np.uint8).tobytes()))
                else:
                    rows.append((0, None, None, None))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]],
                                             names=["doc_id", "text_key", "n_shingles", "digest", "bands", "signature"])
    return run


def _sets(words: int):
    """The shingle set of each node, from the row whose text has the node's digest."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = [(n, s.astype(np.int64)) for n, d, (_, s) in zip(b.column("node")[at: at + 500].to_pylist(), b.column("digest")[at: at + 500].to_pylist(), _shingle_sets(b.column("text").slice(at, 500), words))
                        if _digest(s) == d]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()), pa.array([s for _, s in part], pa.list_(pa.int64()))], names=["node", "items"])
    return run


_PAIR, _PAIR_TYPE = ["a", "b", "la", "lb"], "a long, b long, la long, lb long"


def _alike(least: float):
    """Pairs whose signatures agree in a share of at least ``least``."""
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in b.column(c)), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
            ok = pa.array((x == y).mean(axis=1) >= least)
            yield b.select(_PAIR).filter(ok)
    return run


def _are_linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 |A and B| >= percent |A or B| for sets given as sorted arrays."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(p) + len(q) - len(np.union1d(p, q))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _linked(percent: int):
    """Labels of pairs that are linked, on whole sets."""
    def run(batches):
        for b in batches:
            x, y = b.column("xa"), b.column("xb")
            ok = [_are_linked(x[i].values.to_numpy(), y[i].values.to_numpy(), percent) for i in range(b.num_rows)]
            yield b.select(["la", "lb"]).rename_columns(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


class _Group:
    """Members of two blocks of a bucket, or of one."""

    def __init__(self, t: pa.Table):
        self.t = t
        self.node, self.label, self.side = (t.column(c).to_numpy() for c in ("node", "label", "side"))
        self.key, self.one = t.column("key")[0].as_py(), bool(t.column("kind")[0].as_py()) and t.column("x")[0] == t.column("y")[0]
        self.sign = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, : t.column("band")[0].as_py()]
        self.root = self.label.copy()

    def join(self, i: int, j: int) -> None:
        self.root[self.root == self.root[j]] = self.root[i]

    def alike(self, least: float):
        """Pairs (i, j) of different components that share no earlier bucket and agree in
        their signatures; those of one i come together, as an array of j."""
        left = np.arange(len(self.node)) if self.one else np.flatnonzero(self.side == 0)
        right = left if self.one else np.flatnonzero(self.side == 1)
        for i in left:
            js = right[(self.root[right] != self.root[i]) & ((self.node[right] > self.node[i]) if self.one else True)]
            js = js[(self.sign[js] == self.sign[i]).sum(axis=1) >= least * HASHES]
            js = js[~(self.bands[js] == self.bands[i]).any(axis=1)]
            if len(js):
                yield i, js


def _groups(batches):
    """Every group (``key, kind, x, y``) of rows that come sorted by group; only the group
    at the end of a batch is carried on."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        of = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "kind", "x", "y")])
        cuts = np.concatenate(([0], np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield _Group(t.slice(lo, hi - lo))
        held = t.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield _Group(held)


_FOUND, _FOUND_TYPE = ["key", *_PAIR], "key long, " + _PAIR_TYPE


def _across(least: float, few: int = FEW):
    """Pairs across components in every group, or a row without a pair for a group that
    has more than ``few`` for each member."""
    def run(batches):
        for g in _groups(batches):
            found, most = [], few * len(g.node)
            for i, js in g.alike(least):
                found += [(i, j) if g.node[i] < g.node[j] else (j, i) for j in js]
                if len(found) > most:
                    break
            i, j = np.array(found, np.int64).reshape(-1, 2).T
            values = [None] * 4 if len(found) > most else [g.node[i], g.node[j], g.label[i], g.label[j]]
            n = 1 if len(found) > most else len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g.key), pa.int64()), *[pa.array([None] if v is None else v, pa.int64()) for v in values]], names=_FOUND)
    return run


def _confirmed(least: float, percent: int):
    """Labels of linked pairs of every group of members that bring their sets; a pair whose
    labels are already joined in the group is not looked at."""
    def run(batches):
        for g in _groups(batches):
            sets, links = [x.values.to_numpy() for x in g.t.column("items")], []
            for i, js in g.alike(least):
                for j in js:
                    if g.root[i] != g.root[j] and _are_linked(sets[i], sets[j], percent):
                        g.join(i, j)
                        links.append((g.label[i], g.label[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


class _Search:
    def __init__(self, rows: DataFrame, words: int, percent: int, block: int):
        self.percent, self.block = percent, block
        self.marks = pinned(rows.mapInArrow(_marks(words), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, n_shingles long, digest binary, bands array<long>, signature binary"))
        self.classes = pinned(self.marks.where("n_shingles > 0").groupBy("digest")
                              .agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
                              .withColumn("node", F.monotonically_increasing_id()))
        self.steps: list[DataFrame] = []  # labels that each step gave to the labels before it
        buckets = self.classes.select("node", F.posexplode("bands").alias("band", "key"))
        met = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1")
        self.members = pinned(buckets.join(met, "key").select("key", "band", "node", "lead"))
        some = self.classes.join(self.members.select("node"), "node", "left_semi").select("node", "digest", F.col("least").alias("_least"))
        texts = rows.join(some, F.col("doc_id").eqNullSafe(F.col("_least"))).select("node", "digest", "text")
        self.sets = pinned(texts.mapInArrow(_sets(words), "node long, items array<long>").dropDuplicates(["node"]))

    def _with(self, pairs: DataFrame, table: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
        for end, name in zip("ab", names):
            pairs = pairs.join(table.select(F.col("node").alias(end), F.col(value).alias(name)), end)
        return pairs

    def alike(self, pairs: DataFrame) -> DataFrame:
        return self._with(pairs, self.classes, "signature", ("sa", "sb")).mapInArrow(_alike(self.percent / 100 - SLACK), _PAIR_TYPE)

    def links(self, near: DataFrame) -> DataFrame:
        """Labels of the pairs (nodes ``a``, ``b`` of the components ``la``, ``lb``) that are
        linked, on whole sets."""
        return self._with(near, self.sets, "items", ("xa", "xb")).mapInArrow(_linked(self.percent), "a long, b long")

    def link(self, links: DataFrame) -> None:
        """Join the components of linked labels."""
        self.steps.append(components(links))

    def relabelled(self, rows: DataFrame, steps: list[DataFrame]) -> DataFrame:
        for step in steps:
            rows = rows.join(step.select(F.col("node").alias("label"), "root"), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
        return rows

    def mixed(self, members: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component after the last step,
        with the bucket's least node and its label."""
        m = self.relabelled(members, self.steps[-1:])
        several = m.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.min(F.struct("node", "label")).alias("_lead")).where("_lo < _hi")
        return pinned(m.join(several.select("key", F.col("_lead.node").alias("lead"), F.col("_lead.label").alias("lead_label")), "key"))

    def compare_lead(self, members: DataFrame) -> None:
        pairs = members.where("label <> lead_label").select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("lead_label").alias("la"), F.col("label").alias("lb"))
        self.link(self.links(self.alike(pairs.distinct())))

    def blocks(self, members: DataFrame, block: int) -> DataFrame:
        """A row of each member for every group it stands in: members outside the leader's
        component against all others of their bucket, block by block."""
        m = members.withColumn("rest", (F.col("label") != F.col("lead_label")).cast("int"))
        sizes = m.groupBy("key").agg(F.ceil(F.sum("rest") / block).cast("int").alias("nr"), F.ceil(F.sum(1 - F.col("rest")) / block).cast("int").alias("nc"))
        m = m.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("rest") == 1, F.col("nr")).otherwise(F.col("nc"))).cast("int"))
        m = m.join(self.classes.select("node", "signature", "bands"), "node")
        place = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
        own, zero, one = F.col("block"), F.lit(0), F.lit(1)
        every = lambda n, fn: F.transform(F.sequence(F.lit(0), F.col(n) - 1), fn)
        core = every("nr", lambda o: place(0, own, o, zero))
        rest = F.concat(every("nc", lambda o: place(0, o, own, one)), every("nr", lambda o: place(1, F.least(own, o), F.greatest(own, o), own > o)))
        rows = m.withColumn("at", F.explode(F.when(F.col("rest") == 0, core).otherwise(rest)))
        return rows.select("key", "at.kind", "at.x", "at.y", "at.side", "node", "label", "band", "signature", "bands")

    def compare_blocks(self, members: DataFrame) -> None:
        group, least = ["key", "kind", "x", "y"], self.percent / 100 - SLACK
        sort = lambda rows: rows.repartition(*group).sortWithinPartitions(*group)
        found = pinned(sort(self.blocks(members, self.block)).mapInArrow(_across(least), _FOUND_TYPE))
        dense = found.where("a IS NULL").select("key").distinct()
        links = self.links(found.where("a IS NOT NULL").join(dense, "key", "left_anti").select(*_PAIR))
        sets = self.blocks(members.join(dense, "key", "left_semi"), min(self.block, DENSE_BLOCK)).join(self.sets, "node")
        self.link(links.unionByName(sort(sets).mapInArrow(_confirmed(least, self.percent), "a long, b long")))

    def run(self) -> None:
        # one comparison per node, with the leader it shares most bands with
        best = self.members.where("node <> lead").groupBy("node").agg(F.mode("lead", True).alias("a"))
        self.link(self.links(self.alike(best.select("a", F.col("node").alias("b"), F.col("a").alias("la"), F.col("node").alias("lb")))))
        members = self.mixed(self.members.select("key", "band", "node", F.col("node").alias("label")))
        self.compare_lead(members)
        members = self.mixed(members.select("key", "band", "node", "label"))
        self.compare_blocks(members)

    def labels(self) -> DataFrame:
        return self.relabelled(self.classes.select("digest", "least", F.col("node").alias("label")), self.steps).withColumnRenamed("label", "root")


def _marked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    s = _Search(rows, words, percent, block)
    s.run()
    nodes = pinned(s.labels())
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = nodes.join(least, "root").select("digest", "component_id", "root")
    out = s.marks.select("doc_id", "text_key", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs outside space and \\x09-\\x0D with A-Z lower-cased.  A text's set holds
    its distinct ``words``-word shingles; with fewer words the whole sequence is one
    shingle; a text without words, or null, has none and is linked with nothing.  Texts are
    linked if 100 |A and B| >= ``percent`` |A or B|.  ``component_id`` is the least id
    reachable; ``kept`` marks the row that has it.  Repeated rows share a class; a null id
    is never the least unless a component has no other, and then its rows are kept.
    Other columns are not read.  ``block`` is the number of members that one task holds
    against as many others; it decides the plan, not the result."""
    return _marked(docs, id_col, text_col, words, percent, block).drop("text_key", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group, that of the least id, and all rows without words, with all
    their columns.  Among rows of that id the one of the least text key stays."""
    rows = pinned(_marked(docs, id_col, text_col, words, percent))
    one = rows.where("kept AND n_shingles > 0").groupBy("root").agg(F.min("text_key").alias("_one"))
    keep = F.col("kept") & (F.col("n_shingles").eqNullSafe(0) | (F.col("text_key") == F.col("_one")))
    marks = rows.join(one, "root", "left").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.coalesce(keep, F.lit(False)).alias("_keep"))
    return keep_rows(docs, marks, id_col, text_col)
