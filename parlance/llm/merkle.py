"""Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent.

Every row is a leaf.  The leaves of a source stand in id order; every FAN consecutive nodes
make the next level's node until one is left, the source's subroot, and the subroots make
the root in the same way.  Levels are built bottom up, one shuffle of digests each, by
``(tree, position div FAN)``: no group is larger than FAN, however large a source is, and
positions come from range partitions, so a source is never one task.

What is kept is a table of records from digest to children; equal subtrees share a record.
A proof starts at the root: a request's position has one digit for each level, the digit
names the child to go down to, and the children not selected are collected.  Requests that
share a prefix go down together, so a level has no more rows than nodes.  At the leaf the
collected segments are reversed, which gives the siblings from leaf to root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.scan import ordered, position
from parlance.session import pinned, scratch

FAN_BITS = 4
FAN = 1 << FAN_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = ""  # the tree above the subroots
_SEGMENTS = "array<struct<left:string,right:string>>"
_UPPER = "".join(map(chr, range(65, 91)))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return sum((F.when(n > FAN**i, 1).otherwise(0) for i in range(15)), F.lit(0))


def _tree(source: Column) -> Column:
    """A key that sorts as the source does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


@dataclass
class Manifest:
    """``records`` (digest, children), ``trees`` (tree, source, n, pos, digest: one row for
    each source), ``leaves`` (tree, pos, and the columns given) and the root, null without rows."""
    records: DataFrame
    trees: DataFrame
    leaves: DataFrame
    root: str | None

    def write(self, path: str) -> None:
        """Three Parquet tables; the root stands in ``trees`` as the tree of empty name."""
        self.records.write.parquet(f"{path}/records")
        self.leaves.write.parquet(f"{path}/leaves")
        top = self.trees.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        self.trees.unionByName(top.select(F.lit(_TOP).alias("tree"), F.lit(None).cast("string").alias("source"), "n", F.lit(0).cast("long").alias("pos"), F.lit(self.root).alias("digest"))
                               ).write.parquet(f"{path}/trees")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        trees = spark.read.parquet(f"{path}/trees")
        top = trees.where(F.col("tree") == _TOP).head()
        return Manifest(spark.read.parquet(f"{path}/records"), trees.where(F.col("tree") != _TOP), spark.read.parquet(f"{path}/leaves"), top and top.digest)


def _positions(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``pos`` of each leaf in its tree and ``n``, the leaves of that tree.  Rows of one id
    follow in the order of their digests; equal rows in any."""
    ranged = leaves.withColumn("_any", F.monotonically_increasing_id())
    # short keys, since Spark samples them for the range bounds; the last splits equal rows
    keys = [F.col("tree"), *map(F.col, order), F.substring("leaf", 1, 16), F.col("_any")]
    ranged = pinned(ranged.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy("tree").orderBy("_part")  # one row per range and tree
    offsets = counts.select("tree", "_part", (F.sum("_m").over(w) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy("tree")).alias("n"))
    local = Window.partitionBy("tree", "_part").orderBy(*order, "leaf", "_any")
    out = ranged.join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.row_number().over(local) - 1)
    return pinned(out.drop("_part", "_before", "_any"))


def _levels(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The last node of every tree and the records of all levels, from ``tree, pos, n, digest``."""
    records, ends, left = [], [], nodes.agg(F.max("n")).head()[0] or 0
    while True:
        ends.append(nodes.where("n = 1").select("tree", "digest"))
        if left <= 1:
            break
        run = F.array_sort(F.collect_list(F.struct("pos", "digest")))  # at most FAN
        nodes = pinned(nodes.where("n > 1").groupBy("tree", F.shiftright("pos", FAN_BITS).alias("pos"))
                       .agg(F.transform(run, lambda x: x["digest"]).alias("children"), F.ceil(F.first("n") / FAN).cast("long").alias("n"))
                       .withColumn("digest", F.sha2(F.array_join("children", ""), 256)))
        records.append(nodes.select("digest", "children"))
        left = -(-left // FAN)
    last = ends[0]
    for e in ends[1:]:
        last = last.unionByName(e)
    return last, records


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source_col: str = "source", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of all rows.  A leaf digests ``fields`` in their order, so a null differs
    from an empty text and no value runs into the next; columns not named are not covered.
    Sources sort null first, then by bytes; ids null first.  Rows of one id are leaves side
    by side, equal rows too.  An empty table has no leaves, records or root.  ``keep`` names
    more columns of ``leaves``."""
    leaves = docs.select(_tree(F.col(source_col)).alias("tree"), F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("doc_id"),
                         leaf_digest([F.col(f) for f in fields]).alias("leaf"), *[c.alias(k) for k, c in (keep or {}).items()])
    leaves = _positions(leaves, ["doc_id"])
    subroots, records = _levels(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    sizes = leaves.groupBy("tree").agg(F.first("source").alias("source"), F.first("n").alias("n"))
    trees = pinned(ordered(sizes.join(subroots, "tree"), [], ["tree"], {"pos": position()}).withColumn("pos", F.col("pos") - 1))
    count = trees.count()
    top, more = _levels(trees.select(F.lit(_TOP).alias("tree"), "pos", F.lit(count).cast("long").alias("n"), "digest"))
    root = top.head()
    every = leaves.sparkSession.createDataFrame([], "digest string, children array<string>")
    for r in records + more:
        every = every.unionByName(r)
    records = pinned(every.groupBy("digest").agg(F.first("children").alias("children")))  # content-addressed
    return Manifest(records, trees, leaves.drop("source", "n"), root and root.digest)


def _segment(children: Column, at: Column) -> Column:
    """The children beside the one at ``at`` (from 0), joined, left and right of it."""
    at = at.cast("int")
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("left"), F.array_join(F.slice(children, at + 2, F.lit(FAN)), "").alias("right"))


def _down(front: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows ``tree, depth, pos, digest, segments`` taken down to the parents of leaves
    (depth 1) or, in trees of one leaf, to it, along the positions of ``wanted`` (tree, pos)."""
    deep = max(1, (front.agg(F.max("depth")).head()[0] or 0))
    runs = [pinned(wanted.select("tree", F.shiftright("pos", FAN_BITS).alias("pos")).distinct())]  # level 1
    for _ in range(2, deep):
        runs.append(pinned(runs[-1].select("tree", F.shiftright("pos", FAN_BITS).alias("pos")).distinct()))
    for level in range(deep, 1, -1):
        here = front.where(F.col("depth") == level).join(records, "digest")
        here = here.select("tree", (F.col("depth") - 1).alias("depth"), F.col("pos").alias("_up"), "segments", "children", F.posexplode("children").alias("_i", "digest"))
        here = here.select("tree", "depth", (F.shiftleft("_up", FAN_BITS) + F.col("_i")).alias("pos"), "digest", "segments", "children", "_i")
        here = here.join(runs[level - 2], ["tree", "pos"], "left_semi")
        here = here.select("tree", "depth", "pos", "digest", F.concat("segments", F.array(_segment(F.col("children"), F.col("_i")))).alias("segments"))
        front = pinned(here.unionByName(front.where(F.col("depth") < level)))
    return front


def _arrive(front: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (``tree, pos`` and others) with the digest found at their position and their
    segments, root first."""
    ends = front.join(records, "digest", "left").select("tree", F.col("pos").alias("_run"), "depth", F.col("digest").alias("_end"), "children", "segments")
    digit = F.col("pos").bitwiseAND(FAN - 1)
    lone = F.col("depth") == 0
    out = requests.withColumn("_run", F.shiftright("pos", FAN_BITS)).join(ends, ["tree", "_run"])
    return (out.withColumn("digest", F.when(lone, F.col("_end")).otherwise(F.try_element_at("children", (digit + 1).cast("int"))))
            .withColumn("segments", F.when(lone, F.col("segments")).otherwise(F.concat("segments", F.array(_segment(F.col("children"), digit)))))
            .drop("_run", "depth", "_end", "children"))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Requests (``tree, pos`` and any columns) with ``digest``, the leaf that the records
    hold there, ``subroot`` and ``segments``: the siblings left and right of the path, from
    the leaf to the root.  Only records on the way to a request are read beyond the join.  A
    position outside its tree, or an unknown tree, gives no row."""
    m, spark = manifest, requests.sparkSession
    none = F.array().cast(_SEGMENTS)
    asked = m.trees.join(requests.select("tree").distinct(), "tree", "left_semi")
    tops = asked.select(F.lit(_TOP).alias("tree"), "pos", F.col("tree").alias("_tree"), F.col("n").alias("_n"))
    start = spark.createDataFrame([(_TOP, m.trees.count(), m.root)] if m.root else [], "tree string, n long, digest string")
    start = start.select("tree", _depth(F.col("n")).alias("depth"), F.lit(0).cast("long").alias("pos"), "digest", none.alias("segments"))
    subroots = _arrive(_down(start, m.records, tops), m.records, tops)
    front = pinned(subroots.select(F.col("_tree").alias("tree"), _depth(F.col("_n")).alias("depth"), F.lit(0).cast("long").alias("pos"), "digest", "segments"))
    of = front.select("tree", F.col("digest").alias("subroot"))
    found = _arrive(_down(front, m.records, requests.select("tree", "pos")), m.records, requests)
    return found.where("digest IS NOT NULL").join(of, "tree").withColumn("segments", F.reverse("segments"))


def proof_digest(segments: Column) -> Column:
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(segments, leaf, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def tamper_check(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``.  Where 5 divides the CRC-32 of the id, A-Z of the text are lower-cased after
    the manifest stands, and the root is folded from that leaf; a null id is left alone.
    The manifest is written to a folder and read back.  Edge cases as in ``build``."""
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    now = leaf_digest([lowered if f == "text" else F.col(f) for f in FIELDS])
    path = scratch(docs.sparkSession)
    build(docs, keep={"now": F.when(struck, now)}).write(path)
    m = Manifest.read(docs.sparkSession, path)
    out = prove(m, m.leaves).withColumn("root", F.lit(m.root).cast("string"))
    out = out.withColumn("folded_root", fold(F.coalesce("now", "leaf"), F.col("segments")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("segments")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
