"""Passages that repeat across documents, by De Bruijn compaction.

Every window of K consecutive words is an edge of a De Bruijn graph between its first
and last K-1 words.  Only windows that can repeat become edges: a window has an anchor,
the least of its short-window hashes, and two equal windows have equal anchors, so
windows whose anchor stands in one text only are left out before anything is shuffled by
window.  Edges that stand in several documents are compacted: consecutive edges with the
same occurrences form a nonbranching path, kept as one span per document.  Each span is
joined to the coordinates of the same path in the document of the least id, and removed
only if the words there are the same.

Texts with the same words form a class that its least id stands for; all others of the
class are repeats from end to end and take no part in the graph.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.rows import text_key
from parlance.llm.text_hash import windows, word_hashes
from parlance.session import pinned, release

SHORT = 5  # words of an anchor


def _hashes(column: pa.Array):
    texts = [t.as_py() for t in column.cast(pa.binary())]
    for first, last, counts, h in word_hashes(texts):
        at = np.concatenate(([0], np.cumsum(counts)))
        for i in range(last - first):
            yield first + i, h[at[i]: at[i + 1]]


def _marks(batches):
    """Number and hash of the words of each text."""
    for b in batches:
        n, sha = [], []
        for t in b.column("text").cast(pa.binary()):
            words = (t.as_py() or b"").split()  # splits at the six white-space bytes only
            line = b" ".join(words)
            n.append(len(words))
            sha.append(hashlib.sha256(line).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "text_key", "n_words", "sha"])


def _anchor_runs(k: int):
    """(anchor, class, first window, number of windows) of maximal runs with one anchor;
    copies of a text of the same batch are left out."""
    short = min(SHORT, k)

    def run(batches):
        for b in batches:
            classes = b.column("c").to_pylist()
            fresh = list({c: i for i, c in enumerate(classes)}.values())
            texts = [t.as_py() or b"" for t in b.column("text").cast(pa.binary()).take(pa.array(fresh, pa.int64()))]
            for first, last, counts, h in word_hashes(texts):
                n = len(h) - k + 1
                if n < 1:
                    continue
                owner = np.repeat(np.arange(last - first), counts)
                start = np.concatenate(([0], np.cumsum(counts)))[owner[:n]]
                inside = owner[:n] == owner[k - 1:]
                s = windows(h, short)
                least = np.minimum.reduce([s[j: n + j] for j in range(k - short + 1)])
                edge = np.flatnonzero(inside & np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:n] != owner[:n - 1]) | ~inside[:-1])))
                if not len(edge):
                    continue
                # a run ends where the next begins or the windows of its text end
                stop = (np.cumsum(counts) - k + 1)[owner[edge]]
                size = np.minimum(np.append(edge[1:], n), stop) - edge
                c = np.array([classes[fresh[first + j]] for j in range(last - first)], np.int64)[owner[edge]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((least[edge].view(np.int64), pa.int64()), (c, pa.int64()), (edge - start[edge], pa.int32()), (size, pa.int32()))],
                                                 names=["v", "c", "s", "n"])
    return run


def _edges(k: int):
    def run(batches):
        for b in batches:
            docs, rows, runs = b.column("doc").to_pylist(), b.column("row").to_pylist(), b.column("runs")
            for at in range(0, b.num_rows, 200):
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i, h in _hashes(b.column("words").slice(at, 200)):
                    w, r = windows(h, k).view(np.int64), runs[at + i].values
                    s, n = r.field("s").to_numpy(), r.field("n").to_numpy()
                    on = np.zeros(len(w) + 1, np.int32)
                    np.add.at(on, s[s < len(w)], 1)
                    np.add.at(on, np.minimum(s + n, len(w))[s < len(w)], -1)
                    pos = np.flatnonzero(np.cumsum(on[:-1]))
                    for o, v in zip(out, (w[pos], np.full(len(pos), docs[at + i], np.int64), np.full(len(pos), rows[at + i], np.int64), pos)):
                        o.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["h", "doc", "row", "pos"])
    return run


def _slice_digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start: start + n]), digest_size=16).digest()


def _source_digests(batches):
    for b in batches:
        for i in range(b.num_rows):
            words = b.column("words")[i].as_py().encode().split()
            asked = b.column("asked")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column("row")[i].as_py()] * len(asked), pa.int64()), pa.array([a["s"] for a in asked], pa.int32()), pa.array([a["n"] for a in asked], pa.int32()),
                 pa.array([_slice_digest(words, a["s"], a["n"]) for a in asked], pa.binary())], names=["src_row", "s", "n", "digest"])


def _checked(batches):
    """Spans whose words equal the source's, and those that do not."""
    for b in batches:
        good, bad = [], []
        for i in range(b.num_rows):
            words = b.column("words")[i].as_py().encode().split()
            ok, no = [], []
            for x in b.column("spans")[i].as_py():
                (ok if x["digest"] is not None and _slice_digest(words, x["start"], x["n"]) == x["digest"] else no).append({"start": x["start"], "n": x["n"]})
            good.append(ok)
            bad.append(no)
        t = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(good, t), pa.array(bad, t)], names=["row", "good", "bad"])


def _window_digests(k: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, pos = b.column("words")[i].as_py().encode().split(), b.column("at")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([b.column("row")[i].as_py()] * len(pos), pa.int64()), pa.array(pos, pa.int32()),
                                                  pa.array([_slice_digest(words, p, k) for p in pos], pa.binary())], names=["row", "pos", "digest"])
    return run


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """Words outside all spans (``start``, ``n``)."""
    off = np.zeros(len(words) + 1, np.int64)
    for x in spans:
        off[x["start"]] += 1
        off[min(x["start"] + x["n"], len(words))] -= 1
    return [w for w, o in zip(words, np.cumsum(off[:-1])) if not o]


def _find(docs: DataFrame, k: int, id_col: str, text_col: str, hash_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks of all rows, spans (``row, doc, sha, spans``) of the texts that stand for a class
    and lose words, and the texts that were searched."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    first = pinned(rows.mapInArrow(_marks, f"doc_id {kind}, text_key long, n_words long, sha string"))
    owners = first.groupBy("sha").agg(F.min("doc_id").alias("owner"))
    marks = pinned(first.join(owners, "sha"))

    # windows that can repeat
    runs = pinned(rows.select(F.col("text_key").alias("c"), "text").mapInArrow(_anchor_runs(k), "v long, c long, s int, n int"))
    again = pinned(runs.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v"))
    some = pinned(runs.join(again, "v").groupBy("c").agg(F.collect_set(F.struct("s", "n")).alias("runs")))
    release(runs)
    heads = marks.where("doc_id = owner").groupBy("doc_id", "sha").agg(F.min("text_key").alias("c"), F.count(F.lit(1)).alias("times"))
    pick = pinned(some.join(heads, "c").select(F.col("c").alias("_c"), F.col("doc_id").alias("doc"), "runs", "times"))
    texts = rows.join(pick, (F.col("text_key") == F.col("_c")) & (F.col("doc_id") == F.col("doc"))).select("doc", F.col("text_key").alias("c"), F.col("text").alias("words"), "runs")
    if not pick.where("times > 1").isEmpty():
        texts = texts.dropDuplicates(["doc", "c"])
    texts = pinned(texts.withColumn("row", F.monotonically_increasing_id()))

    # edges in several documents, with what tells their occurrences apart
    def hashed(some: DataFrame) -> DataFrame:
        e = some.mapInArrow(_edges(k), "h long, doc long, row long, pos int")
        return e.withColumn("h", F.shiftrightunsigned("h", 64 - hash_bits)) if hash_bits < 64 else e

    edges = hashed(texts)
    known = pinned(edges.groupBy("h").agg(F.min("doc").alias("src"), F.max("doc").alias("_hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("fx"))
                   .where("src < _hi").select("h", "src", "n", "fx"))
    # compact: a path goes on while places follow each other and occurrences are the same
    order = Window.partitionBy("row").orderBy("pos")
    same = (F.col("pos") == F.lag("pos").over(order) + 1) & (F.col("src") == F.lag("src").over(order)) & (F.col("n") == F.lag("n").over(order)) & (F.col("fx") == F.lag("fx").over(order))
    paths = (edges.join(known, "h").withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
             .withColumn("path", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    spans = pinned(paths.groupBy("row", "path").agg(F.min("doc").alias("doc"), F.min("src").alias("src"), F.min("pos").alias("start"),
                                                    (F.max("pos") - F.min("pos") + k).cast("int").alias("n"), F.min_by("h", "pos").alias("h")).drop("path"))
    # source coordinates of each span
    source = spans.where("doc = src").groupBy("h", F.col("n").alias("_n")).agg(F.min(F.struct("row", "start")).alias("at"))
    pairs = pinned(spans.where("doc > src").join(source.withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")), "left")
                   .select("row", "start", "n", F.col("at.row").alias("src_row"), F.col("at.start").alias("s")))
    asked = pairs.where("src_row IS NOT NULL").select("src_row", "s", "n").distinct().groupBy(F.col("src_row").alias("row")).agg(F.collect_list(F.struct("s", "n")).alias("asked"))
    digests = pinned(texts.select("row", "words").join(asked, "row").mapInArrow(_source_digests, "src_row long, s int, n int, digest binary"))
    mine = pairs.join(digests, ["src_row", "s", "n"], "left").groupBy("row").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))
    span = "array<struct<start:int,n:int>>"
    checked = pinned(texts.select("row", "words").join(mine, "row").mapInArrow(_checked, f"row long, good {span}, bad {span}"))
    spans = checked.select("row", F.explode("good").alias("x")).select("row", "x.start", "x.n")

    # windows of spans without an equal source: compared by content
    bad = checked.where(F.size("bad") > 0).select("row", F.explode("bad").alias("x"))
    if not bad.isEmpty():
        left = bad.select("row", F.explode(F.sequence(F.col("x.start"), F.col("x.start") + F.col("x.n") - k)).alias("pos")).distinct()
        # only the texts with such spans are hashed again for their windows; written, the
        # hashes have a known size, and where they are few the edges meet them unshuffled
        again = hashed(texts.join(bad.select("row").distinct(), "row", "left_semi")).join(left, ["row", "pos"])
        places = pinned(edges.join(pinned(again.select("h").distinct()), "h"))
        at = places.groupBy("row").agg(F.collect_list("pos").alias("at"))
        exact = pinned(places.join(texts.select("row", "words").join(at, "row").mapInArrow(_window_digests(k), "row long, pos int, digest binary"), ["row", "pos"]))
        least = exact.groupBy("digest").agg(F.min("doc").alias("least"))
        more = exact.join(left, ["row", "pos"]).join(least, "digest").where("doc > least").select("row", F.col("pos").alias("start"), F.lit(k).alias("n"))
        spans = spans.unionByName(more)
    found = spans.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    which = marks.select(F.col("doc_id").alias("doc"), F.col("text_key").alias("c"), "sha").distinct()
    spans = found.join(texts.select("row", "doc", "c"), "row").join(which, ["doc", "c"])
    return marks, pinned(spans.select("row", "doc", "sha", "spans")), texts


def _with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    own = found.withColumnRenamed("sha", "_sha")
    return rows.join(own, (F.col("doc_id") == F.col("doc")) & (F.col("sha") == F.col("_sha")), "left").drop("doc", "_sha")


def repeated_spans(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, text_key, n_words, spans``, spans as
    ``array<struct<start,n>>`` of words that stand in windows of ``k`` consecutive words
    which also start in a document of smaller id.  Spans may touch or overlap.

    Words are runs outside space and \\x09-\\x0D, unchanged; a null text has none.  Windows
    are judged on the input.  Rows of one id never repeat each other; a row with a null id
    is neither source nor repeat.  An empty table gives no rows, other columns are not
    read.  ``hash_bits`` shortens the window hash (tests); windows whose hash misleads are
    compared by content."""
    marks, found, _ = _find(docs, k, id_col, text_col, hash_bits)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("n")))
    copy = (F.col("doc_id") > F.col("owner")) & (F.col("n_words") >= k)
    none = F.array().cast("array<struct<start:int,n:int>>")
    return _with_spans(marks, found.drop("row")).select("doc_id", "text_key", "n_words", F.coalesce(F.when(copy, whole), "spans", none).alias("spans"))


def _strip(keys: list[str]):
    """Words left of each text, with the named columns beside them."""
    def run(batches):
        for b in batches:
            kept, removed = [], []
            for t, s in zip(b.column("words").cast(pa.binary()), b.column("spans").to_pylist()):
                words = (t.as_py() or b"").split()
                left = kept_words(words, s)
                kept.append(b" ".join(left).decode())
                removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*keys, "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: what is left of each text, its words joined by
    one space.  Edge cases as in ``repeated_spans``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("words"))
    marks = repeated_spans(docs, k, id_col, text_col).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}).dropDuplicates(["_id", "_key"])
    out = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    kind = docs.schema[id_col].dataType.simpleString()
    return out.select("doc_id", "n_words", "words", "spans").mapInArrow(_strip(["doc_id", "n_words"]), f"doc_id {kind}, n_words long, n_removed long, kept string")


def kept_digests(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: as ``remove_repeats``, with the SHA-256 of
    what is left; only texts that lose a part are read again."""
    marks, found, texts = _find(docs, k, id_col, text_col, hash_bits)
    cut = texts.select("row", "words").join(found, "row").select("doc", "sha", "words", "spans")
    cut = cut.mapInArrow(_strip(["doc", "sha"]), "doc long, sha string, n_removed long, kept string")
    cut = pinned(cut.select("doc", "sha", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
    copy = (F.col("doc_id") > F.col("owner")) & (F.col("n_words") >= k)
    return _with_spans(marks, cut).select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
