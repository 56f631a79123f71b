"""Exact duplicates by content-defined chunk recipes.

A text, without white space, is cut where a rolling hash of its last bytes has its low
bits clear, so equal passages are cut alike wherever they stand.  Every distinct chunk
gets an identifier that is verified against the chunk's bytes; a text is then the
ordered list of its chunk identifiers, and texts are compared by these lists.  Chunk
bytes are moved once, combined before the shuffle; whole texts are never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.rows import keep_rows, text_key
from parlance.session import pinned

WHITE = b" \t\n\x0b\x0c\r"
LEAST, MASK, MOST, SPAN = 256, (1 << 10) - 1, 8192, 16
_GEAR = np.random.PCG64(977).random_raw(256).astype(np.uint64)


def cuts(data: bytes) -> list[int]:
    """Chunk ends.  A cut depends on the SPAN bytes before it and the cut before it."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    ends, at = [], 0
    g = _GEAR[np.frombuffer(data, np.uint8)]
    roll = g.copy()
    for j in range(1, SPAN):  # roll[i] = sum of g[i-j] << j over the window
        roll[j:] += g[:-j] << np.uint64(j)
    marks = np.flatnonzero((roll >> np.uint64(20)) & np.uint64(MASK) == 0) + 1
    while n - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _chunks(data: bytes, bits: int) -> tuple[list[int], list[bytes]]:
    at, parts = 0, []
    for end in cuts(data):
        parts.append(data[at:end])
        at = end
    drop = 64 - bits
    return [(xxhash.xxh3_64_intdigest(p) >> drop) - (1 << 63 if not drop else 0) for p in parts], parts


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, t in enumerate(batch.column("text").cast(pa.binary())):
        yield i, (t.as_py() or b"").translate(None, WHITE)


def _recipes(bits: int):
    def run(batches):
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            ids, sums = [], []
            for _, data in _texts(b):
                ids.append(_chunks(data, bits)[0])
                sums.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_chars"), b.column("text_key"), pa.array(sums, pa.string()), pa.array(ids, pa.list_(pa.int64()))],
                names=["doc_id", "n_chars", "text_key", "text_sha256", "recipe"])
    return run


def _pieces(bits: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                seen: dict[bytes, int] = {}
                for _, data in _texts(b.slice(at, 1000)):
                    ids, parts = _chunks(data, bits)
                    seen.update(zip(parts, ids))
                yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.int64()), pa.array(seen.keys(), pa.binary())], names=["chunk", "data"])
    return run


def _places(bits: int):
    def run(batches):
        for b in batches:
            ids = b.column("doc_row")
            for i, data in _texts(b):
                h, parts = _chunks(data, bits)
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * len(h), pa.string()), pa.array(range(len(h)), pa.int32()), pa.array(h, pa.int64()), pa.array(parts, pa.binary())],
                                                     names=["doc_row", "at", "chunk", "data"])
    return run


def _grouped(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    recipes = pinned(rows.mapInArrow(_recipes(bits), f"doc_id {kind}, n_chars long, text_key long, text_sha256 string, recipe array<long>"))

    # verify: one hash, one content
    distinct = rows.select("text").mapInArrow(_pieces(bits), "chunk long, data binary").groupBy("chunk", "data").agg(F.count(F.lit(1)).alias("_n"))
    met = pinned(distinct.groupBy("chunk").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("chunk"))
    if met.isEmpty():
        recipes = recipes.withColumn("fix", F.array().cast("array<struct<at:int,rank:int>>"))
    else:
        named = rows.withColumn("doc_row", F.sha2(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", ""), 256))
        places = pinned(named.select("doc_row", "text").mapInArrow(_places(bits), "doc_row string, at int, chunk long, data binary").join(met, "chunk", "left_semi"))
        contents = places.select("chunk", "data").distinct()
        # rank of a content among those of its hash: how many of them sort before it
        other = contents.withColumnRenamed("data", "_data")
        rank = contents.join(other, "chunk").groupBy("chunk", "data").agg(F.sum((F.col("_data") < F.col("data")).cast("int")).cast("int").alias("rank"))
        fix = (places.distinct().join(rank, ["chunk", "data"]).groupBy(F.col("doc_row").alias("text_sha256"))
               .agg(F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("fix")))
        recipes = recipes.join(fix, "text_sha256", "left").withColumn("fix", F.coalesce("fix", F.array().cast("array<struct<at:int,rank:int>>")))

    # compare the ordered lists: the partial aggregate meets a hot group before the shuffle
    best = F.struct((-F.col("n_chars")).alias("_n"), F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    groups = recipes.groupBy("recipe", "fix").agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("_best._id")) & (F.col("n_chars") == -F.col("_best._n")) & (F.col("text_key") == F.col("_best._key"))
    return recipes.join(groups, ["recipe", "fix"]).select("doc_id", F.col("_best._id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "text_key")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are after deletion of space and \\x09-\\x0D; a null text counts
    as empty, and all empty texts are equal.  The row with the most code points in the
    original text, then the smallest id (null last), stays.  Repeated rows of the text that
    stays are all marked kept; ``group_size`` counts rows.  An empty table gives no rows;
    other columns are not read.

    ``bits`` shortens the chunk hash (tests).  Chunks whose hash meets another chunk's are
    told apart by the order of their bytes, so an identifier always means one content."""
    return _grouped(docs, id_col, text_col, bits).drop("text_key")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one for each group, with all their columns; nulls and empty
    tables as in ``exact_duplicates``, repeated rows leave one."""
    marks = _grouped(docs, id_col, text_col, 64).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("kept").alias("_keep"))
    return keep_rows(docs, marks, id_col, text_col)
