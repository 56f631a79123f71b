"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once.  The leading bits of the hash name a bin, which
keeps the least hash that falls into it; sorting the hashes of a text puts each bin's
least first.  An empty bin takes the value of the first full bin on a probe sequence of
its own (optimal densification: the borrowed bin depends on the empty bin's number and not
on its neighbours).  The low-order byte of every bin is stored, and the likeness of two
fingerprints corrects for bytes that agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS, LOW_BITS, WORDS, PROBES = 7, 8, 5, 8
BINS = 1 << BIN_BITS
CHANCE = 1 / (1 << LOW_BITS)
WHITE = " \t\n\x0b\f\r"
SPAN = 512  # bounds of one part of the bound list
_rng = random.Random(5)
#: the probes of bin i are start[i] + t * step[i] mod BINS; odd steps reach every bin
_START = [_rng.randrange(BINS) for _ in range(BINS)]
_STEP = [_rng.randrange(1, BINS, 2) for _ in range(BINS)]


def _numbers(values: list[int]) -> Column:
    """A constant array; written as text, so that the plan holds one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _shingle_hashes(words: Column) -> Column:
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WORDS)]))
    return F.when(n >= WORDS, each).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: one low-order byte per bin, or an empty array for a text without words.
    Every step is a column of its own, so that lambdas read arrays and never redo them."""
    t = F.btrim(F.col(text), F.lit(WHITE))
    cols = [f"_{out}_{i}" for i in range(5)]
    words, hashes, least, bins, full = cols
    df = df.withColumn(words, F.transform(F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+", -1)), lambda w: F.xxhash64(w)))
    df = df.withColumn(hashes, F.sort_array(_shingle_hashes(F.col(words)))).drop(words)
    df = df.withColumn(least, F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(F.col(hashes), i - 1))))).drop(hashes)
    df = df.withColumn(bins, F.transform(least, _bin))
    at = lambda i: F.get(F.col(least), F.array_position(F.col(bins), i).cast("int") - 1)
    every = F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))
    df = df.withColumn(full, F.transform(every, lambda i: at(i).bitwiseAND((1 << LOW_BITS) - 1)))

    def value(v: Column, i: Column) -> Column:
        probe = [F.get(F.col(full), F.get(_numbers([(s + t * d) % BINS for s, d in zip(_START, _STEP)]), i).cast("int")) for t in range(PROBES)]
        # number of the probe that reaches each full bin; the least one wins
        back, start = _numbers([pow(d, -1, BINS) for d in _STEP]), _numbers(_START)
        far = F.array_min(F.transform(F.col(bins), lambda j: F.pmod((j - F.get(start, i)) * F.get(back, i), F.lit(BINS)) * BINS + j))
        return F.coalesce(v, *probe, F.get(F.col(full), (far % BINS).cast("int")))

    dense = F.when(F.size(bins) > 0, F.transform(full, value)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, dense).drop(least, bins, full)


def packed(bins: Column) -> Column:
    """The fingerprint as hexadecimal text, two digits for each bin."""
    return F.array_join(F.transform(bins, lambda v: F.lower(F.lpad(F.hex(v), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets, 0 to 1; two empty texts are alike."""
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"])) / F.lit(float(BINS))
    some = F.greatest(F.lit(0.0), (same - CHANCE) / (1 - CHANCE))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(some)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint``, one row per input row; a null text counts as empty, and a
    text without words has the empty fingerprint.  Fewer than five words are one shingle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_bins(rows, "_text", "_fp").select("doc_id", packed(F.col("_fp")).alias("fingerprint"))


def _ranges(rows: DataFrame, part_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``_range``: ids of one range are smaller than those of the next, null first.
    The bounds are the least id of each part of a range partitioning of the ids alone;
    their number follows the bytes of text, up to 2^18."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    parts = int(min(1 << 18, max(2 * spark.sparkContext.defaultParallelism, total // part_bytes)))
    ids = rows.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(parts, "doc_id")
    bounds = sorted(r[0] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("m")).select("m").distinct().collect())[1:]
    if not bounds:
        return rows.withColumn("_range", F.lit(0).cast("long")), 1
    fine, coarse = _numbers(bounds), _numbers(bounds[::SPAN])
    group = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id")))
    inner = F.size(F.filter(F.slice(fine, (F.col("_group") - 1) * SPAN + 1, SPAN), lambda b: b <= F.col("doc_id")))
    at = F.when(F.coalesce(F.col("_group"), F.lit(0)) > 0, (F.col("_group") - 1) * SPAN + inner).otherwise(F.lit(0))
    return rows.withColumn("_group", F.when(F.col("doc_id").isNotNull(), group)).withColumn("_range", at.cast("long")).drop("_group"), len(bounds) + 1


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 64 << 20) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last quarter of the
    code points (rounded down) is replaced by the first as many, or all, of the next
    document in ascending id order; the last document is followed by the first.

    One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.  A null text counts as empty.  Null ids
    come first; rows of one id follow each other in the order of their texts; a single row
    is followed by itself; an empty table gives no rows; other columns are not read.

    Documents are dealt out once, by id range.  The first document of each range is also
    put behind the range before it, so that every row finds its successor in its range."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, count = _ranges(rows, part_bytes)
    first = rows.groupBy("_range").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_k"))).alias("m"))
    heads = (rows.join(F.broadcast(first.select("_range", "m._k")), "_range")  # one row per range, 2^18 at most
             .where(F.coalesce(F.col("doc_id"), F.lit(-(2**63))) == F.col("_k"))
             .groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")).alias("h"), F.lit(1).alias("_copy"))
             .select(F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"), F.pmod(F.col("_range") - 1, F.lit(count)).alias("_range"), "_copy"))
    order = Window.partitionBy("_range").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "text")
    every = rows.withColumn("_copy", F.lit(0)).unionByName(heads)
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    every = (every.withColumn("_next", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
             .withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)))
             .drop("_next"))
    every = with_bins(with_bins(every, "text", "_fp"), "_edited", "_efp")
    every = every.withColumn("_nfp", F.lead("_fp").over(order)).where("_copy = 0")
    return every.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), packed(F.col("_fp")).alias("fingerprint"), packed(F.col("_efp")).alias("edited_fingerprint"),
                        likeness(F.col("_fp"), F.col("_efp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_nfp")).alias("near_next"))
