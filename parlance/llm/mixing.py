"""Mix sources to target weights with hash-threshold histograms.

Every row has a 60-bit hash of its id.  A source takes each of its rows a whole number
of times and, for the rest of its target, the rows whose hash lies below a threshold.
The threshold is found from histograms: sizes are summed by (source, leading hash
digits), the bucket in which the budget ends is cut into the next digits, and so on, so
that only the boundary bucket is read again; rows are never sorted.  Only DataFrame
operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import pinned

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP_BITS = 60, 8  # a histogram has at most 2^STEP_BITS rows for a source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources in code-point order, null last, take the weights in turn.  Targets share the
    sum of all sizes; with the cap, a source's target is the smaller of ``most`` times its
    size and a common level times its weight.  The level follows from sums over sources
    ordered by cap per weight, which is what resharing the excess until none is left over
    a cap arrives at.  The windows hold one row per source, not per document."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("_ratio", "_rank")
    every = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (sizes.withColumn("_rank", F.row_number().over(order) - 1)
         .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double"))
         .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
         .withColumn("_ratio", F.col("_cap") / F.col("_w")))
    s = (s.withColumn("_all", F.sum("source_size").over(every).cast("double"))
         .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
         .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open")))
    # the first source whose cap is not reached sets the level of it and all after it
    s = s.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(every))
    return s.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at._level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _bucket(level: int) -> Column:
    """Leading digits of the hash down to a level."""
    return F.shiftright("_hash", max(0, HASH_BITS - STEP_BITS * level))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``_below`` per source: rows with a smaller hash are taken.  A row is taken while the
    sizes before it plus half its own stay within the budget, so the sum of what is taken
    comes as near to the budget as whole rows allow; rows of one hash go together."""
    left, pool, done, level = budgets, rows, None, 0
    levels = -(-HASH_BITS // STEP_BITS)
    while True:
        level += 1
        here = pool.join(left.select("source", "_budget"), pool.source.eqNullSafe(left.source), "inner").drop(left.source)
        hist = here.groupBy("source", _bucket(level).alias("_b")).agg(
            F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_rows"),
            F.first("_budget").alias("_budget"), F.max("_hash").alias("_top"))
        w = Window.partitionBy("source").orderBy("_b")
        hist = (hist.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .withColumn("_single", (F.col("_rows") == 1) | F.lit(level == levels)))
        # the boundary is the first bucket not wholly below the budget
        edge = pinned(hist.where(F.col("_before") + F.col("_n") > F.col("_budget"))
                      .groupBy("source").agg(F.min(F.struct("_b", "_before", "_n", "_budget", "_single", "_top")).alias("_e"))
                      .select("source", "_e.*"))
        shut = edge.where("_single").select(
            "source", F.when(F.col("_before") + F.col("_n") / 2 <= F.col("_budget"), F.col("_top") + 1).otherwise(F.col("_top")).alias("_below"))
        done = shut if done is None else done.unionByName(shut)
        edge = edge.where(~F.col("_single"))
        if edge.isEmpty():
            return pinned(done)
        left = edge.select("source", (F.col("_budget") - F.col("_before")).alias("_budget"))
        at = edge.select(F.col("source").alias("_s"), "_b")
        pool = pinned(pool.join(at, pool.source.eqNullSafe(at._s) & (_bucket(level) == at._b), "left_semi"))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """One row per source: ``_s, source_size, target, _whole, _below``."""
    plan = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = pinned(plan.withColumn("_whole", F.floor(share + 1e-9).cast("long"))
                  .withColumn("_budget", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))))
    # a row of one word needs half a word of budget
    cut = _thresholds(rows, plan.where("_budget >= 0.5").select("source", "_budget"))
    return pinned(plan.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
                  .select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_below"))


def _copies(key: Column) -> Column:
    return F.col("_whole") + F.coalesce((key < F.col("_below")).cast("long"), F.lit(0))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return pinned(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                              word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("_hash")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix takes the
    row, ``taken`` = copies x size.  A null source is a source of its own, a null id hashes
    as the empty text, rows with one id stay together, sources of size 0 have target 0 and
    are taken 0 times; an empty table gives no rows.  Other columns are not read.

    Copies never exceed ``most``: the whole part of target / size is taken by all rows, the
    rest by the rows below the threshold."""
    rows = _rows(docs, id_col, text_col, source_col)
    plan = _plan(rows, weights, most)
    copies = _copies(F.col("_hash"))
    return (rows.join(plan, rows.source.eqNullSafe(plan._s))
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0,
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns.  The plan of
    one row per source is joined to the rows, which are not shuffled for it."""
    plan = _plan(_rows(docs, id_col, text_col, source_col), weights, most)
    return (docs.join(plan, F.col(source_col).cast("string").eqNullSafe(plan._s))
            .withColumn("_copies", _copies(id_hash(F.col(id_col)))).where("_copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[docs[c] for c in docs.columns]))
