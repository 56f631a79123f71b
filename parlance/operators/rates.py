"""Counts, shares, rates with confidence intervals, transitions and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scan import find_skew, lag, null_safe_join, ordered, position, total, top_per_key


def rate(target: Column | str, prefix: str = "") -> list[Column]:
    """count, mean and 1.96 * sqrt(p(1-p)/n) of a 0/1 column; ci is null where n = 0."""
    x = F.col(target) if isinstance(target, str) else target
    p, n = F.avg(x.cast("double")), F.count(x)
    return [n.alias(prefix + "n"), p.alias(prefix + "mean"),
            (F.lit(1.96) * F.sqrt(F.try_divide(p * (1 - p), n))).alias(prefix + "ci")]


def rates(df: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """Rates of several 0/1 targets in one aggregation."""
    if len(targets) == 1:
        return df.groupBy(*keys).agg(*rate(targets[0]))
    return df.groupBy(*keys).agg(*[c for t in targets for c in rate(t, t + "_")])


def count_share(df: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Count per key with its share of all rows, or of its ``within`` group.
    Shares are computed on the counts, never on the rows."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return share_of(n, "n", within or [])


def share_of(counts: DataFrame, n: str, within: list[str], out: str = "share") -> DataFrame:
    if within:
        size = counts.groupBy(*within).agg(F.sum(n).alias("_size"))
        return null_safe_join(counts, size, within).withColumn(out, F.col(n) / F.col("_size")).drop("_size")
    size = counts.agg(F.sum(n).alias("_size")).withColumn("_k", F.lit(1))
    return (counts.withColumn("_k", F.lit(1)).join(F.broadcast(size), "_k")  # one row
            .withColumn(out, F.col(n) / F.col("_size")).drop("_size", "_k"))


def session_stats(sessions: DataFrame, keys: list[str], ts: str, gap: str, limit: int = 21_600) -> DataFrame:
    return sessions.groupBy(*keys).agg(
        (F.max(ts) - F.min(ts)).alias("duration"), F.count(F.lit(1)).alias("turns"),
        F.avg(F.when(F.col(gap) < limit, F.col(gap))).alias("mean_gap"))


def transitions(turns: DataFrame, key: str, order: list[str], code: str, outcome: str,
                min_support: int = 100, min_turns: int = 4, hot_rows: int | None = None) -> DataFrame:
    """Edges previous code -> next code of conversations with enough turns: count,
    conversions and conversions / count."""
    skew = find_skew(turns, [key], hot_rows)
    d = ordered(turns.withColumn("to", F.coalesce(code, F.lit("no_answer"))), [key], order,
                {"from": lag("to"), "_pos": position(), "_n": total(F.lit(1), "count")}, skew=skew)
    d = d.where((F.col("_pos") > 1) & (F.col("_n") >= min_turns))
    e = d.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("conversions"))
    return e.where(F.col("n") >= min_support).withColumn("weight", F.try_divide(F.col("conversions").cast("double"), F.col("n")))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max; the last bin includes the maximum."""
    ends = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi")).withColumn("_k", F.lit(1))
    at = F.floor(F.coalesce(F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins)
    return (df.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k")  # one row
            .groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def distinct_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(c) for c in cols])


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def rank_align(tops: DataFrame, columns: list[str]) -> DataFrame:
    """Top lists side by side by rank, from the long (column, value, share, rank) form."""
    wide = tops.groupBy("rank").pivot("column", columns).agg(F.max("value").alias("value"), F.max("share").alias("share"))
    return wide


def top_words(words: DataFrame, keys: list[str], n: int) -> DataFrame:
    counts = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(counts, keys, [F.desc("n"), F.col("word")], n) if keys else (
        counts.orderBy(F.desc("n"), "word").limit(n))
