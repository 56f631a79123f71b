"""Row-level filters, deduplication and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.scan import null_safe_join, top_per_key


def exclude_yes_no(df: DataFrame, question: str, answers: str) -> DataFrame:
    """Drop every question that somewhere offers exactly [yes, no]."""
    yes_no = F.array(F.lit("yes"), F.lit("no"))
    closed = df.where(F.col(answers) == yes_no).select(question).distinct()
    return df.join(closed, question, "left_anti")


def min_share(df: DataFrame, key: str, least: float, allowed: list) -> DataFrame:
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    size = n.agg(F.sum("_n").alias("_all")).withColumn("_k", F.lit(1))
    keep = (n.where(F.col(key).isin(allowed)).withColumn("_k", F.lit(1)).join(F.broadcast(size), "_k")  # one row
            .where(F.col("_n") / F.col("_all") >= least).select(key))
    return df.where(F.col(key).isin(allowed)).join(keep, key, "left_semi")


def min_support(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def rare_labels(df: DataFrame, label: str, more_than: int = 10) -> DataFrame:
    """Rows of labels seen more than ``more_than`` times."""
    keep = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than).select(label)
    return df.join(keep, label, "left_semi")


def distinct_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in a stated order."""
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def best_per_text(df: DataFrame, keys: list[str], text: str, score: str, k: int) -> DataFrame:
    """Best score of each distinct text, then the k best texts per key."""
    best = df.groupBy(*keys, text).agg(F.max(score).alias(score))
    return top_per_key(best, keys, [F.desc(score), F.col(text)], k)


def one_to_one_ids(df: DataFrame, resolved: str, sender: str) -> DataFrame:
    """Rows whose resolved id belongs to a single sender.  min = max of the sender
    needs one pass with partial aggregation, unlike a distinct count."""
    single = (df.groupBy(resolved).agg(F.min(sender).alias("_a"), F.max(sender).alias("_b"))
              .where(F.col("_a") == F.col("_b")).select(resolved))
    return df.join(single, resolved, "left_semi")


def first_and_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First and last row per key under a ``source`` label.  Both come from one
    aggregation over structs, so no group is ever gathered."""
    cols = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *cols)
    ends = df.groupBy(*keys).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    both = ends.select(*keys, F.explode(F.array(
        F.struct(F.col("first").alias("row"), F.lit("first").alias("source")),
        F.struct(F.col("last").alias("row"), F.lit("last").alias("source")))).alias("e"))
    return both.select(*keys, *[F.col(f"e.row.{c}").alias(c) for c in cols], "e.source")
