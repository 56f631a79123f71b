"""Repeatable samples, splits and folds by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scan import find_skew, null_safe_join, ordered, position, total
from parlance.operators.rates import share_of


def hash_key(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int, weight: str | None = None) -> DataFrame:
    """n rows in hash order; with ``weight``, a row's chance grows with its weight
    (smallest -ln(u) / w).  A top-n, so every task keeps only n rows."""
    if weight is None:
        return df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")
    u = (F.conv(F.substring(hash_key(seed, key), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(16 ** 13 + 1))
    return df.withColumn("_h", -F.ln(u) / F.col(weight)).orderBy("_h", key).limit(n).drop("_h")


def _hash_position(df: DataFrame, key: str, label: str, seed: int, hot_rows: int | None) -> DataFrame:
    """Place and number of rows of each row's label.  Only key and label are ordered, since a
    label's rows meet in one task; the other columns are joined by the key."""
    d = df.select(key, label).withColumn("_h", hash_key(seed, key))
    skew = find_skew(d, [label], hot_rows)
    d = ordered(d, [label], ["_h", key], {"_pos": position(), "_size": total(F.lit(1), "count")}, skew=skew).drop("_h")
    return d if set(df.columns) == {key, label} else null_safe_join(df, d, [key, label])


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.2, dev: float = 0.3, seed: int = 1,
                     hot_rows: int | None = None) -> DataFrame:
    """``part`` per row: test is ``test`` of each label, dev is ``dev`` of the rest."""
    d = _hash_position(df, key, label, seed, hot_rows)
    n_test = F.floor(F.col("_size") * test)
    n_dev = F.floor((F.col("_size") - n_test) * dev)
    part = F.when(F.col("_pos") <= n_test, "test").when(F.col("_pos") <= n_test + n_dev, "dev").otherwise("train")
    return d.withColumn("part", part).drop("_pos", "_size")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 3, seed: int = 1, hot_rows: int | None = None) -> DataFrame:
    d = _hash_position(df, key, label, seed, hot_rows)
    return d.withColumn("fold", ((F.col("_pos") - 1) % folds).cast("int")).drop("_pos", "_size")


def smoothed_weights(df: DataFrame, label: str, rare: float = 0.01, boost: float = 100.0) -> DataFrame:
    """(label, n, share, weight): the class share, times ``boost`` where it is rare."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    s = share_of(n, "n", [])
    return s.withColumn("weight", F.when(F.col("share") < rare, F.col("share") * boost).otherwise(F.col("share")))
