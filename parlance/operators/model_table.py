"""The feature table of the answered-question model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.expr import bucket_rare, clean_names, from_epoch_s
from parlance.operators.rows import exclude_yes_no
from parlance.session import pinned


def one_hot(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """0/1 columns ``<column>_<value>`` in place of the category columns."""
    flags = {f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for c, vs in values.items() for v in vs}
    return df.withColumns(flags).drop(*values)


def category_values(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Values of bucketed category columns: one aggregate row (41 values each after rare
    ones were bucketed)."""
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def inverse_one_hot(cols: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(c)) for c in cols])


NUMBERS = ["question_rank", "time_from_start", "sum_answer", "num_quick_replies", "hour", "day_of_week"]


def model_table(jnd: DataFrame, attributes: DataFrame, categories: dict[str, list[str]] | list[str], keep: list[str] | None = None,
                longest: int = 500) -> DataFrame:
    """Bot questions with their state, conversation attributes, rare values bucketed,
    categories one-hot, numbers as doubles, early turns only.

    ``categories`` names the columns, with their values where known; otherwise the
    values are read from the bucketed data."""
    cols = list(categories)
    q = exclude_yes_no(jnd.where(F.col("response_code").isNotNull()), "response_code", "replies")
    q = q.join(attributes.select("sender_id", *(keep or [])), "sender_id", "left")
    ts = from_epoch_s("ts")
    q = q.withColumns({"hour": F.hour(ts), "day_of_week": F.weekday(ts) + 1, "sum_answer": F.coalesce("sum_answer", F.lit(0))})
    q = q.select("sender_id", "ts", "is_answered", *cols, *(keep or []), *[F.col(n).cast("double").alias(n) for n in NUMBERS])
    q = bucket_rare(pinned(q), cols)  # read once for the shares and once for the rows
    values = categories if isinstance(categories, dict) else category_values(q, cols)
    return clean_names(one_hot(q, values).where(F.col("time_from_start") <= longest))
