"""Keep or drop rows of a table by marks made elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import pinned


def text_key(text: Column) -> Column:
    """Tells the texts of rows with one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose mark (``_id, _key, _keep``) says so, with all their columns;
    rows with one id and one text leave one row."""
    on = lambda t: F.col(id_col).eqNullSafe(t["_id"]) & (text_key(F.col(text_col)) == t["_key"])
    marks = pinned(marks)
    drop = marks.where(~F.col("_keep")).select("_id", "_key").distinct()
    out = docs.join(drop, on(drop), "left_anti")
    again = pinned(marks.where("_keep").groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    if again.isEmpty():
        return out
    copies = out.join(again, on(again), "left_semi").withColumn("_row_key_", text_key(F.col(text_col))).dropDuplicates([id_col, "_row_key_"]).drop("_row_key_")
    return out.join(again, on(again), "left_anti").unionByName(copies)
