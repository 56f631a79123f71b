"""Ranking and classification metrics from counts per distinct score.

Rows are reduced to one row per (group, score) before anything is ordered, so
ties cost nothing; the running totals over those rows use ``scan.ordered``,
which spreads a long score list over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scan import before, null_safe_join, ordered, position, running, top_per_key, total


def score_counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("tp"))


def _running(counts: DataFrame, score: str, by: list[str], hot_rows: int | None) -> DataFrame:
    return ordered(counts, by, [F.desc(score)], {
        "cum_n": running("n"), "cum_tp": running("tp"), "total_n": total("n"), "total_tp": total("tp")}, hot_rows)


def curve(df: DataFrame, score: str, label: str, by: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """PR and ROC points, one per distinct score, best first: recall, precision,
    tpr, fpr, with the running counts behind them."""
    by = by or []
    d = _running(score_counts(df, score, label, by), score, by, hot_rows)
    found = F.try_divide(F.col("cum_tp").cast("double"), F.col("total_tp"))
    neg = F.col("total_n") - F.col("total_tp")
    return d.withColumns({"precision": F.col("cum_tp") / F.col("cum_n"), "recall": found, "tpr": found,
                          "fpr": F.try_divide((F.col("cum_n") - F.col("cum_tp")).cast("double"), neg)})


def from_counts(counts: DataFrame, score: str, by: list[str], hot_rows: int | None = None) -> DataFrame:
    """AP and AUC from (by, score, n, tp)."""
    c = _running(counts, score, by, hot_rows)
    rank = F.col("total_n") - F.col("cum_n") + (F.col("n") + 1) / 2
    ap = F.sum(F.try_divide(F.col("tp").cast("double"), F.col("total_tp")) * (F.col("cum_tp") / F.col("cum_n")))
    n1, n0 = F.max("total_tp").cast("double"), (F.max("total_n") - F.max("total_tp")).cast("double")
    auc = F.try_divide(F.sum(F.col("tp") * rank) - n1 * (n1 + 1) / 2, n1 * n0)
    aggs = [ap.alias("ap"), auc.alias("auc"), F.max("total_n").alias("n"), F.max("total_tp").alias("positives")]
    return c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)


def ap_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Average precision and area under ROC, over all rows or per group.
    AUC is the rank sum of the positives with average ranks."""
    by = by or []
    return from_counts(score_counts(df, score, label, by), score, by, hot_rows)


def score_of_rank(counts: DataFrame, score: str) -> float | None:
    """The score down to which the N best rows reach, N being the number of true rows."""
    c = _running(counts, score, [], None)
    row = c.where(F.col("cum_n") - F.col("n") < F.col("total_tp")).agg(F.min(score)).first()
    return row[0]


def top_n_of(df: DataFrame, score: str, label: str, tiebreak: list[str], size: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The N best rows, N read from the ``positives`` of a one-row table."""
    n = size.select(F.col("positives").alias("_n"), F.lit(1).alias("_k"))
    d = ordered(df, [], [F.desc(score), *tiebreak], {"_pos": position()}, hot_rows)
    return d.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").where("_pos <= _n").drop("_k", "_n", "_pos")  # one row


def top_n(df: DataFrame, score: str, label: str, tiebreak: list[str], hot_rows: int | None = None) -> DataFrame:
    """The N best rows, N being the number of positive rows.  Rows below the score
    that N reaches are dropped before anything is ordered."""
    size = df.agg(F.sum(F.col(label).cast("long")).alias("positives"))
    cut = score_of_rank(score_counts(df, score, label, []), score)
    return top_n_of(df.where(F.col(score) >= F.lit(cut)), score, label, tiebreak, size, hot_rows)


def mean_per_group(df: DataFrame, score: str, label: str, by: list[str], tiebreak: list[str], k: int | None = None) -> DataFrame:
    """Mean over groups of AP and AUC; with ``k`` only the k best rows of each group."""
    if k:
        df = top_per_key(df, by, [F.desc(score), *tiebreak], k, "_r")
    return ap_auc(df, score, label, by).agg(F.avg("ap").alias("mean_ap"), F.avg("auc").alias("mean_auc"),
                                            F.count(F.lit(1)).alias("groups"))


def average_ranks(counts: DataFrame, value: str, n: str, by: list[str], out: str, hot_rows: int | None = None) -> DataFrame:
    """Average rank of each distinct value, from value counts."""
    d = ordered(counts, by, [value], {"_before": before(n)}, hot_rows)
    return d.withColumn(out, F.coalesce("_before", F.lit(0)) + (F.col(n) + 1) / 2).drop("_before")


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Correlation of average ranks, on counts per distinct (x, y)."""
    by = by or []
    pairs = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("n"))
    for col, out in ((x, "rx"), (y, "ry")):
        counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
        ranks = average_ranks(counts, col, "_n", by, out, hot_rows).drop("_n")
        pairs = null_safe_join(pairs, ranks, [*by, col])
    # ranks have the mean (n + 1) / 2; sums of squares around it keep their digits
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")) if by else df.agg(F.count(F.lit(1)).alias("_all"))
    pairs = null_safe_join(pairs, size, by) if by else pairs.withColumn("_k", F.lit(1)).join(F.broadcast(size.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row
    mean = (F.col("_all") + 1) / 2
    n, rx, ry = F.col("n"), F.col("rx") - mean, F.col("ry") - mean
    sums = [F.sum(n).alias("n"), F.sum(n * rx * ry).alias("sxy"), F.sum(n * rx * rx).alias("sxx"), F.sum(n * ry * ry).alias("syy")]
    s = pairs.groupBy(*by).agg(*sums) if by else pairs.agg(*sums)
    rho = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    return s.select(*by, rho.alias("rho"), "n")


def exact_quantile(df: DataFrame, col: str, q: float, out: str = "value", hot_rows: int | None = None) -> DataFrame:
    """One-row exact quantile with linear interpolation, from value counts."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    d = ordered(counts, [], [col], {"_to": running("_n"), "_all": total("_n")}, hot_rows)
    at = (F.col("_all") - 1) * q
    lo = F.min(F.when(F.col("_to") > F.floor(at), F.col(col)))
    hi = F.min(F.when(F.col("_to") > F.ceil(at), F.col(col)))
    part = F.max(at - F.floor(at))
    return d.agg((lo + (hi - lo) * part).alias(out))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted means, accuracy."""
    cells = df.groupBy(F.col(label).cast("string").alias("l"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    long = cells.select(F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    c = long.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support")), F.lit(0.0))
    c = c.withColumn("precision", precision).withColumn("recall", recall)
    c = c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    cols = ["precision", "recall", "f1"]
    macro = c.agg(F.lit("macro avg").alias("class"), *[F.avg(x).alias(x) for x in cols], F.sum("support").alias("support"))
    weighted = c.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in cols], F.sum("support").alias("support"))
    accuracy = c.agg(F.lit("accuracy").alias("class"), *[(F.sum("hit") / F.sum("support")).alias(x) for x in cols], F.sum("support").alias("support"))
    return c.select("class", *cols, "support").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def chi_square(df: DataFrame, cols: list[str], target: str, yates: bool = True) -> DataFrame:
    """Chi-square statistic of each column against the target, from one pass of
    contingency counts; 2x2 tables get the continuity correction if ``yates``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x"),
                     F.col(target).alias("t"))
    cells = long.where(F.col("x.value").isNotNull() & F.col("t").isNotNull()).groupBy("x.column", "x.value", "t").agg(F.count(F.lit(1)).alias("o"))
    by_row = cells.groupBy("column", "value").agg(F.sum("o").alias("row_n"))
    by_col = cells.groupBy("column", "t").agg(F.sum("o").alias("col_n"))
    size = by_row.groupBy("column").agg(F.sum("row_n").alias("all_n"), F.count(F.lit(1)).alias("n_rows"))
    width = by_col.groupBy("column").agg(F.count(F.lit(1)).alias("n_cols"))
    # every cell of the table, missing ones as 0: values x classes of the target
    grid = by_row.join(by_col, "column").join(size, "column").join(width, "column").join(cells, ["column", "value", "t"], "left")
    e = F.col("row_n") * F.col("col_n") / F.col("all_n")
    gap = F.abs(F.coalesce("o", F.lit(0)) - e)
    small = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    d = F.when(small & F.lit(yates), F.greatest(gap - 0.5, F.lit(0.0))).otherwise(gap)
    return grid.groupBy("column").agg(F.sum(d * d / e).alias("chi2"), F.max((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("dof"))


def weighted_accuracy(df: DataFrame, hit: Column, loss: Column, weight: str, by: list[str]) -> DataFrame:
    w = F.col(weight).cast("double")
    aggs = [F.try_divide(F.sum(w * hit.cast("double")), F.sum(w)).alias("accuracy"), F.try_divide(F.sum(w * loss), F.sum(w)).alias("loss")]
    return df.groupBy(*by).agg(*aggs)
