"""Ordered (windowed) features that survive a hot key.

A Spark window sends all rows of one partition key to one task.  That is the
right plan while every key is small, but one sender may hold a third of the
table.  ``ordered`` therefore counts rows per key first:

* no key above ``hot_rows``: plain windows over one shared window spec, so all
  features cost a single shuffle and sort;
* otherwise the rows of hot keys are range-partitioned on (key, order), given
  exact positions, cut into equal position blocks with a halo of neighbour rows
  for lag / lead, and the running values of earlier blocks are carried in from
  a small per-block table.  The results are the same as the plain windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import pinned

HOT_ROWS = 1_000_000  # rows of one key that one task may hold


@dataclass(frozen=True)
class Feature:
    kind: str
    expr: Column
    n: int = 1
    fn: str = "sum"


Steps = list["dict[str, Feature] | Callable[[DataFrame], DataFrame]"]


def _c(e: Column | str) -> Column:
    return F.col(e) if isinstance(e, str) else e


def lag(e, n: int = 1) -> Feature:
    return Feature("lag", _c(e), n)


def lead(e, n: int = 1) -> Feature:
    return Feature("lead", _c(e), n)


def running(e, fn: str = "sum") -> Feature:
    """sum / min / max / count from the first row to this one."""
    return Feature("running", _c(e), fn=fn)


def before(e, fn: str = "sum") -> Feature:
    """As ``running`` but without this row."""
    return Feature("before", _c(e), fn=fn)


def last_known(e) -> Feature:
    return Feature("running", _c(e), fn="last")


def last_known_before(e) -> Feature:
    return Feature("before", _c(e), fn="last")


def last_n_known_before(exprs: dict[str, Column], n: int) -> Steps:
    """Steps that give, for each name, the last ``n`` known values before the row, oldest
    first, as an array (null if there is none).  The state of a step is an array of at
    most ``n`` values: the one of the step before at the last known row, and that row's
    value.  All names share each step's window."""
    name = lambda k, j: k if j == n else f"_last{j}_{k}"
    steps: Steps = []
    for j in range(1, n + 1):
        grown = {k: F.array(e) if j == 1 else F.concat(F.coalesce(F.col(name(k, j - 1)), F.slice(F.array(e), 1, 0)), F.array(e)) for k, e in exprs.items()}
        steps.append({name(k, j): last_known_before(F.when(e.isNotNull(), grown[k])) for k, e in exprs.items()})
    return [*steps, lambda df: df.drop(*[name(k, j) for k in exprs for j in range(1, n)])]


def position() -> Feature:
    return Feature("position", F.lit(1))


def total(e, fn: str = "sum") -> Feature:
    """Whole-key aggregate on every row."""
    return Feature("total", _c(e), fn=fn)


_AGG = {
    "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where a null key equals a null key; key columns come from the left."""
    if not cols:
        raise ValueError("join columns needed")
    tmp = {c: f"_scan_r_{c}" for c in cols}
    right = right.withColumnsRenamed(tmp)
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[tmp[c]]) for c in cols])
    return left.join(right, cond, how).drop(*tmp.values())


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and their counts: never more than
    rows / hot_rows of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_scan_n")).where(F.col("_scan_n") > hot_rows)


@dataclass(frozen=True)
class Skew:
    """The hot keys of a table, found once and passed to several ``ordered`` calls
    on the same keys; ``total`` counts their rows."""
    keys: DataFrame | None
    rows: int
    total: int = 0


def find_skew(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> Skew:
    limit = HOT_ROWS if hot_rows is None else hot_rows
    hot = hot_keys(df, keys, limit)
    n = hot.agg(F.sum("_scan_n")).first()[0]
    # at most rows / limit keys: written once, since several joins read them
    return Skew(None if n is None else pinned(hot.drop("_scan_n")), limit, n or 0)


def ordered(df: DataFrame, keys: list[str], order: list, features: dict[str, Feature] | Steps,
            hot_rows: int | None = None, skew: Skew | None = None) -> DataFrame:
    """Add ordered features per key.  ``order`` must be unique within a key.

    ``features`` may be a list of steps: feature dicts, and functions that derive
    columns from the features so far without adding or dropping rows.  Hot rows are
    then set apart and numbered once for all steps."""
    order = [_c(o) for o in order]
    steps = features if isinstance(features, list) else [features]
    if not keys:
        df, keys = df.withColumn("_scan_all", F.lit(0)), ["_scan_all"]
        return ordered(df, keys, order, steps, hot_rows).drop("_scan_all")
    skew = skew or find_skew(df, keys, hot_rows)
    cold = df if skew.keys is None else null_safe_join(df, skew.keys, keys, "left_anti")
    for s in steps:
        cold = s(cold) if callable(s) else _plain(cold, keys, order, s)
    if skew.keys is None:
        return cold
    hot = _positions(null_safe_join(df, skew.keys, keys, "left_semi"), keys, order, skew.rows, skew.total)
    for s in steps:
        hot = s(hot) if callable(s) else _blocked(hot, keys, s, skew.rows)
    return cold.unionByName(hot.drop("_scan_pos"))


def _plain(df, keys, order, features):
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    out = {}
    for name, f in features.items():
        match f.kind:
            case "lag":
                out[name] = F.lag(f.expr, f.n).over(w)
            case "lead":
                out[name] = F.lead(f.expr, f.n).over(w)
            case "running":
                out[name] = _AGG[f.fn](f.expr).over(upto)
            case "before":
                out[name] = _AGG[f.fn](f.expr).over(prior)
            case "position":
                out[name] = F.row_number().over(w).cast("long")
            case "total":
                out[name] = _AGG[f.fn](f.expr).over(whole)
    return df.withColumns(out)


def _positions(df, keys, order, block_rows, total_rows):
    """Exact 0-based position per key in ``_scan_pos``, without one task per key."""
    parts = max(2, 2 * total_rows // max(block_rows, 1) + 1, df.sparkSession.sparkContext.defaultParallelism)
    # the block of a row depends on sampled range bounds, so it is written down once
    ranged = pinned(df.repartitionByRange(int(parts), *[F.col(k) for k in keys], *order)
                    .withColumn("_scan_block", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_scan_block").agg(F.count(F.lit(1)).alias("_scan_n"))
    w = Window.partitionBy(*keys).orderBy("_scan_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_scan_block", F.coalesce(F.sum("_scan_n").over(w), F.lit(0)).alias("_scan_off"))
    local = Window.partitionBy(*keys, "_scan_block").orderBy(*order)
    return pinned(null_safe_join(ranged, offsets, [*keys, "_scan_block"])
                  .withColumn("_scan_pos", F.col("_scan_off") + F.row_number().over(local) - 1)
                  .drop("_scan_off", "_scan_block"))


def _merge(fn: str, carry: Column, local: Column) -> Column:
    if fn in ("sum", "count"):
        both = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        return both if fn == "count" else F.when(carry.isNotNull() | local.isNotNull(), both)
    if fn == "last":
        return F.coalesce(local, carry)
    return (F.least if fn == "min" else F.greatest)(carry, local)


def _blocked(rows, keys, features, block_rows):
    """Features of positioned rows; ``_scan_pos`` stays for the next step."""
    cols = rows.columns
    halo = max([f.n for f in features.values() if f.kind in ("lag", "lead")], default=0)
    # blocks well below the limit, so that a few hot keys still use many tasks
    size = max(block_rows // 8, halo + 1)
    rows = rows.withColumn("_scan_home", F.floor(F.col("_scan_pos") / size))

    # per-block summaries, one row per (key, block)
    aggs, carried = [], {}
    for name, f in features.items():
        if f.kind in ("running", "before"):
            if f.fn == "last":
                aggs.append(F.max_by(f.expr, F.when(f.expr.isNotNull(), F.col("_scan_pos"))).alias(f"_scan_c_{name}"))
            else:
                aggs.append(_AGG[f.fn](f.expr).alias(f"_scan_c_{name}"))
            carried[name] = "sum" if f.fn == "count" else f.fn
        elif f.kind == "total":
            if f.fn == "avg":
                aggs += [F.sum(f.expr).alias(f"_scan_s_{name}"), F.count(f.expr).alias(f"_scan_n_{name}")]
            else:
                aggs.append(_AGG[f.fn](f.expr).alias(f"_scan_c_{name}"))
    # positions are needed by max_by, so the summary reads the positioned rows
    aggs = aggs or [F.count(F.lit(1)).alias("_scan_n")]
    blocks = rows.groupBy(*keys, "_scan_home").agg(*aggs)
    prior = Window.partitionBy(*keys).orderBy("_scan_home").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sel = [*keys, "_scan_home"]
    for name, f in features.items():
        if name in carried:
            sel.append(_AGG[carried[name]](F.col(f"_scan_c_{name}")).over(prior).alias(f"_scan_p_{name}"))
        elif f.kind == "total" and f.fn == "avg":
            sel.append(F.try_divide(F.sum(f"_scan_s_{name}").over(whole), F.sum(f"_scan_n_{name}").over(whole)).alias(name))
        elif f.kind == "total":
            fn = "sum" if f.fn == "count" else f.fn
            sel.append(_AGG[fn](F.col(f"_scan_c_{name}")).over(whole).alias(name))
    carry = blocks.select(*sel)

    at = F.col("_scan_pos") % size
    copies = [F.col("_scan_home")]
    if halo:
        copies += [F.when(at < halo, F.col("_scan_home") - 1), F.when(at >= size - halo, F.col("_scan_home") + 1)]
    rows = rows.withColumn("_scan_in", F.explode(F.array_compact(F.array(*copies))))
    own = F.col("_scan_in") == F.col("_scan_home")
    w = Window.partitionBy(*keys, "_scan_in").orderBy("_scan_pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    behind = w.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for name, f in features.items():
        if f.kind == "lag":
            out[name] = F.lag(f.expr, f.n).over(w)
        elif f.kind == "lead":
            out[name] = F.lead(f.expr, f.n).over(w)
        elif f.kind == "position":
            out[name] = F.col("_scan_pos") + 1
        elif f.kind in ("running", "before"):
            out[name] = _AGG[f.fn](F.when(own, f.expr)).over(upto if f.kind == "running" else behind)
    done = null_safe_join(rows.withColumns(out).where(own), carry, [*keys, "_scan_home"])
    return done.select(*cols, *[
        (_merge(f.fn, F.col(f"_scan_p_{n}"), F.col(n)) if n in carried else F.col(n)).alias(n)
        for n, f in features.items()])


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key.  The rank filter reaches the map side
    (WindowGroupLimit), so at most k rows per key and task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*[_c(o) for o in order])
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
