"""Column expressions: projections, recodes and predicates.  All stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(e: Column | str) -> Column:
    return F.col(e) if isinstance(e, str) else e


# --- time ---------------------------------------------------------------

def from_epoch_s(e) -> Column:
    return F.timestamp_seconds(_c(e).cast("long"))


def from_epoch_ms(e) -> Column:
    return F.timestamp_millis(_c(e).cast("long"))


def epoch_s(ts) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def epoch_us(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def calendar(ts) -> dict[str, Column]:
    ts = _c(ts)
    return {"year": F.year(ts), "month": F.month(ts), "day_of_week": F.dayofweek(ts), "hour": F.hour(ts),
            "day_name": F.date_format(ts, "E"),
            "year_month": F.concat_ws("_", F.year(ts), F.month(ts))}


def calendar_text(e) -> dict[str, Column]:
    """Calendar parts of a text date; unreadable dates give null."""
    e = _c(e)
    ts = F.try_to_timestamp(e, F.lit("yyyy-MM-dd HH:mm:ss"))
    ok = ts.isNotNull()
    return {"year": F.when(ok, F.substring(e, 1, 4)), "month": F.when(ok, F.substring(e, 6, 2)),
            "weekday": F.date_format(ts, "EEEE"), "hour": F.hour(ts)}


def iso_weekday(ts) -> Column:
    return (F.weekday(_c(ts)) + 1).cast("string")


# --- nested values --------------------------------------------------------

def second_elements(a) -> Column:
    return F.transform(_c(a), lambda x: F.get(x, F.lit(1)))


def array_length(a) -> Column:
    return F.size(_c(a))


def is_array(a) -> Column:
    return _c(a).isNotNull()


def keep_scored(a, least: int = 100) -> Column:
    return F.filter(_c(a), lambda x: x["score"] >= least)


def first_sorted(a) -> Column:
    """Element 0 after sorting, so the choice does not hang on storage order."""
    return F.get(F.array_sort(_c(a)), F.lit(0))


def shares_of(a, total) -> Column:
    return F.transform(_c(a), lambda x: F.try_divide(x.cast("double"), _c(total)))


def pad_array(a, n: int, filler: str = "*") -> Column:
    return F.slice(F.concat(_c(a), F.array_repeat(F.lit(filler), n)), 1, n)


def unique_sorted(a, extract=None) -> Column:
    a = F.transform(_c(a), extract) if extract else _c(a)
    return F.array_sort(F.array_distinct(a))


def count_values(a, filler: str = "*") -> Column:
    return F.size(F.filter(_c(a), lambda x: x != filler))


def has_values(a, filler: str = "*") -> Column:
    return F.exists(_c(a), lambda x: x != filler)


def count_actions(a, action: str) -> Column:
    return F.size(F.filter(_c(a), lambda x: x == action))


def combine_codes(a) -> tuple[Column, Column]:
    """Sorted names scored 100 and their ``_`` join; null where there is none."""
    names = F.array_sort(F.transform(F.filter(_c(a), lambda x: x["score"] == 100), lambda x: x["name"]))
    return F.when(F.size(names) > 0, names), F.when(F.size(names) > 0, F.array_join(names, "_"))


def resolve_word(word: Column) -> Column:
    """Main synonym, or the lemma where it is missing or empty; lower case."""
    return F.lower(F.coalesce(F.nullif(word["main_synonym"], F.lit("")), word["lemma"]))


def resolve_aspect(words) -> Column:
    return F.transform(_c(words), resolve_word)


# fixed values: colour group names
COLOR_GROUPS = ["metallic", "pale", "neon", "bright", "washed", "pattern", "dark", "gradient",
                "neutral color", "warm color", "cool color"]


def resolve_colours(words, colour_names: list[str]) -> tuple[Column, Column]:
    """Known colours (own name or contained group) and colour groups of the words."""
    names = F.array(*[F.lit(c) for c in colour_names])
    groups = F.array(*[F.lit(c) for c in COLOR_GROUPS])
    contained = F.flatten(F.transform(_c(words), lambda w: F.coalesce(w["contained_groups"], F.array().cast("array<string>"))))
    own = F.transform(_c(words), lambda w: F.coalesce(F.nullif(w["main_synonym"], F.lit("")), F.lower(w["lemma"])))
    return (F.array_union(F.array_intersect(own, names), F.array_intersect(contained, names)),
            F.array_intersect(contained, groups))


def item_tokens(fields: dict[str, Column], sep: str) -> Column:
    """Distinct ``key<sep>value`` tokens; a field may be a string or an array."""
    def tokens(key: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.concat(F.lit(key + sep), x))

    return F.array_distinct(F.concat(*[tokens(k, v) for k, v in fields.items()]))


# --- recodes ------------------------------------------------------------

def resolve_identity(ga, sender) -> Column:
    """The web id unless it is missing or at most 5 characters."""
    return F.when(F.length(_c(ga)) > 5, _c(ga)).otherwise(_c(sender).cast("string"))


def null_sentinel(e, to: str = "double") -> Column:
    """Text ``NULL`` or an unreadable number becomes 0."""
    return F.coalesce(F.nullif(_c(e), F.lit("NULL")).try_cast(to), F.lit(0).cast(to))


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def label_missing(e, missing: str = "no_answer", empty: str = "empty") -> Column:
    e = _c(e)
    return F.when(e.isNull(), missing).when(e == "", empty).otherwise(e)


def bind_categories(e, keep: list[str], other: str = "other") -> Column:
    return F.when(_c(e).isin(keep), _c(e)).otherwise(other)


def cut(e, edges: list[float], labels: list[str] | None = None) -> Column:
    """Left-closed bins; the last edge opens to infinity."""
    e = _c(e)
    out = None
    for i, lo in enumerate(edges):
        hi = edges[i + 1] if i + 1 < len(edges) else None
        label = labels[i] if labels else f"[{lo},{hi if hi is not None else 'inf'})"
        cond = (e >= lo) & (e < hi) if hi is not None else e >= lo
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def equal_bins(e, low: float, high: float, bins: int) -> Column:
    return F.width_bucket(_c(e).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))


def any_flag(cols: list[str]) -> Column:
    return reduce(or_, [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in cols])


# fixed values: aspects that never enter the rule data
SKIPPED_ASPECTS = ["size", "weather", "price", "body type"]


def skipped_aspect(e) -> Column:
    return _c(e).rlike("|".join(SKIPPED_ASPECTS))


# --- frames ---------------------------------------------------------------

def bind(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are computed once per row.  A plain projection may be merged
    into the next one, and an expression used inside a lambda is then evaluated for
    every element; the generator keeps the two apart."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def clean_names(df: DataFrame, bad: str = "[]<") -> DataFrame:
    table = str.maketrans({ch: "_" for ch in bad})
    return df.toDF(*[c.translate(table) for c in df.columns])


def json_to_columns(df: DataFrame, col: str, schema: str, prefix: str = "") -> DataFrame:
    rest = [c for c in df.columns if c != col]
    parsed = df.withColumn(col, F.from_json(col, schema))
    fields = parsed.schema[col].dataType.fieldNames()
    return parsed.select(*rest, *[F.col(f"{col}.{f}").alias(prefix + f) for f in fields])


def rescale(df: DataFrame, col: str, out: str) -> DataFrame:
    """Linear map of min..max to -1..1 over the whole table: one aggregate row, joined back."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).withColumn("_k", F.lit(1))
    value = F.lit(-1) + F.lit(2) * F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return (df.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k")  # one row
            .withColumn(out, value).drop("_k", "_lo", "_hi"))


def since(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Range predicate on the stored column, so it reaches the scan."""
    kind = df.schema[ts].dataType.typeName()
    return df.where(F.col(ts) >= F.lit(day).cast("timestamp_ntz" if kind == "timestamp_ntz" else "timestamp"))


def top_shares(df: DataFrame, cols: list[str], top: int = 40) -> DataFrame:
    """The ``top`` values by count of every listed column, in one job:
    (column, value, n, share, rank).  Null is counted as a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    n = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    # rows per column = the sum of its counts; one row per listed column
    size = n.groupBy("column").agg(F.sum("n").alias("_size"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return (n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .join(F.broadcast(size), "column")  # at most len(cols) rows
            .withColumn("share", F.col("n") / F.col("_size")).drop("_size"))


def bucket_rare(df: DataFrame, cols: list[str], least: float = 0.005, top: int = 40) -> DataFrame:
    """Values outside the frequent ones, and nulls, become ``other``."""
    from parlance.session import pinned
    # at most ``top`` rows a column, read once for each
    keep = pinned(top_shares(df, cols, top).where((F.col("share") >= least) & F.col("value").isNotNull()))
    for c in cols:
        names = keep.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"))
        df = (df.join(F.broadcast(names), F.col(c).cast("string") == F.col(f"_v_{c}"), "left")  # at most ``top`` rows
              .withColumn(c, F.coalesce(F.col(f"_v_{c}"), F.lit("other"))).drop(f"_v_{c}"))
    return df


def drop_zero_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the listed numeric columns that are 0 or null in every row: one aggregate row."""
    seen = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if not seen[c]])
