"""Association rules per group, mined level by level for all groups at once.

Sets of k+1 items are grown inside the baskets from the frequent sets of k items that a
basket holds, counted by (group, set), and pruned by the group's support; a basket carries
only its own frequent sets to the next level.  Left sides are kept maximal through an index
from a rule's rarest item to the rules that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.scan import null_safe_join
from parlance.session import pinned, release


def _grown(sets: str, items: str) -> Column:
    """Sorted sets with one more item, all of whose subsets of the old size are in ``sets``."""
    def more(s: Column) -> Column:
        return F.transform(F.filter(items, lambda x: x > F.element_at(s, -1)), lambda x: F.array_append(s, x))

    def closed(c: Column) -> Column:
        return F.forall(c, lambda x: F.array_contains(F.col(sets), F.array_remove(c, x)))

    return F.filter(F.flatten(F.transform(sets, more)), closed)


def frequent_sets(baskets: DataFrame, keys: list[str], items: str, target: str, support: float, longest: int, count: str | None = None) -> DataFrame:
    """Sets of up to ``longest`` items that occur together with the target in at least
    ``support`` of a group's baskets: (keys, items, size, n, hits, total); ``n`` counts the
    baskets with the set, ``hits`` those that also have the ``target`` flag, ``total`` all.

    A null item is no item; an item repeated in a basket counts once; a basket without
    items still counts in ``total``.  Equal baskets of a group are kept once with their
    number; a row stands for as many baskets as its ``count`` column says (1 if None)."""
    times = F.col(count) if count else F.lit(1)
    b = baskets.select(*keys, times.alias("_n"), F.when(F.col(target).cast("boolean"), times).otherwise(0).alias("_h"), F.array_sort(F.array_distinct(F.array_compact(items))).alias("_items"))
    b = b.groupBy(*keys, "_items").agg(F.sum("_n").alias("_n"), F.sum("_h").alias("_h"))
    b = pinned(b.withColumn("_b", F.monotonically_increasing_id()))
    total = pinned(b.groupBy(*keys).agg(F.sum("_n").alias("total")))
    counts = [F.sum("_n").alias("n"), F.sum("_h").alias("hits")]
    held, out = b.withColumn("_sets", F.transform("_items", lambda x: F.array(x))), None
    for size in range(1, longest + 1):
        occur = held.select(*keys, "_b", "_n", "_h", F.explode("_sets").alias("items"))
        found = null_safe_join(occur.groupBy(*keys, "items").agg(*counts), total, keys)
        # the least count is a whole number, so that 0.01 * 300 does not become 3.0000000000000004
        found = pinned(found.where(F.col("hits") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("total") * support, 9)))).withColumn("size", F.lit(size)))
        out = found if out is None else out.unionByName(found)
        if size == longest or found.isEmpty():
            return out
        own = null_safe_join(occur, found.select(*keys, "items"), [*keys, "items"], "left_semi").groupBy("_b").agg(F.collect_list("items").alias("_sets"))
        d = b.join(own, "_b")
        if size == 1:  # items that are not frequent alone are in no larger set
            d = d.withColumn("_items", F.array_sort(F.flatten("_sets")))
            b = pinned(d.drop("_sets"))
            d = b.withColumn("_sets", F.transform("_items", lambda x: F.array(x)))
        step = pinned(d.withColumn("_sets", _grown("_sets", "_items")).where(F.size("_sets") > 0))
        if size > 1:
            release(held)
        held = step
    return out


def maximal(rules: DataFrame, keys: list[str], left: str) -> DataFrame:
    """Rules whose left side is not part of another rule's within the same keys.  A rule is
    looked up under its rarest item only, among the larger rules that hold it."""
    r = pinned(rules.withColumn("_r", F.monotonically_increasing_id()))
    postings = r.select(*keys, "_r", F.col(left).alias("_l"), F.explode(F.array_distinct(left)).alias("_i"))
    seen = postings.groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("_n"))
    rare = null_safe_join(postings, seen, [*keys, "_i"]).groupBy("_r").agg(F.min(F.struct("_n", "_i"))["_i"].alias("_i"))
    asked = r.join(rare, "_r").select(*keys, "_i", F.col("_r").alias("_small"), F.col(left).alias("_s"))
    inside = null_safe_join(asked, postings, [*keys, "_i"]).where((F.size("_l") > F.size("_s")) & (F.size(F.array_except("_s", "_l")) == 0))
    return r.join(inside.select(F.col("_small").alias("_r")).distinct(), "_r", "left_anti").drop("_r")


def grouped_rules(baskets: DataFrame, keys: list[str], items: str, target: str, support: float = 0.01, confidence: float = 0.8,
                  shortest: int = 2, longest: int = 8, only_maximal: bool = True, count: str | None = None) -> DataFrame:
    """Rules with the target on the right, for every group: (keys, antecedent, n, hits,
    confidence, lift).  ``items`` must not hold the target; a rule has ``shortest`` to
    ``longest`` items with it.  ``count`` as in ``frequent_sets``.  A group without a frequent set, or an empty table, gives no
    rules."""
    sets = frequent_sets(baskets, keys, items, target, support, longest - 1, count)
    times = F.col(count) if count else F.lit(1)
    base = baskets.groupBy(*keys).agg(F.sum(F.when(F.col(target).cast("boolean"), times).otherwise(0)).alias("_hits"), F.sum(times).alias("_all"))
    r = sets.where((F.col("size") + 1 >= shortest) & (F.col("hits") / F.col("n") >= confidence))
    r = null_safe_join(r, base, keys).withColumns({"confidence": F.col("hits") / F.col("n"), "lift": F.col("hits") * F.col("_all") / (F.col("n") * F.col("_hits"))})
    r = r.select(*keys, F.col("items").alias("antecedent"), "n", "hits", "confidence", "lift")
    return maximal(r, keys, "antecedent") if only_maximal else r
