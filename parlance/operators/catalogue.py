"""Product catalogue: lookups, code counts, rule data and feature effects.

A product has arrays of codes and occasions; those arrays hold distinct entries,
so their size is bounded by the vocabulary however often an entry is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.expr import item_tokens, keep_scored, skipped_aspect
from parlance.functions.scan import ordered, running, top_per_key
from parlance.session import pinned

GROUP = ["parent_type", "gender", "dress_code"]


# --- documents --------------------------------------------------------------

def products_with_codes(codes: DataFrame, out: str = "dress_codes") -> DataFrame:
    return codes.groupBy("product_id").agg(
        F.array_sort(F.collect_set(F.struct(F.col("code").alias("name"), "score"))).alias(out))


def lookup_array(left: DataFrame, right: DataFrame, on: str, fields: list[str], out: str) -> DataFrame:
    """All distinct matches of the right table as an array; empty where there is none.
    The right side is aggregated first, so the join adds no rows."""
    side = right.groupBy(on).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias(out))
    empty = F.array().cast(side.schema[out].dataType)
    return left.join(side, on, "left").withColumn(out, F.coalesce(out, empty))


def product_documents(products: DataFrame, codes: DataFrame, occasions: DataFrame) -> DataFrame:
    d = lookup_array(products, codes.withColumnRenamed("code", "name"), "product_id", ["name", "score"], "dress_codes")
    return lookup_array(d, occasions.withColumnRenamed("occasion", "name"), "product_id", ["name", "score"], "occasions")


def exactly_one(df: DataFrame, col: str, score: int = 100) -> DataFrame:
    return df.where((F.size(col) == 1) & (F.get(F.col(col), F.lit(0))["score"] == score))


# --- lookups ------------------------------------------------------------------

def parent_types(products: DataFrame, types: DataFrame, types_uk: DataFrame) -> DataFrame:
    """Parent type from the first lookup, else from the second; null if in neither."""
    one = types.groupBy(F.col("name").alias("product_type")).agg(F.min("direct_parent").alias("_a"))
    two = types_uk.groupBy(F.col("name").alias("product_type")).agg(F.min("direct_parent").alias("_b"))
    return (products.join(one, "product_type", "left").join(two, "product_type", "left")
            .withColumn("parent_type", F.coalesce("_a", "_b")).drop("_a", "_b"))


def missing_in_both(products: DataFrame, types: DataFrame, types_uk: DataFrame) -> DataFrame:
    for side in (types, types_uk):
        products = products.join(side.select(F.col("name").alias("product_type")), "product_type", "left_anti")
    return products


def code_tags(synonyms: DataFrame) -> DataFrame:
    """One row per code with the array of its synonyms."""
    return synonyms.groupBy(F.col("code").alias("dress_code")).agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))


def main_codes(df: DataFrame, tags: DataFrame, col: str, keep_unknown: bool = True) -> DataFrame:
    """Replace a code by the one that lists it among its synonyms."""
    flat = (tags.select(F.col("dress_code").alias("_m"), F.explode("synonyms").alias(col))
            .groupBy(col).agg(F.min("_m").alias("_main")))
    out = df.join(flat, col, "left")
    return out.withColumn(col, F.coalesce("_main", col) if keep_unknown else F.col("_main")).drop("_main")


def occasion_of(df: DataFrame, occasion_codes: DataFrame, code: str) -> DataFrame:
    """Smallest occasion that lists the code."""
    side = occasion_codes.groupBy(F.col("code").alias(code)).agg(F.min("occasion").alias("occasion"))
    return df.join(side, code, "left")


def mapped_from_occasion(products: DataFrame, occasion_codes: DataFrame) -> DataFrame:
    """Products without a scored code but with one occasion take the occasion's only code."""
    single = (occasion_codes.groupBy("occasion").agg(F.count(F.lit(1)).alias("_n"), F.min("code").alias("mapped_code"))
              .where(F.col("_n") == 1).drop("_n"))
    bare = products.where((F.size(keep_scored("dress_codes")) == 0) & (F.size("occasions") == 1))
    return bare.withColumn("occasion", F.get(F.col("occasions"), F.lit(0))["name"]).join(single, "occasion")


def add_mapped(products: DataFrame, mapped: DataFrame, code: str = "festive") -> DataFrame:
    """Products mapped to ``code`` get it appended and join the coded products."""
    extra = F.array(F.struct(F.lit(code).alias("name"), F.lit(100).alias("score")))
    extra_rows = mapped.where(F.col("mapped_code") == code).withColumn(
        "dress_codes", F.concat(keep_scored("dress_codes"), extra))
    return exactly_one(products, "dress_codes").unionByName(extra_rows.select(*products.columns))


# --- counts ------------------------------------------------------------------

def codes_per_group(df: DataFrame, keys: list[str], code: str, sample: str | None = None) -> DataFrame:
    """Counts per code, then codes, counts, total and shares as arrays per group."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.max(sample).alias("sample")] if sample else [])
    one = df.groupBy(*keys, code).agg(*aggs)
    fields = [F.col(code).alias("code"), "n"] + (["sample"] if sample else [])
    g = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_l"), F.sum("n").alias("total"))
    out = [F.col("_l.code").alias("codes"), F.col("_l.n").alias("counts"), "total",
           F.transform("_l", lambda x: x["n"] / F.col("total")).alias("shares")]
    return g.select(*keys, *out, *([F.col("_l.sample").alias("samples")] if sample else []))


def set_key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count per sorted set of scored codes."""
    codes = F.array_sort(F.transform(keep_scored("dress_codes"), lambda x: x["name"]))
    d = df.withColumn("codes", F.array_join(codes, ",")).where(F.size(keep_scored("dress_codes")) > 0)
    return d.groupBy("codes", *keys).agg(F.count(F.lit(1)).alias("n"))


def before_after(before: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    j = before.withColumnRenamed("n", "before").join(added.withColumnRenamed("n", "added"), keys, "full")
    b, a = F.coalesce("before", F.lit(0)), F.coalesce("added", F.lit(0))
    return j.select(*keys, b.alias("before"), a.alias("added"), (b + a).alias("after"))


# --- item documents and rules ---------------------------------------------------

def item_docs(items: DataFrame) -> DataFrame:
    return items.groupBy("basket_id").agg(F.array_join(F.array_sort(F.collect_set("item")), " ").alias("doc"))


def parse_docs(docs: DataFrame, key: str, doc: str, ignore: list[str]) -> DataFrame:
    """(key, aspect, val): the first value of every aspect, ``Unknown`` where absent.
    The list of aspects is one row, attached to every document."""
    tokens = docs.select(key, F.filter(F.split(doc, " "), lambda x: F.contains(x, F.lit("-"))).alias("_t"))
    aspects = (tokens.select(F.explode("_t").alias("x")).select(F.split_part("x", F.lit("-"), F.lit(1)).alias("aspect"))
               .where(~F.col("aspect").isin(ignore)).distinct()
               .agg(F.array_sort(F.collect_set("aspect")).alias("_a")).withColumn("_k", F.lit(1)))
    grid = (tokens.withColumn("_k", F.lit(1)).join(F.broadcast(aspects), "_k")  # one row
            .select(key, "_t", F.explode("_a").alias("aspect")))
    first = F.get(F.filter("_t", lambda x: F.startswith(x, F.concat("aspect", F.lit("-")))), F.lit(0))
    return grid.select(key, "aspect", F.coalesce(F.substring(first, F.length("aspect") + 2, F.length(first)), F.lit("Unknown")).alias("val"))


def readable_rules(rules: DataFrame, conditions: str) -> DataFrame:
    """Tree conditions as readable terms: ``x-y<..`` reads "x not y", ``x-y>=..`` reads
    "x y"; product types come first by value only; negatives last; a rule without a
    positive term is dropped."""
    def term(c: Column) -> Column:
        feature = F.regexp_extract(c, r"^([^<>]*)(<|>=)", 1)
        negative = F.contains(c, F.lit("<"))
        kind = F.split_part(feature, F.lit("-"), F.lit(1))
        value = F.replace(F.substring(feature, F.length(kind) + 2, F.length(feature)), F.lit("_"), F.lit(" "))
        is_type = F.contains(kind, F.lit("product_type"))
        text = F.concat(F.when(is_type, "").otherwise(F.concat(kind, F.lit(" "))), F.when(negative, "not ").otherwise(""), value)
        return F.struct(text.alias("text"), negative.alias("negative"), is_type.alias("is_type"))

    terms = F.filter(F.transform(conditions, term), lambda x: F.length(x["text"]) > 0)
    d = rules.withColumn("_t", terms)
    types = F.filter("_t", lambda x: x["is_type"] & ~x["negative"])
    pos = F.filter("_t", lambda x: ~x["is_type"] & ~x["negative"])
    neg = F.filter("_t", lambda x: ~x["is_type"] & x["negative"])
    text = F.transform(F.concat(types, pos, neg), lambda x: x["text"])
    return d.where(F.size(F.concat(types, pos)) > 0).withColumn("rule", F.array_join(text, ",")).drop("_t")


def parse_rule_lines(lines: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rules of a tree's rule text, a line per row: (keys, rule_no, label, cover, prob,
    conditions).  A rule begins with a line that holds ``Rule`` and, in brackets,
    ``class=``, ``cover=`` and ``prob=``; the lines after it are its conditions
    (``feature< x``, ``feature>=x``), other lines are passed over.  Lines before the first
    rule are no rule's.  The lines of a key may be many; a rule is short."""
    text = F.trim(value)
    head = F.contains(text, F.lit("Rule"))
    d = ordered(lines, keys, [order], {"rule_no": running(F.when(head, 1).otherwise(0))})
    d = d.where((F.col("rule_no") > 0) & (head | text.rlike(r"^[^<>]+(<|>=)")))
    field = lambda name, shape: F.nullif(F.regexp_extract(text, rf"\b{name}=({shape})", 1), F.lit(""))
    of_head = lambda c: F.max(F.when(head, c))
    lists = F.array_sort(F.collect_list(F.when(~head, F.struct(F.col(order).alias("at"), text.alias("c")))))
    g = d.groupBy(*keys, "rule_no").agg(of_head(field("class", "[0-9]+")).cast("int").alias("label"), of_head(field("cover", "[0-9]+")).cast("long").alias("cover"),
                                        of_head(field("prob", "[0-9.]+")).alias("prob"), F.transform(lists, lambda x: x["c"]).alias("conditions"))
    return g.select(*keys, "rule_no", "label", "cover", "prob", "conditions")


def group_name_parts(path: Column) -> dict[str, Column]:
    """``type#gender#dress_code_x.csv`` to its three parts."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.csv$", ""), "#")
    return {"type": F.get(parts, F.lit(0)), "gender": F.get(parts, F.lit(1)),
            "dress_code": F.regexp_replace(F.get(parts, F.lit(2)), "^dress_code_", "")}


# --- rule data: positives and negatives per group -------------------------------

def coded_rows(products: DataFrame, types: DataFrame, types_uk: DataFrame, tags: DataFrame) -> DataFrame:
    """Adult clothing with at least one fully scored code: parent type, gender,
    combined code (normalised by synonym) and the code names."""
    from parlance.functions.expr import combine_codes
    names, one = combine_codes("dress_codes")
    d = products.where(F.col("age_group").rlike("(?i)^adult$") & (F.col("subvertical") == "clothing"))
    d = d.withColumn("codes", names).withColumn("dress_code", one).where(F.col("dress_code").isNotNull())
    d = main_codes(parent_types(d, types, types_uk), tags, "dress_code").where(F.col("parent_type").isNotNull())
    return d.select("product_id", "parent_type", F.lower("gender").alias("gender"), "dress_code", "codes")


def code_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("codes"), F.count(F.lit(1)).alias("n"))


GROUPS = 500  # groups of one type and gender that a block holds


def intersecting_groups(groups: DataFrame) -> DataFrame:
    """(type, gender, dress_code, other_code): groups of one type and gender that share a
    code, and every group with itself.  Found through an index from codes to groups."""
    at = groups.select(*GROUP, F.explode("codes").alias("_code"))
    met = at.join(at.withColumnRenamed("dress_code", "other_code"), ["parent_type", "gender", "_code"])
    return met.select(*GROUP, "other_code").union(groups.select(*GROUP, F.col("dress_code"))).distinct()


def disjoint_groups(groups: DataFrame, block: int = GROUPS) -> DataFrame:
    """Pairs of groups of one type and gender that share no code.  Works on the group
    table (one row per type, gender and code), never on products.  The groups of a type and
    gender meet block by block, so that one of them with many groups is not one task."""
    a = groups.select("parent_type", "gender", "dress_code", "codes")
    n = a.groupBy("parent_type", "gender").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    a = a.join(n, ["parent_type", "gender"]).withColumn("_b", F.pmod(F.xxhash64("dress_code"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = a.withColumn("_c", every).drop("_n")
    right = a.withColumnRenamed("_b", "_c").withColumn("_b", every).drop("_n").withColumnsRenamed({"dress_code": "other_code", "codes": "other_codes"})
    return (left.join(right, ["parent_type", "gender", "_b", "_c"])
            .where((F.col("dress_code") != F.col("other_code")) & ~F.arrays_overlap("codes", "other_codes"))
            .select(*GROUP, "other_code"))


def pos_neg_dataset(rows: DataFrame, pairs: DataFrame, salts: int = 16) -> DataFrame:
    """Rows of a group as class 1 and rows of its disjoint groups as class 0.  The rows of a
    group are dealt to ``salts`` parts, which its pairs meet one by one."""
    pos = rows.withColumn("class", F.lit(1))
    part = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    each = pairs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    neg = (part.withColumnRenamed("dress_code", "other_code").join(each, ["parent_type", "gender", "other_code", "_salt"])
           .drop("other_code", "_salt").withColumn("class", F.lit(0)))
    return pos.unionByName(neg.select(*pos.columns))


def rule_docs(items: DataFrame) -> DataFrame:
    """Aspect documents: no skipped aspects, no dress code token, blanks to ``_``."""
    keep = items.where(~skipped_aspect(F.split_part("item", F.lit("-"), F.lit(1))) & ~F.contains("item", F.lit("dress_code")))
    return item_docs(keep.withColumn("item", F.replace("item", F.lit(" "), F.lit("_")))).withColumnRenamed("basket_id", "product_id")


def feature_counts(rows: DataFrame, docs: DataFrame, groups: DataFrame) -> DataFrame:
    """n, n_class, n_feature and n_both of every token in every group's positive / negative
    data, without building that data or listing disjoint groups: tokens are counted per
    group and per (type, gender), and from the latter the counts of the groups that share a
    code are taken away.  groups: one row per group with its codes."""
    near = pinned(intersecting_groups(groups))
    side = GROUP[:2]
    n = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    tokens = rows.join(docs, "product_id").select(*GROUP, F.explode(F.array_distinct(F.split("doc", " "))).alias("item"))
    f = pinned(tokens.groupBy(*GROUP, "item").agg(F.count(F.lit(1)).alias("n")))
    of_near = lambda d, more: (d.withColumnRenamed("dress_code", "other_code").join(near, [*side, "other_code"])
                               .groupBy(*GROUP, *more).agg(F.sum("n").alias("near")))
    whole = lambda d, more: d.groupBy(*side, *more).agg(F.sum("n").alias("all"))
    sizes = n.join(whole(n, []), side).join(of_near(n, []), GROUP).select(
        *GROUP, F.col("n").alias("n_class"), (F.col("n") + F.col("all") - F.col("near")).alias("n"))
    # tokens of a group's own rows and of its disjoint groups' rows
    own = f.select(*GROUP, "item", F.col("n").alias("n_both"))
    every = n.select(*GROUP).join(whole(f, ["item"]), side)
    c = every.join(own, [*GROUP, "item"], "left").join(of_near(f, ["item"]), [*GROUP, "item"], "left").na.fill(0, ["n_both", "near"])
    c = c.select(*GROUP, "item", "n_both", (F.col("n_both") + F.col("all") - F.col("near")).alias("n_feature")).where("n_feature > 0")
    return c.join(sizes, GROUP)


def feature_effects(counts: DataFrame, thresh: float = 1.0, alpha: float = 2.0) -> DataFrame:
    """k = ln(posterior) - ln(prior); an effect counts beyond thresh * 10^(-alpha * prior)."""
    prior = F.col("n_class") / F.col("n")
    post = F.greatest(F.col("n_both") / F.col("n_feature"), F.lit(1e-10))
    k, cutoff = F.ln(post) - F.ln(prior), F.lit(thresh) * F.pow(F.lit(10.0), -F.lit(alpha) * prior)
    return (counts.withColumn("k", k)
            .withColumn("effect", F.when(k < -cutoff, "negative").when(k > cutoff, "positive").otherwise("neutral"))
            .withColumn("aspect", F.split_part("item", F.lit("-"), F.lit(1)))
            .withColumn("val", F.expr("substring(item, length(split_part(item, '-', 1)) + 2)")))


def effect_groups(effects: DataFrame) -> DataFrame:
    """Sorted value lists per aspect and sign (values are distinct per aspect)."""
    lists = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("effect") == e, F.col("val")))), ",").alias(e)
             for e in ("negative", "positive", "neutral")]
    return effects.groupBy(*GROUP, "aspect").agg(*lists)


def example_values(df: DataFrame, keys: list[str], example: str) -> DataFrame:
    """First two and the last example per key, at most three."""
    first = top_per_key(df.select(*keys, example), keys, [example], 2, "slot")
    last = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(example).alias(example))
            .where(F.col("_n") >= 3).drop("_n").withColumn("slot", F.lit(3)))
    return first.unionByName(last)


def market_items(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Baskets: document tokens plus the code of the product."""
    code = item_tokens({"dress_code": F.array("dress_code")}, "-")
    return rows.join(docs, "product_id").select("product_id", F.array_union(F.split("doc", " "), code).alias("items"))
