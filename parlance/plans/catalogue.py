"""Catalogue queries: lookups, counts, rule data, feature effects."""

from pyspark.sql import functions as F

from parlance.functions import expr as X
from parlance.operators import catalogue as C
from parlance.plans.registry import check_view, query
from parlance.session import pinned

check_view("ck_parent", """
SELECT product_id, product_type, gender, age_group, subvertical, coalesce(a.dp, b.dp) AS parent_type FROM fx_products p
LEFT JOIN (SELECT name, min(direct_parent) AS dp FROM fx_product_types GROUP BY 1) a ON a.name = p.product_type
LEFT JOIN (SELECT name, min(direct_parent) AS dp FROM fx_product_types_uk GROUP BY 1) b ON b.name = p.product_type""")
check_view("ck_main", "SELECT synonym, min(code) AS main FROM fx_code_synonyms GROUP BY 1")
check_view("ck_coded", """
SELECT product_id, string_agg(code, '_' ORDER BY code) AS combined, list(code ORDER BY code) AS codes FROM fx_product_codes WHERE score = 100 GROUP BY 1""")
check_view("ck_rows", """
SELECT product_id, parent_type, lower(gender) AS gender, coalesce(m.main, c.combined) AS dress_code, codes FROM ck_parent p JOIN ck_coded c USING (product_id)
LEFT JOIN ck_main m ON m.synonym = c.combined WHERE lower(age_group) = 'adult' AND subvertical = 'clothing' AND parent_type IS NOT NULL""")
check_view("ck_groups", """
SELECT parent_type, gender, dress_code, list_sort(list_distinct(flatten(list(codes)))) AS codes, count(*) AS n FROM ck_rows GROUP BY 1, 2, 3""")
check_view("ck_pairs", """
SELECT a.parent_type, a.gender, a.dress_code, b.dress_code AS other_code FROM ck_groups a JOIN ck_groups b USING (parent_type, gender)
WHERE a.dress_code <> b.dress_code AND NOT list_has_any(a.codes, b.codes)""")
check_view("ck_docs", """
SELECT basket_id AS product_id, string_agg(DISTINCT replace(item, ' ', '_'), ' ' ORDER BY replace(item, ' ', '_')) AS doc FROM fx_items
WHERE NOT regexp_matches(split_part(item, '-', 1), 'size|weather|price|body type') GROUP BY 1""")
check_view("ck_dataset", """
SELECT parent_type, gender, dress_code, product_id, 1 AS class FROM ck_rows
UNION ALL SELECT p.parent_type, p.gender, p.dress_code, r.product_id, 0 FROM ck_pairs p JOIN ck_rows r ON r.parent_type = p.parent_type AND r.gender = p.gender AND r.dress_code = p.other_code""")
check_view("ck_effect", """
WITH e AS (SELECT d.*, unnest(string_split(doc, ' ')) AS item FROM ck_dataset d JOIN ck_docs USING (product_id)),
s AS (SELECT parent_type, gender, dress_code, count(*) AS n, sum(class) AS n_class FROM ck_dataset GROUP BY 1, 2, 3),
f AS (SELECT parent_type, gender, dress_code, item, count(*) AS n_feature, sum(class) AS n_both FROM e GROUP BY 1, 2, 3, 4),
k AS (SELECT *, ln(greatest(n_both * 1.0 / n_feature, 1e-10)) - ln(n_class * 1.0 / n) AS k, 1.0 * pow(10, -2.0 * n_class / n) AS cutoff FROM f JOIN s USING (parent_type, gender, dress_code))
SELECT parent_type, gender, dress_code, item, split_part(item, '-', 1) AS aspect, substr(item, length(split_part(item, '-', 1)) + 2) AS val,
  CAST(n AS BIGINT) AS n, CAST(n_class AS BIGINT) AS n_class, CAST(n_feature AS BIGINT) AS n_feature, CAST(n_both AS BIGINT) AS n_both, k,
  CASE WHEN k < -cutoff THEN 'negative' WHEN k > cutoff THEN 'positive' ELSE 'neutral' END AS effect FROM k""")


def documents(t):
    return C.product_documents(t.fx_products, t.fx_product_codes, t.fx_product_occasions)


def parents(t, df):
    return C.parent_types(df, t.fx_product_types, t.fx_product_types_uk)


def rows(t):
    """Written once: groups, pairs, counts and the data set all start from it."""
    return pinned(C.coded_rows(t.fx_products.join(C.products_with_codes(t.fx_product_codes), "product_id"),
                               t.fx_product_types, t.fx_product_types_uk, C.code_tags(t.fx_code_synonyms)))


def pairs(r):
    return C.disjoint_groups(C.code_groups(r))


def effects(t):
    r = rows(t)
    return C.feature_effects(C.feature_counts(r, C.rule_docs(t.fx_items), C.code_groups(r)))


@query("j05_lookup_array", """
SELECT p.product_id, coalesce(string_agg(concat(code, ':', score), ',' ORDER BY code), '') AS codes FROM fx_products p LEFT JOIN fx_product_codes c USING (product_id) GROUP BY 1""")
def _(t):
    d = C.lookup_array(t.fx_products, t.fx_product_codes, "product_id", ["code", "score"], "codes")
    return d.select("product_id", F.array_join(F.transform("codes", lambda x: F.concat(x["code"], F.lit(":"), x["score"].cast("string"))), ",").alias("codes"))


@query("j06_lookup_member", """
SELECT product_id, c.code, coalesce(main, c.code) AS main_code FROM fx_product_codes c LEFT JOIN ck_main m ON m.synonym = c.code""")
def _(t):
    d = t.fx_product_codes.select("product_id", "code", F.col("code").alias("main_code"))
    return C.main_codes(d, C.code_tags(t.fx_code_synonyms), "main_code").select("product_id", "code", "main_code")


@query("j07_lookup_fallback", "SELECT product_id, product_type, parent_type FROM ck_parent")
def _(t):
    return parents(t, t.fx_products).select("product_id", "product_type", "parent_type")


@query("j08_lookup_required", "SELECT product_id, product_type FROM fx_products WHERE product_id IN (SELECT product_id FROM fx_product_occasions)")
def _(t):
    return t.fx_products.join(t.fx_product_occasions, "product_id", "left_semi").select("product_id", "product_type")


@query("j09_lookup_missing", "SELECT product_id, product_type FROM ck_parent WHERE parent_type IS NULL")
def _(t):
    return C.missing_in_both(t.fx_products, t.fx_product_types, t.fx_product_types_uk).select("product_id", "product_type")


@query("j11_disjoint_groups", "SELECT * FROM ck_pairs")
def _(t):
    return pairs(rows(t))


@query("a12_codes_per_group", """
SELECT gender, parent_type, occasion, string_agg(dress_code, ',' ORDER BY dress_code) AS codes, string_agg(CAST(n AS VARCHAR), ',' ORDER BY dress_code) AS counts,
  CAST(sum(n) AS BIGINT) AS total, string_agg(CAST(sample AS VARCHAR), ',' ORDER BY dress_code) AS samples FROM (
SELECT gender, parent_type, occasion, dress_code, count(*) AS n, max(product_id) AS sample FROM (
 SELECT p.product_id, gender, parent_type, coalesce(main, code) AS dress_code, (SELECT min(occasion) FROM fx_occasion_codes o WHERE o.code = coalesce(main, c.code)) AS occasion
 FROM ck_parent p JOIN fx_product_codes c USING (product_id) LEFT JOIN ck_main m ON m.synonym = c.code
 WHERE subvertical = 'clothing' AND parent_type IS NOT NULL AND p.product_id IN (SELECT product_id FROM fx_product_codes WHERE score >= 100 GROUP BY 1 HAVING count(*) = 1) AND score = 100) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def _(t):
    d = documents(t).where(F.col("subvertical") == "clothing").withColumn("dress_codes", X.keep_scored("dress_codes"))
    d = parents(t, C.exactly_one(d, "dress_codes")).where(F.col("parent_type").isNotNull())
    d = d.withColumn("dress_code", F.get(F.col("dress_codes.name"), F.lit(0))).drop("occasions")
    d = C.occasion_of(C.main_codes(d, C.code_tags(t.fx_code_synonyms), "dress_code"), t.fx_occasion_codes, "dress_code")
    g = C.codes_per_group(d, ["gender", "parent_type", "occasion"], "dress_code", sample="product_id")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return g.select("gender", "parent_type", "occasion", text("codes"), text("counts"), "total", text("samples"))


@query("a13_sample_id", "SELECT code, max(product_id) AS sample FROM fx_product_codes GROUP BY 1")
def _(t):
    return t.fx_product_codes.groupBy("code").agg(F.max("product_id").alias("sample"))


@query("a14_set_key_counts", """
SELECT codes, gender, parent_type, count(*) AS n FROM (SELECT product_id, string_agg(code, ',' ORDER BY code) AS codes FROM fx_product_codes WHERE score >= 100 GROUP BY 1) JOIN ck_parent USING (product_id)
WHERE subvertical = 'clothing' GROUP BY 1, 2, 3""")
def _(t):
    return C.set_key_counts(parents(t, documents(t).where(F.col("subvertical") == "clothing")), ["gender", "parent_type"])


def scored(t):
    return t.fx_products.join(t.fx_product_codes.where(F.col("score") >= 100), "product_id").withColumnRenamed("code", "dress_code")


def counted(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("a15_counts_by_code", """
SELECT coalesce(main, code) AS dress_code, gender, parent_type, count(*) AS n FROM ck_parent JOIN fx_product_codes USING (product_id)
LEFT JOIN ck_main m ON m.synonym = code WHERE score >= 100 GROUP BY 1, 2, 3""")
def by_code(t):
    d = C.main_codes(parents(t, scored(t)), C.code_tags(t.fx_code_synonyms), "dress_code")
    return counted(d, "dress_code", "gender", "parent_type")


@query("a15_counts_plain", """
SELECT code AS dress_code, gender, direct_parent AS parent_type, count(*) AS n FROM fx_products p JOIN fx_product_codes USING (product_id)
LEFT JOIN fx_product_types t ON t.name = p.product_type WHERE score >= 100 GROUP BY 1, 2, 3""")
def _(t):
    one = t.fx_product_types.select(F.col("name").alias("product_type"), F.col("direct_parent").alias("parent_type"))
    return counted(scored(t).join(one, "product_type", "left"), "dress_code", "gender", "parent_type")


@query("a15_counts_fallback", """
SELECT code AS dress_code, gender, parent_type, count(*) AS n FROM ck_parent JOIN fx_product_codes USING (product_id) WHERE score >= 100 GROUP BY 1, 2, 3""")
def _(t):
    return counted(parents(t, scored(t)), "dress_code", "gender", "parent_type")


@query("a16_product_type_counts", """
SELECT code AS dress_code, parent_type, product_type, count(*) AS n FROM ck_parent JOIN fx_product_codes USING (product_id) WHERE score >= 100 GROUP BY 1, 2, 3""")
def _(t):
    return counted(parents(t, scored(t)), "dress_code", "parent_type", "product_type")


check_view("ck_mapped", """
SELECT p.product_id, parent_type, gender, o.occasion, m.code FROM ck_parent p JOIN (SELECT product_id, min(occasion) AS occasion FROM fx_product_occasions GROUP BY 1 HAVING count(*) = 1) o USING (product_id)
JOIN (SELECT occasion, min(code) AS code FROM fx_occasion_codes GROUP BY 1 HAVING count(*) = 1) m USING (occasion)
WHERE product_id NOT IN (SELECT product_id FROM fx_product_codes WHERE score >= 100)""")


def mapped(t):
    return C.mapped_from_occasion(documents(t), t.fx_occasion_codes)


@query("a17_occasion_mapped", "SELECT product_id, occasion, code FROM ck_mapped")
def _(t):
    return mapped(t).select("product_id", "occasion", F.col("mapped_code").alias("code"))


@query("a17_occasion_mapped_counts", "SELECT parent_type, gender, code, count(*) AS n FROM ck_mapped GROUP BY 1, 2, 3")
def _(t):
    return counted(parents(t, mapped(t)).withColumnRenamed("mapped_code", "code"), "parent_type", "gender", "code")


@query("a18_unwind", "SELECT code, unnest(list_sort(list(DISTINCT synonym))) AS synonym FROM fx_code_synonyms GROUP BY 1")
def _(t):
    return C.code_tags(t.fx_code_synonyms).select(F.col("dress_code").alias("code"), F.explode("synonyms").alias("synonym"))


@query("a39_feature_effect", "SELECT parent_type, gender, dress_code, item, n, n_class, n_feature, n_both, round(k, 6) AS k, effect FROM ck_effect")
def _(t):
    return effects(t).select(*C.GROUP, "item", "n", "n_class", "n_feature", "n_both", F.round("k", 6).alias("k"), "effect")


@query("a40_effect_groups", """
SELECT parent_type, gender, dress_code, aspect, coalesce(string_agg(val, ',' ORDER BY val) FILTER (WHERE effect = 'negative'), '') AS negative,
  coalesce(string_agg(val, ',' ORDER BY val) FILTER (WHERE effect = 'positive'), '') AS positive,
  coalesce(string_agg(val, ',' ORDER BY val) FILTER (WHERE effect = 'neutral'), '') AS neutral FROM ck_effect GROUP BY 1, 2, 3, 4""")
def _(t):
    return C.effect_groups(effects(t))


check_view("ck_examples", """
SELECT item, product_id, CAST(CASE WHEN r <= 2 THEN r ELSE 3 END AS INT) AS slot FROM (SELECT item, basket_id AS product_id, row_number() OVER (PARTITION BY item ORDER BY basket_id) AS r, count(*) OVER (PARTITION BY item) AS c FROM fx_items) WHERE r <= 2 OR r = c""")


def examples(t):
    return C.example_values(t.fx_items.withColumnRenamed("basket_id", "product_id"), ["item"], "product_id")


@query("a46_example_values", "SELECT * FROM ck_examples")
def _(t):
    return examples(t)


@query("a44_share_before_after", """
WITH b AS (SELECT parent_type, gender, code, count(*) AS before FROM ck_parent JOIN fx_product_codes USING (product_id) WHERE score >= 100 GROUP BY 1, 2, 3),
a AS (SELECT parent_type, gender, code, count(*) AS added FROM ck_mapped WHERE parent_type IS NOT NULL GROUP BY 1, 2, 3)
SELECT parent_type, gender, code, coalesce(before, 0) AS before, coalesce(added, 0) AS added, coalesce(before, 0) + coalesce(added, 0) AS after
FROM b FULL JOIN a USING (parent_type, gender, code) WHERE parent_type IS NOT NULL""")
def _(t):
    keys = ["parent_type", "gender", "code"]
    known = F.col("parent_type").isNotNull()
    b = counted(parents(t, scored(t)).withColumnRenamed("dress_code", "code").where(known), *keys)
    a = counted(parents(t, mapped(t)).withColumnRenamed("mapped_code", "code").where(known), *keys)
    return C.before_after(b, a, keys)


@query("u05_pos_neg_dataset", "SELECT parent_type, gender, dress_code, product_id, class, doc FROM ck_dataset JOIN ck_docs USING (product_id)")
def _(t):
    r = rows(t)
    d = C.pos_neg_dataset(r.drop("codes").join(C.rule_docs(t.fx_items), "product_id"), pairs(r))
    return d.select(*C.GROUP, "product_id", "class", "doc")


@query("u06_add_mapped", """
SELECT product_id, min(code) AS codes FROM fx_product_codes GROUP BY 1 HAVING count(*) = 1 AND max(score) = 100
UNION ALL SELECT product_id, 'festive' FROM ck_mapped WHERE code = 'festive'""")
def _(t):
    return C.add_mapped(documents(t), mapped(t)).select("product_id", F.array_join("dress_codes.name", ",").alias("codes"))


check_view("ck_manual", """
SELECT parent_type, gender, dress_code, item, CASE length(item) % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'ignore' END AS label FROM ck_effect""")


def label_merge(t):
    e = effects(t).select(*C.GROUP, "item", "effect")
    n = F.length("item") % 4
    manual = e.select(*C.GROUP, "item", F.when(n == 0, "positive").when(n == 1, "negative").when(n == 2, "neutral").otherwise("ignore").alias("label"))
    manual = manual.withColumn("label", F.when(F.col("label") == "ignore", "neutral").otherwise(F.col("label")))
    return manual.join(e, [*C.GROUP, "item"])


check_view("ck_labelled", """
SELECT parent_type, gender, dress_code, item, CASE label WHEN 'ignore' THEN 'neutral' ELSE label END AS label, effect FROM ck_manual JOIN ck_effect USING (parent_type, gender, dress_code, item)""")


@query("j13_label_merge", "SELECT * FROM ck_labelled")
def _(t):
    return label_merge(t)


check_view("ck_own_examples", """
SELECT parent_type, gender, dress_code, aspect, val, product_id, CAST(CASE WHEN r <= 2 THEN r ELSE 3 END AS INT) AS slot FROM (
SELECT *, row_number() OVER (PARTITION BY parent_type, gender, dress_code, aspect, val ORDER BY product_id) AS r, count(*) OVER (PARTITION BY parent_type, gender, dress_code, aspect, val) AS c FROM (
SELECT parent_type, gender, dress_code, split_part(item, '-', 1) AS aspect, substr(item, length(split_part(item, '-', 1)) + 2) AS val, product_id
FROM (SELECT *, unnest(string_split(doc, ' ')) AS item FROM ck_rows JOIN ck_docs USING (product_id)))) WHERE r <= 2 OR r = c""")
FIVE = [*C.GROUP, "aspect", "val"]


@query("j18_merge_examples", """
SELECT parent_type, gender, dress_code, aspect, val, effect, product_id, slot FROM (
SELECT *, split_part(item, '-', 1) AS aspect, substr(item, length(split_part(item, '-', 1)) + 2) AS val FROM ck_effect) JOIN ck_own_examples USING (parent_type, gender, dress_code, aspect, val)""")
def _(t):
    """Examples of the group itself, merged on group, aspect and value."""
    items = rows(t).select(*C.GROUP, "product_id").join(C.rule_docs(t.fx_items), "product_id").select(*C.GROUP, "product_id", F.explode(F.split("doc", " ")).alias("item"))
    items = items.withColumns({"aspect": F.split_part("item", F.lit("-"), F.lit(1)), "val": F.expr("substring(item, length(split_part(item, '-', 1)) + 2)")})
    return effects(t).select(*FIVE, "effect").join(C.example_values(items, FIVE, "product_id"), FIVE)
