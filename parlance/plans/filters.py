"""Filters (F), deduplication (D) and top-k / set operations (T, U) on rows."""

from pyspark.sql import functions as F

from parlance.functions import expr as X
from parlance.operators import catalogue as C
from parlance.operators import rows as R
from parlance.plans.registry import query


@query("f01_since_date", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def _(t):
    return X.since(t.events, "ts", "2024-01-15").select("event_id", "user_id")


@query("f02_tenant", "SELECT * FROM fx_bot WHERE retailer_id IN (1, 2) AND response_code IN ('yes_no', 'fit_question')")
def _(t):
    return t.fx_bot.where(F.col("retailer_id").isin(1, 2) & F.col("response_code").isin("yes_no", "fit_question"))


@query("f03_exclude_yes_no", """
SELECT sender_id, ts, response_code FROM fx_bot WHERE response_code IS NULL OR response_code NOT IN (SELECT response_code FROM fx_bot WHERE replies = 'yes,no' AND response_code IS NOT NULL)""")
def _(t):
    bot = t.fx_bot.withColumn("answers", F.split("replies", ","))
    return R.exclude_yes_no(bot, "response_code", "answers").select("sender_id", "ts", "response_code")


@query("f04_min_share", """
WITH s AS (SELECT c_nationkey, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM customer GROUP BY 1)
SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM s WHERE share >= 0.04) AND c_nationkey IN (1, 2, 3, 5, 8, 13, 21)""")
def _(t):
    return R.min_share(t.customer, "c_nationkey", 0.04, [1, 2, 3, 5, 8, 13, 21]).select("c_custkey", "c_nationkey")


@query("f05_min_support", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 75")
def _(t):
    return R.min_support(t.part, ["p_brand"], 75)


@query("f06_exactly_one", "SELECT product_id FROM fx_product_codes GROUP BY 1 HAVING count(*) = 1 AND max(score) = 100")
def _(t):
    return C.exactly_one(C.products_with_codes(t.fx_product_codes), "dress_codes").select("product_id")


@query("f07_at_least_one", """
SELECT p.product_id, count(c.code) FILTER (WHERE c.score >= 100) > 0 AS has_code, count(o.occasion) > 0 AS has_occasion
FROM fx_products p LEFT JOIN fx_product_codes c USING (product_id) LEFT JOIN fx_product_occasions o USING (product_id) GROUP BY 1""")
def _(t):
    p = C.product_documents(t.fx_products, t.fx_product_codes, t.fx_product_occasions)
    return p.select("product_id", (F.size(X.keep_scored("dress_codes")) > 0).alias("has_code"),
                    (F.size("occasions") > 0).alias("has_occasion"))


@query("f08_array_match", "SELECT DISTINCT product_id FROM fx_product_codes WHERE code = 'festive'")
def _(t):
    return C.products_with_codes(t.fx_product_codes).where(F.array_contains("dress_codes.name", "festive")).select("product_id")


@query("f09_case_insensitive", "SELECT product_id FROM fx_products WHERE lower(age_group) = 'adult'")
def _(t):
    return t.fx_products.where(F.col("age_group").rlike("(?i)^adult$")).select("product_id")


@query("f10_aspect_exclusion", "SELECT basket_id, item FROM fx_items WHERE NOT regexp_matches(split_part(item, '-', 1), 'size|weather|price|body type')")
def _(t):
    return t.fx_items.where(~X.skipped_aspect(F.split_part("item", F.lit("-"), F.lit(1))))


@query("f11_has_any_flag", "SELECT conversation_id FROM fx_outcomes WHERE add_to_cart = 1 OR converted = 1")
def _(t):
    return t.fx_outcomes.where(X.any_flag(["add_to_cart", "converted"])).select("conversation_id")


@query("f12_drop_zero_columns", "SELECT conversation_id, add_to_cart, converted FROM fx_outcomes")
def _(t):
    d = t.fx_outcomes.select("conversation_id", "add_to_cart", "converted",
                             (F.col("converted") * (1 - F.col("converted"))).alias("never"))
    return X.drop_zero_columns(d, ["add_to_cart", "converted", "never"])


@query("f13_has_fields", "SELECT sender_id, ts, positive_aspects IS NOT NULL AS has_fields FROM fx_user")
def _(t):
    a = X.pad_array(F.coalesce(F.split("positive_aspects", ","), F.array().cast("array<string>")), 2)
    return t.fx_user.select("sender_id", "ts", X.has_values(a).alias("has_fields"))


@query("f14_cap_value", "SELECT sender_id, ts, time_from_start FROM ck_jnd WHERE src = 1 AND time_from_start <= 200")
def _(t):
    from parlance.plans.sequences import conversation
    return conversation(t).where((F.col("src") == 1) & (F.col("time_from_start") <= 200)).select("sender_id", "ts", "time_from_start")


@query("f15_text_contains", "SELECT page_id FROM pages WHERE contains(url, '/en/') AND length(html) > 1")
def _(t):
    return t.pages.where(F.contains("url", F.lit("/en/")) & (F.length("html") > 1)).select("page_id")


@query("f16_key_exists", "SELECT message_id, min(intent) AS intent FROM fx_tags WHERE intent IS NOT NULL AND tag = 'true' GROUP BY 1")
def _(t):
    from parlance.operators.retrieval import tag_documents
    d = tag_documents(t.fx_tags).where((F.size("intents") > 0) & (F.element_at("intents", 1)["tag"] == "true"))
    return d.select("message_id", F.element_at("intents", 1)["name"].alias("intent"))


@query("f17_rare_labels", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 45)")
def _(t):
    return R.rare_labels(t.documents, "source", 45).select("doc_id", "source")


@query("f18_one_product", "SELECT product_id FROM fx_products WHERE product_type = 'red ring'")
def _(t):
    return t.fx_products.where(F.col("product_type") == "red ring").select("product_id")


@query("d01_distinct_by_key", """
SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def _(t):
    return R.distinct_by_key(t.events, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("d02_distinct_rows", "SELECT DISTINCT sender_id, response_code FROM fx_bot")
def _(t):
    return t.fx_bot.select("sender_id", "response_code").distinct()


@query("d03_best_per_text", """
WITH b AS (SELECT lang, text, max(n_chars * 1.0 / (doc_id + 1)) AS score FROM documents GROUP BY 1, 2),
r AS (SELECT lang, md5(text) AS text_key, round(score, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, text) AS rank FROM b)
SELECT * FROM r WHERE rank <= 40""")
def _(t):
    d = t.documents.select("lang", "text", (F.col("n_chars") / (F.col("doc_id") + 1)).alias("score"))
    return R.best_per_text(d, ["lang"], "text", "score", 40).select(
        "lang", F.md5("text").alias("text_key"), F.round("score", 6).alias("score"), "rank")


@query("d04_one_to_one_ids", """
SELECT ga_session_id, sender_id, ts FROM fx_nlu_raw WHERE ga_session_id IN (SELECT ga_session_id FROM fx_nlu_raw GROUP BY 1 HAVING count(DISTINCT sender_id) = 1)""")
def _(t):
    return R.one_to_one_ids(t.fx_nlu_raw, "ga_session_id", "sender_id").select("ga_session_id", "sender_id", "ts")


@query("t01_order_by_count", "SELECT code, count(*) AS n FROM fx_product_codes GROUP BY 1 ORDER BY n DESC, code")
def _(t):
    return t.fx_product_codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code")


@query("u01_union_tagged", """
WITH r AS (SELECT sender_id, ts, text, row_number() OVER (PARTITION BY sender_id ORDER BY ts) AS a, row_number() OVER (PARTITION BY sender_id ORDER BY ts DESC) AS b FROM fx_user)
SELECT sender_id, ts, text, 'first' AS source FROM r WHERE a = 1 UNION ALL SELECT sender_id, ts, text, 'last' FROM r WHERE b = 1""")
def _(t):
    u = t.fx_user.select("sender_id", "ts", "text")
    return R.first_and_last(u, ["sender_id"], ["ts"])


@query("u02_union_all", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(t):
    # many per-group results are one grouped job, not a loop
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("u03_array_sets", """
WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS a, string_split('the of and to in is', ' ') AS b FROM fx_texts)
SELECT doc_id, len(list_intersect(a, b)) AS both_n, len(a) + len(b) - len(list_intersect(a, b)) AS any_n, len(a) - len(list_intersect(a, b)) AS only_n FROM w""")
def _(t):
    b = F.array(*[F.lit(w) for w in "the of and to in is".split()])
    a = F.split(F.lower("text"), " ")
    n = lambda c: F.size(c).cast("long")
    return t.fx_texts.select("doc_id", n(F.array_intersect(a, b)).alias("both_n"), n(F.array_union(a, b)).alias("any_n"),
                             n(F.array_except(a, b)).alias("only_n"))


@query("u04_query_remainder", """
SELECT vec_id, intent FROM fx_vectors WHERE vec_id NOT IN (SELECT vec_id FROM fx_vectors ORDER BY md5(concat('7:', CAST(vec_id AS VARCHAR))), vec_id LIMIT 50)""")
def _(t):
    from parlance.operators.sampling import sample_n
    v = t.fx_vectors.select("vec_id", "intent")
    return v.join(sample_n(v, "vec_id", 50, 7).select("vec_id"), "vec_id", "left_anti")
