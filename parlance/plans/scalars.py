"""Projections and scalar functions (P)."""

from pyspark.sql import functions as F

from parlance.functions import expr as X
from parlance.functions.scan import top_per_key
from parlance.operators import catalogue as C
from parlance.plans.registry import query
from parlance.session import scratch
from parlance.sources.files import numbered_lines
from parlance.sources.schemas import CHANNEL, NBR_RESPONSE, NLU_RESPONSE

FMT = "yyyy-MM-dd HH:mm:ss"


@query("p01_epoch_to_ts", """
SELECT sender_id, ts, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS at_s,
  strftime(make_timestamp(ts * 1000000 + 5000), '%Y-%m-%d %H:%M:%S.%g') AS at_ms FROM fx_user""")
def _(t):
    return t.fx_user.select("sender_id", "ts", F.date_format(X.from_epoch_s("ts"), FMT).alias("at_s"),
                            F.date_format(X.from_epoch_ms(F.col("ts") * 1000 + 5), FMT + ".SSS").alias("at_ms"))


@query("p02_calendar", """
SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(dayofweek(ts) + 1 AS INT) AS day_of_week,
  CAST(hour(ts) AS INT) AS hour, strftime(ts, '%a') AS day_name, concat(year(ts), '_', month(ts)) AS year_month FROM events""")
def _(t):
    cal = X.calendar("ts")
    return t.events.select("event_id", *[c.alias(n) for n, c in cal.items()])


@query("p03_calendar_text", """
WITH d AS (SELECT conversation_id, created_at, try_strptime(created_at, '%Y-%m-%d %H:%M:%S') AS d_at FROM fx_conv_raw)
SELECT conversation_id, CASE WHEN d_at IS NOT NULL THEN substr(created_at, 1, 4) END AS year,
  CASE WHEN d_at IS NOT NULL THEN substr(created_at, 6, 2) END AS month, dayname(d_at) AS weekday, CAST(hour(d_at) AS INT) AS hour FROM d""")
def _(t):
    return t.fx_conv_raw.select("conversation_id", *[c.alias(n) for n, c in X.calendar_text("created_at").items()])


@query("p04_iso_weekday", "SELECT event_id, CAST(isodow(ts) AS VARCHAR) AS iso_day FROM events")
def _(t):
    return t.events.select("event_id", X.iso_weekday("ts").alias("iso_day"))


@query("p05_parse_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("p06_nested_paths", """
SELECT sender_id, ts, json_extract_string(json_response, '$.consumer_details.gender') AS gender,
  json_extract_string(json_response, '$.subvertical') AS subvertical,
  array_to_string(json_extract_string(json_response, '$.intents[*].intent'), ',') AS intents,
  array_to_string(json_extract_string(json_response, '$.positive.aspects[*].aspect'), ',') AS aspects,
  json_extract_string(json_response, '$.positive.product_type.parent_type') AS product_type FROM fx_nlu_raw""")
def _(t):
    j = t.fx_nlu_raw.withColumn("j", F.from_json("json_response", NLU_RESPONSE))
    return j.select("sender_id", "ts", F.col("j.consumer_details.gender"), F.col("j.subvertical"),
                    F.array_join("j.intents.intent", ",").alias("intents"),
                    F.array_join("j.positive.aspects.aspect", ",").alias("aspects"),
                    F.col("j.positive.product_type.parent_type").alias("product_type"))


@query("p07_json_to_columns", """
SELECT conversation_id, json_extract_string(channel, '$.platform') AS platform, json_extract_string(channel, '$.device') AS device,
  json_extract_string(channel, '$.os') AS os, json_extract_string(channel, '$.app') AS app FROM fx_conv_raw""")
def _(t):
    return X.json_to_columns(t.fx_conv_raw.select("conversation_id", "channel"), "channel", CHANNEL)


@query("p08_second_elements", """
SELECT sender_id, ts, array_to_string(json_extract_string(json_response, '$.next_response.possible_values[*][1]'), ',') AS answers
FROM fx_nbr_raw WHERE json_extract(json_response, '$.next_response.possible_values') IS NOT NULL
UNION ALL SELECT sender_id, ts, NULL FROM fx_nbr_raw WHERE json_extract(json_response, '$.next_response.possible_values') IS NULL""")
def _(t):
    j = F.from_json("json_response", NBR_RESPONSE)["next_response"]["possible_values"]
    return t.fx_nbr_raw.select("sender_id", "ts", F.array_join(X.second_elements(j), ",").alias("answers"))


@query("p09_array_length", "SELECT sender_id, ts, CAST(len(string_split(positive_aspects, ',')) AS INT) AS n FROM fx_user")
def _(t):
    return t.fx_user.select("sender_id", "ts", X.array_length(F.split("positive_aspects", ",")).alias("n"))


@query("p10_is_array", "SELECT sender_id, ts, json_extract(json_response, '$.skus') IS NOT NULL AS is_sku FROM fx_nlu_raw")
def _(t):
    return t.fx_nlu_raw.select("sender_id", "ts", X.is_array(F.from_json("json_response", NLU_RESPONSE)["skus"]).alias("is_sku"))


@query("p11_resolve_identity", """
SELECT sender_id, ts, CASE WHEN length(ga_session_id) > 5 THEN ga_session_id ELSE CAST(sender_id AS VARCHAR) END AS user_id FROM fx_nlu_raw""")
def _(t):
    return t.fx_nlu_raw.select("sender_id", "ts", X.resolve_identity("ga_session_id", "sender_id").alias("user_id"))


@query("p12_null_sentinel", """
SELECT conversation_id, coalesce(TRY_CAST(nullif(num_of_messages, 'NULL') AS INT), 0) AS n,
  coalesce(TRY_CAST(nullif(transaction_value, 'NULL') AS DOUBLE), 0) AS amount, coalesce(CAST(add_to_cart AS INT), 0) AS added FROM fx_conv_raw""")
def _(t):
    return t.fx_conv_raw.select("conversation_id", X.null_sentinel("num_of_messages", "int").alias("n"),
                                X.null_sentinel("transaction_value").alias("amount"),
                                X.null_sentinel("add_to_cart", "int").alias("added"))


@query("p13_flags", """
SELECT conversation_id, CAST(ga_session_id <> 'NULL' AS INT) AS has_ga, CAST(customer_type = 'Returning Visitor' AS INT) AS returning_visitor,
  CAST(customer_type = 'New Visitor' AS INT) AS new_visitor FROM fx_conv_raw""")
def _(t):
    return t.fx_conv_raw.select("conversation_id", X.flag(F.col("ga_session_id") != "NULL").alias("has_ga"),
                                X.flag(F.col("customer_type") == "Returning Visitor").alias("returning_visitor"),
                                X.flag(F.col("customer_type") == "New Visitor").alias("new_visitor"))


@query("p14_prefix_columns", "SELECT sender_id AS nbr_sender_id, ts AS nbr_ts, response_code AS nbr_response_code FROM fx_bot")
def _(t):
    return X.prefix_columns(t.fx_bot.select("sender_id", "ts", "response_code"), "nbr_")


@query("p15_label_missing", """
SELECT sender_id, ts, CASE WHEN response_code IS NULL THEN 'no_answer' WHEN response_code = '' THEN 'empty' ELSE response_code END AS code FROM fx_bot""")
def _(t):
    return t.fx_bot.select("sender_id", "ts", X.label_missing("response_code").alias("code"))


@query("p16_bind_categories", """
SELECT sender_id, ts, CASE WHEN product_type IN ('shirt', 'jeans') THEN product_type ELSE 'other' END AS product_type,
  CAST(positive_aspects IS NOT NULL AS INT) AS has_aspects, CAST(coalesce(subvertical = 'clothing', false) AS INT) AS is_clothing FROM fx_user""")
def _(t):
    return t.fx_user.select("sender_id", "ts", X.bind_categories("product_type", ["shirt", "jeans"]).alias("product_type"),
                            X.flag(F.size(F.split("positive_aspects", ",")) > 0).alias("has_aspects"),
                            X.flag(F.col("subvertical") == "clothing").alias("is_clothing"))


@query("p17_bucket_rare", """
WITH v AS (SELECT p_name, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER () AS share, row_number() OVER (ORDER BY count(*) DESC, p_name NULLS LAST) AS r FROM part GROUP BY 1)
SELECT p_partkey, coalesce(v.p_name, 'other') AS name, p_brand FROM part LEFT JOIN v ON part.p_name = v.p_name AND share >= 0.005 AND r <= 40""")
def _(t):
    d = t.part.select("p_partkey", F.col("p_name").alias("name"), "p_brand")
    return X.bucket_rare(d, ["name"])


@query("p18_cut_bins", """
SELECT sender_id, ts, CASE WHEN next_response_time < 1 THEN '[0,1)' WHEN next_response_time < 2 THEN '[1,2)' ELSE '[2,inf)' END AS bin FROM fx_bot""")
def _(t):
    return t.fx_bot.select("sender_id", "ts", X.cut("next_response_time", [0, 1, 2]).alias("bin"))


@query("p19_rescale", """
SELECT c_custkey, round(-1 + 2 * (c_acctbal - min(c_acctbal) OVER ()) / nullif(max(c_acctbal) OVER () - min(c_acctbal) OVER (), 0), 6) AS scaled FROM customer""")
def _(t):
    return X.rescale(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "scaled").select(
        "c_custkey", F.round("scaled", 6).alias("scaled"))


@query("p20_clean_names", 'SELECT doc_id AS "doc_id_", score AS "a_b_", grp AS "_grp" FROM fx_scores')
def _(t):
    return X.clean_names(t.fx_scores.select(F.col("doc_id").alias("doc_id["), F.col("score").alias("a]b<"), F.col("grp").alias("[grp")))


@query("p21_pad_array", """
SELECT sender_id, ts, CASE coalesce(positive_aspects, '') WHEN '' THEN '*,*,*' WHEN 'color,fit' THEN 'color,fit,*' ELSE concat(positive_aspects, ',*,*') END AS padded FROM fx_user""")
def _(t):
    a = F.coalesce(F.split("positive_aspects", ","), F.array().cast("array<string>"))
    return t.fx_user.select("sender_id", "ts", F.array_join(X.pad_array(a, 3), ",").alias("padded"))


@query("p22_unique_sorted", """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(string_split(text, ' '), lambda x: substr(x, 1, 2)))), ',') AS starts FROM fx_texts""")
def _(t):
    return t.fx_texts.select("doc_id", F.array_join(
        X.unique_sorted(F.split("text", " "), lambda x: F.substring(x, 1, 2)), ",").alias("starts"))


@query("p23_filter_elements", """
SELECT product_id, coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE score >= 100), '') AS codes FROM fx_product_codes GROUP BY 1""")
def _(t):
    return C.products_with_codes(t.fx_product_codes).select(
        "product_id", F.array_join(X.keep_scored("dress_codes")["name"], ",").alias("codes"))


@query("p24_first_element", "SELECT product_id, min(code) AS first_code FROM fx_product_codes GROUP BY 1")
def _(t):
    return C.products_with_codes(t.fx_product_codes).select("product_id", X.first_sorted(F.col("dress_codes.name")).alias("first_code"))


@query("p25_if_null", "SELECT sender_id, ts, coalesce(product_type, subvertical) AS kind FROM fx_user")
def _(t):
    return t.fx_user.select("sender_id", "ts", F.coalesce("product_type", "subvertical").alias("kind"))


@query("p26_shares_of_array", """
SELECT gender, string_agg(CAST(round(n * 1.0 / tot, 4) AS VARCHAR), ',' ORDER BY code) AS shares FROM
(SELECT gender, code, n, sum(n) OVER (PARTITION BY gender) AS tot FROM (
 SELECT gender, code, count(*) AS n FROM fx_products JOIN fx_product_codes USING (product_id) GROUP BY 1, 2)) GROUP BY 1""")
def _(t):
    g = C.codes_per_group(t.fx_products.join(t.fx_product_codes, "product_id"), ["gender"], "code")
    # the tables of shares are printed with 4 digits
    return g.select("gender", F.array_join(F.transform("shares", lambda x: F.round(x, 4).cast("string")), ",").alias("shares"))


@query("p27_combine_codes", """
SELECT product_id, string_agg(code, '_' ORDER BY code) FILTER (WHERE score = 100) AS dress_code, count(*) FILTER (WHERE score = 100) AS n
FROM fx_product_codes GROUP BY 1""")
def _(t):
    names, one = X.combine_codes("dress_codes")
    return C.products_with_codes(t.fx_product_codes).select(
        "product_id", one.alias("dress_code"), F.coalesce(F.size(names), F.lit(0)).cast("long").alias("n"))


def words():
    return F.array(F.struct(F.when(F.col("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise("").alias("main_synonym"),
                            F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("lemma"),
                            F.array(F.when(F.col("p_size") > 25, "dark").otherwise("pale"), F.when(F.col("p_size") > 40, "blue").otherwise("red")).alias("contained_groups")))



@query("p28_resolve_colours", """
SELECT p_partkey, concat(CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue', 'green') THEN concat(split_part(p_name, ' ', 1), CASE WHEN split_part(p_name, ' ', 1) <> CASE WHEN p_size > 40 THEN 'blue' ELSE 'red' END THEN ',' ELSE '' END) ELSE '' END,
  CASE WHEN split_part(p_name, ' ', 1) <> CASE WHEN p_size > 40 THEN 'blue' ELSE 'red' END THEN CASE WHEN p_size > 40 THEN 'blue' ELSE 'red' END ELSE '' END) AS colours,
  CASE WHEN p_size > 25 THEN 'dark' ELSE 'pale' END AS color_groups FROM part""")
def _(t):
    colours, groups = X.resolve_colours("w", ["red", "blue", "green"])
    return t.part.withColumn("w", words()).select("p_partkey", F.array_join(colours, ",").alias("colours"), F.array_join(groups, ",").alias("color_groups"))


@query("p29_resolve_aspects", "SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS vals FROM part")
def _(t):
    return t.part.withColumn("w", words()).select("p_partkey", F.array_join(X.resolve_aspect("w"), ",").alias("vals"))


@query("p30_to_item_tokens", """
SELECT product_id, array_to_string(list_sort(list(DISTINCT concat('dress_code_', code))), ',') AS items,
  concat('product_type-', any_value(product_type)) AS doc FROM fx_products JOIN fx_product_codes USING (product_id) GROUP BY product_id""")
def _(t):
    p = t.fx_products.join(C.products_with_codes(t.fx_product_codes), "product_id")
    return p.select("product_id", F.array_join(F.array_sort(X.item_tokens({"dress_code": F.col("dress_codes.name")}, "_")), ",").alias("items"),
                    F.array_join(X.item_tokens({"product_type": F.array("product_type")}, "-"), " ").alias("doc"))


@query("p31_parse_item_tokens", """
WITH d AS (SELECT basket_id, split_part(item, '-', 1) AS aspect, substr(item, length(split_part(item, '-', 1)) + 2) AS val FROM fx_items WHERE basket_id % 4 <> 1 OR item NOT LIKE 'look-%'),
a AS (SELECT DISTINCT aspect FROM d WHERE aspect <> 'brand'), b AS (SELECT DISTINCT basket_id FROM d)
SELECT b.basket_id, a.aspect, coalesce(min(d.val), 'Unknown') AS val FROM b CROSS JOIN a LEFT JOIN d ON d.basket_id = b.basket_id AND d.aspect = a.aspect GROUP BY 1, 2""")
def _(t):
    docs = C.item_docs(t.fx_items.where((F.col("basket_id") % 4 != 1) | ~F.col("item").startswith("look-")))
    return C.parse_docs(docs, "basket_id", "doc", ignore=["brand"])


@query("p32_readable_rules", """
WITH r AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size FROM part)
SELECT p_partkey AS rule_id, CASE WHEN p_size % 3 = 0 THEN concat('shape ', b, ',look not ', a) ELSE concat('look ', a, ',shape ', b) END AS rule,
  CASE WHEN p_size > 25 THEN '0.9' ELSE '0.8' END AS prob FROM r WHERE p_size % 3 <> 2""")
def _(t):
    # rule text of a decision tree: one condition per element, look before shape
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    look = F.concat(F.lit("look-"), a, F.when(F.col("p_size") % 3 == 1, ">=0.5").otherwise("< 0.5"))
    shape = F.concat(F.lit("shape-"), b, F.when(F.col("p_size") % 3 == 2, "< 0.5").otherwise(">=0.5"))
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), F.array(look, shape).alias("conditions"),
                          F.when(F.col("p_size") > 25, "0.9").otherwise("0.8").alias("prob"))
    return C.readable_rules(rules, "conditions").select("rule_id", "rule", "prob")


@query("p32_rule_lines", """
SELECT p_partkey AS cover, concat(split_part(p_name, ' ', 2), ',brand ', lower(p_brand), ',type not ', lower(p_type)) AS rule, concat('0.', lpad(CAST(p_size % 100 AS VARCHAR), 2, '0')) AS prob
FROM part WHERE p_size % 2 = 1""")
def _(t):
    """Rule text as a tree writes it, to a file and back: readable rules of the class 1."""
    part = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    head = part("Rule number: ", F.col("p_partkey").cast("string"), " [class=", (F.col("p_size") % 2).cast("string"), " cover=", F.col("p_partkey").cast("string"), " (1%) prob=0.",
                F.lpad((F.col("p_size") % 100).cast("string"), 2, F.lit("0")), "]")
    name = F.lower(F.replace("p_brand", F.lit(" "), F.lit("_")))
    conditions = [part("type-", F.lower("p_type"), "< 0.5"), part("brand-", name, ">=0.5"), part("product_type-", F.split_part("p_name", F.lit(" "), F.lit(2)), ">=0.5")]
    path = scratch(t.spark)
    t.part.select(F.concat_ws("\n", F.lit(""), head, *[part("   ", c) for c in conditions]).alias("value")).write.text(path)
    rules = C.parse_rule_lines(numbered_lines(t.spark, path), [], "line_no", "value").where("label = 1")
    return C.readable_rules(rules, "conditions").select("cover", "rule", "prob")


@query("p33_group_name_parts", """
SELECT product_id, lower(gender) AS gender, product_type AS type, code AS dress_code FROM fx_products JOIN fx_product_codes USING (product_id)""")
def _(t):
    d = t.fx_products.join(t.fx_product_codes, "product_id")
    name = F.concat(F.lit("/data/"), "product_type", F.lit("#"), F.lower("gender"), F.lit("#dress_code_"), "code", F.lit(".csv"))
    parts = C.group_name_parts(name)
    return d.select("product_id", *[c.alias(n) for n, c in parts.items()])


@query("p34_count_value", """
SELECT sender_id, ts, CASE coalesce(positive_aspects, '') WHEN '' THEN 0 WHEN 'color,fit' THEN 2 ELSE 1 END AS n FROM fx_user""")
def _(t):
    a = X.pad_array(F.coalesce(F.split("positive_aspects", ","), F.array().cast("array<string>")), 3)
    return t.fx_user.select("sender_id", "ts", X.count_values(a).alias("n"))


@query("p35_count_actions", """
WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, action FROM fx_clicks),
l AS (SELECT user_id, list(action ORDER BY r) AS actions FROM o GROUP BY 1)
SELECT user_id, len(list_filter(actions, lambda x: x = 'click')) AS clicks, len(list_filter(actions, lambda x: x = 'add to cart')) AS adds FROM l""")
def _(t):
    from parlance.operators.sequence import action_counts
    return action_counts(t.fx_clicks, "user_id", ["ts", "event_id"], "action", {"clicks": "click", "adds": "add to cart"})
