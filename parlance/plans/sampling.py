"""Samples, splits and weights (K), one-hot columns (M01, M02) and the model table (M15)."""

from pyspark.sql import functions as F

from parlance.operators import model_table as MT
from parlance.operators import sampling as S
from parlance.plans.rates import outcomes
from parlance.plans.registry import check_view, query
from parlance.plans.sequences import conversation


@query("k01_sample_n", "SELECT doc_id, label FROM fx_scores ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 60")
def _(t):
    return S.sample_n(t.fx_scores, "doc_id", 60, 42).select("doc_id", "label")


@query("k01_sample_weighted", """
SELECT doc_id, label FROM fx_scores WHERE score > 0 ORDER BY -ln((CAST(concat('0x', substr(md5(concat('42:', CAST(doc_id AS VARCHAR))), 1, 7)) AS BIGINT) + 1) / 268435457.0) / score, doc_id LIMIT 60""")
def _(t):
    return S.sample_n(t.fx_scores.where("score > 0"), "doc_id", 60, 42, weight="score").select("doc_id", "label")


check_view("ck_split", """
SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('1:', CAST(doc_id AS VARCHAR))), doc_id) AS pos, count(*) OVER (PARTITION BY label) AS size FROM fx_scores""")


@query("k02_stratified_split", """
SELECT doc_id, label, CASE WHEN pos <= floor(size * 0.2) THEN 'test' WHEN pos <= floor(size * 0.2) + floor((size - floor(size * 0.2)) * 0.3) THEN 'dev' ELSE 'train' END AS part FROM ck_split""")
def _(t):
    return S.stratified_split(t.fx_scores, "doc_id", "label").select("doc_id", "label", "part")


@query("k03_stratified_folds", "SELECT doc_id, label, CAST((pos - 1) % 3 AS INT) AS fold FROM ck_split")
def _(t):
    return S.stratified_folds(t.fx_scores, "doc_id", "label").select("doc_id", "label", "fold")


@query("k04_random_messages", "SELECT vec_id, intent FROM fx_vectors ORDER BY md5(concat('9:', CAST(vec_id AS VARCHAR))), vec_id LIMIT 25")
def _(t):
    return S.sample_n(t.fx_vectors.select("vec_id", "intent"), "vec_id", 25, 9)


@query("k05_smoothed_weights", """
SELECT p_name, n, round(share, 6) AS share, round(CASE WHEN share < 0.025 THEN share * 100 ELSE share END, 6) AS weight FROM (SELECT p_name, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM part GROUP BY 1)""")
def _(t):
    return S.smoothed_weights(t.part, "p_name", rare=0.025).withColumns({"share": F.round("share", 6), "weight": F.round("weight", 6)})


@query("m01_one_hot", """
SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INT) AS c_mktsegment_automobile, CAST(c_mktsegment = 'BUILDING' AS INT) AS c_mktsegment_building,
  CAST(c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING') AS INT) AS c_mktsegment_other FROM customer""")
def _(t):
    d = t.customer.select("c_custkey", F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.lower("c_mktsegment")).otherwise("other").alias("c_mktsegment"))
    return MT.one_hot(d, {"c_mktsegment": ["automobile", "building", "other"]})


@query("m02_inverse_one_hot", """
SELECT conversation_id, CASE WHEN add_to_cart = 1 THEN 'add_to_cart' WHEN converted = 1 THEN 'converted' END AS label FROM fx_outcomes""")
def _(t):
    return t.fx_outcomes.select("conversation_id", MT.inverse_one_hot(["add_to_cart", "converted"]).alias("label"))


check_view("ck_table", """
SELECT j.sender_id, j.ts, response_code, coalesce(last_code, 'none') AS last_code, last_product_type, customer_type, question_rank, time_from_start, sum_answer, num_quick_replies, is_answered,
  CAST(hour(make_timestamp(j.ts * 1000000)) AS INT) AS hour, CAST(isodow(make_timestamp(j.ts * 1000000)) AS INT) AS day_of_week
FROM ck_jnd j LEFT JOIN ck_out USING (sender_id) WHERE response_code IS NOT NULL AND response_code NOT IN (SELECT response_code FROM fx_bot WHERE replies = 'yes,no' AND response_code IS NOT NULL)""")
check_view("ck_top_type", """
SELECT last_product_type AS v FROM (SELECT last_product_type, count(*) * 1.0 / sum(count(*)) OVER () AS share, row_number() OVER (ORDER BY count(*) DESC, last_product_type NULLS LAST) AS r FROM ck_table GROUP BY 1) WHERE share >= 0.005 AND r <= 40 AND last_product_type IS NOT NULL""")


CODES, TYPES = ["color_question", "fit_question", "product_type_selection", "subvertical_selection"], ["jeans", "other", "pants", "shirt"]


@query("m15_model_table", f"""
SELECT sender_id, ts, is_answered, {", ".join(f"CAST(response_code = '{c}' AS INT) AS response_code_{c}" for c in CODES)},
  {", ".join(f"CAST(CASE WHEN last_product_type IN (SELECT v FROM ck_top_type) THEN last_product_type ELSE 'other' END = '{c}' AS INT) AS last_product_type_{c}" for c in TYPES)},
  customer_type, CAST(question_rank AS DOUBLE) AS question_rank, CAST(time_from_start AS DOUBLE) AS time_from_start, CAST(coalesce(sum_answer, 0) AS DOUBLE) AS sum_answer,
  CAST(num_quick_replies AS DOUBLE) AS num_quick_replies, CAST(hour AS DOUBLE) AS hour, CAST(day_of_week AS DOUBLE) AS day_of_week FROM ck_table WHERE time_from_start <= 500""")
def _(t):
    """Every value of the bucketed data has its column; the check lists those of this data."""
    return MT.model_table(conversation(t), outcomes(t), ["response_code", "last_product_type"], keep=["customer_type"])
