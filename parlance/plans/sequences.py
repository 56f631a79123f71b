"""Event sequences (W) and interleaving (J01)."""

from pyspark.sql import functions as F

from parlance.functions import expr as X
from parlance.functions.scan import lag, lead, ordered, running, total
from parlance.operators import sequence as S
from parlance.plans.registry import check_view, query


def conversation(t):
    return S.conversation_features(S.interleave(t.fx_user, t.fx_bot))


def events_s(t):
    return t.events.withColumn("ts", X.epoch_s("ts"))


check_view("ck_events", "SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type, value FROM events")
check_view("ck_clicks", "SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, action FROM fx_clicks")
check_view("ck_union", """
SELECT sender_id, retailer_id, ts, 0 AS src, text, positive_aspects, subvertical, product_type, NULL AS response_code, NULL AS replies FROM fx_user
UNION ALL SELECT sender_id, retailer_id, ts + next_response_time, 1, NULL, NULL, NULL, NULL, response_code, replies FROM fx_bot""")
check_view("ck_answers", """
SELECT *, lag(product_type) OVER w AS lag_type,
  CASE WHEN replies IS NULL THEN 0
    WHEN coalesce(list_contains(string_split(replies, ','), lead(text) OVER w), false) OR coalesce(list_contains(string_split(replies, ','), lead(text, 2) OVER w), false) THEN 1
    WHEN response_code = 'color_question' AND NOT list_contains(string_split(lag(positive_aspects) OVER w, ','), 'color')
      AND list_contains(string_split(lead(positive_aspects) OVER w, ','), 'color') THEN 1
    WHEN response_code IN ('subvertical_selection', 'subvertical_selection_second') AND lag(subvertical) OVER w IS NULL AND lead(subvertical) OVER w IS NOT NULL THEN 1
    WHEN response_code = 'product_type_selection' AND lag(product_type) OVER w IS NULL AND (lead(product_type) OVER w IS NOT NULL OR lead(product_type, 2) OVER w IS NOT NULL) THEN 1
    ELSE 0 END AS is_answered,
  CAST(sum(CASE WHEN response_code IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS question_rank,
  ts - min(ts) OVER w AS time_from_start,
  last_value(response_code IGNORE NULLS) OVER (PARTITION BY sender_id ORDER BY ts, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_code,
  last_value(positive_aspects IGNORE NULLS) OVER w AS last_aspects, last_value(subvertical IGNORE NULLS) OVER w AS last_subvertical,
  last_value(product_type IGNORE NULLS) OVER w AS last_product_type, coalesce(len(string_split(replies, ',')), 0) AS num_quick_replies
FROM ck_union WINDOW w AS (PARTITION BY sender_id ORDER BY ts, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
check_view("ck_jnd", """
SELECT *, CAST(sum(is_answered) OVER (PARTITION BY sender_id ORDER BY ts, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS sum_answer,
  max(question_rank) OVER (PARTITION BY sender_id) AS last_question FROM ck_answers""")
check_view("ck_session", """
SELECT *, CAST(sum(is_start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
SELECT *, CASE WHEN gap IS NULL OR gap > 21600 THEN 1 ELSE 0 END AS is_start FROM (
SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM ck_events))""")


@query("w01_sessionise", "SELECT event_id, user_id, ts, gap, is_start, session FROM ck_session")
def sessions(t):
    return S.sessionise(events_s(t), "user_id", "ts", ["event_id"]).select("event_id", "user_id", "ts", "gap", "is_start", "session")


@query("w02_first_last", """
SELECT sender_id, ts, response_code, CASE WHEN r = 1 THEN 'first' WHEN r = m THEN 'last' ELSE 'before_last' END AS which FROM (
SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY sender_id) AS m FROM fx_bot) WHERE r = 1 OR r >= m - 1""")
def _(t):
    e = S.end_turns(t.fx_bot.select("sender_id", "ts", "response_code"), "sender_id", ["ts"])
    r, m = F.col("rank"), F.col("max_rank")
    return e.where((r == 1) | (r >= m - 1)).select("sender_id", "ts", "response_code",
        F.when(r == 1, "first").when(r == m, "last").otherwise("before_last").alias("which"))


@query("w03_question_rank", "SELECT sender_id, ts, src, question_rank FROM ck_jnd")
def _(t):
    j = S.interleave(t.fx_user, t.fx_bot)
    return ordered(j, ["sender_id"], S.ORDER, {"question_rank": running(X.flag(F.col("response_code").isNotNull()))}).select(
        "sender_id", "ts", "src", "question_rank")


@query("w04_time_from_start", "SELECT sender_id, ts, src, time_from_start FROM ck_jnd")
def _(t):
    j = ordered(S.interleave(t.fx_user, t.fx_bot), ["sender_id"], S.ORDER, {"first": running("ts", "min")})
    return j.select("sender_id", "ts", "src", (F.col("ts") - F.col("first")).alias("time_from_start"))


@query("w05_answered_before", "SELECT sender_id, ts, src, sum_answer FROM ck_jnd")
def _(t):
    return conversation(t).select("sender_id", "ts", "src", "sum_answer")


@query("w06_last_known", "SELECT sender_id, ts, src, last_code, last_aspects, last_subvertical, last_product_type FROM ck_jnd")
def _(t):
    return conversation(t).select("sender_id", "ts", "src", "last_code", F.array_join("last_aspects", ",").alias("last_aspects"),
                                  "last_subvertical", "last_product_type")


@query("w07_lead_lag", """
SELECT sender_id, ts, src, lead(text) OVER w AS next1, lead(text, 2) OVER w AS next2, lag(subvertical) OVER w AS prev
FROM ck_union WINDOW w AS (PARTITION BY sender_id ORDER BY ts, src)""")
def _(t):
    j = ordered(S.interleave(t.fx_user, t.fx_bot), ["sender_id"], S.ORDER,
                {"next1": lead("text"), "next2": lead("text", 2), "prev": lag("subvertical")})
    return j.select("sender_id", "ts", "src", "next1", "next2", "prev")


@query("w08_is_answered", "SELECT sender_id, ts, response_code, is_answered FROM ck_jnd WHERE src = 1")
def _(t):
    return conversation(t).where(F.col("src") == 1).select("sender_id", "ts", "response_code", "is_answered")


@query("w09_running_lists", """
SELECT user_id, event_id, concat_ws('>', lag(action) OVER (PARTITION BY user_id ORDER BY ts, event_id), action) AS last_two,
  count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ck_clicks""")
def _(t):
    c = ordered(t.fx_clicks.withColumn("ts", X.epoch_s("ts")), ["user_id"], ["ts", "event_id"],
                {"prev": lag("action"), "n": running(F.lit(1), "count")})
    return c.select("user_id", "event_id", F.concat_ws(">", "prev", "action").alias("last_two"), "n")


check_view("ck_types", """
SELECT *, concat(CAST(type_rank AS VARCHAR), '_', response_code) AS rc FROM (
SELECT *, CAST(sum(CASE WHEN response_code IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY sender_id, lag_type ORDER BY ts, src ROWS UNBOUNDED PRECEDING) AS BIGINT) AS type_rank FROM ck_jnd)""")


@query("w10_rank_in_type", """
SELECT sender_id, ts, lag_type, type_rank, CASE WHEN response_code IS NOT NULL THEN rc END AS rank_code FROM ck_types""")
def ranked(t):
    return S.rank_in_type(conversation(t)).select("sender_id", "ts", "lag_type", "type_rank", "rank_code")


@query("w11_first_click", """
SELECT event_id, user_id, min(CASE WHEN action = 'click' THEN ts END) OVER (PARTITION BY user_id) AS first_click FROM ck_clicks""")
def _(t):
    c = t.fx_clicks.withColumn("ts", X.epoch_s("ts"))
    return c.join(S.first_clicks(c, "user_id", "ts"), "user_id", "left").select("event_id", "user_id", "first_click")


@query("w12_top_values", """
SELECT * FROM (SELECT col AS "column", val AS "value", count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY col), 6) AS share,
  row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, val NULLS LAST) AS rank FROM (
  SELECT 'p_name' AS col, p_name AS val FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part) GROUP BY 1, 2) WHERE rank <= 40""")
def _(t):
    return X.top_shares(t.part, ["p_name", "p_brand", "p_type"], 40).withColumn("share", F.round("share", 6))


@query("w13_partition_total", "SELECT sender_id, ts, src, count(response_code) OVER (PARTITION BY sender_id) AS questions FROM ck_union")
def _(t):
    return ordered(S.interleave(t.fx_user, t.fx_bot), ["sender_id"], S.ORDER, {"questions": total("response_code", "count")}).select(
        "sender_id", "ts", "src", "questions")


check_view("ck_first", "SELECT user_id AS sender_id, min(ts) AS fc FROM ck_clicks WHERE action = 'click' GROUP BY 1")
check_view("ck_before_click", """
SELECT sender_id, ts, text, product_type, subvertical, CASE WHEN fc IS NULL THEN 'no_click' ELSE 'click' END AS click_flag FROM (
SELECT u.*, fc, row_number() OVER (PARTITION BY u.sender_id ORDER BY ts DESC) AS r FROM fx_user u LEFT JOIN ck_first f USING (sender_id) WHERE fc IS NULL OR ts <= fc) WHERE r = 1""")


def before_click(t):
    clicks = t.fx_clicks.withColumn("ts", X.epoch_s("ts")).withColumnRenamed("user_id", "sender_id")
    turns = t.fx_user.select("sender_id", "ts", "text", "product_type", "subvertical")
    return S.last_before_click(turns, S.first_clicks(clicks, "sender_id", "ts"), "sender_id", "ts")


@query("w14_last_before_click", "SELECT sender_id, ts, text, click_flag FROM ck_before_click")
def _(t):
    return before_click(t).select("sender_id", "ts", "text", "click_flag")


@query("w15_time_to_question", "SELECT sender_id, ts, time_from_start AS time_to_q FROM ck_jnd WHERE src = 1")
def _(t):
    j = ordered(S.interleave(t.fx_user, t.fx_bot), ["sender_id"], S.ORDER, {"lo": running("ts", "min"), "hi": running("ts", "max")})
    return j.where(F.col("src") == 1).select("sender_id", "ts", (F.col("hi") - F.col("lo")).alias("time_to_q"))


@query("w16_group_transform", "SELECT sender_id, ts, src, last_question AS max_rank, CAST(question_rank = last_question AS INT) AS is_last FROM ck_jnd")
def _(t):
    return conversation(t).select("sender_id", "ts", "src", F.col("last_question").alias("max_rank"),
                                  X.flag(F.col("question_rank") == F.col("last_question")).alias("is_last"))


LAST = ["response_code", "subvertical", "product_type"]
LAST_N = ", ".join(f"CASE WHEN coalesce(len({c}_l), 0) >= {3 - j} THEN {c}_l[len({c}_l) - {2 - j}] ELSE 'None' END AS {c}_{j}" for c in LAST for j in range(3))


@query("w17_last_n_features", f"""
WITH l AS (SELECT sender_id, ts, src, {", ".join(f"list_filter(list({c}) OVER w, lambda x: x IS NOT NULL) AS {c}_l" for c in LAST)} FROM ck_union
 WINDOW w AS (PARTITION BY sender_id ORDER BY ts, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT sender_id, ts, src, {LAST_N} FROM l""")
def _(t):
    j = S.interleave(t.fx_user, t.fx_bot).select("sender_id", "ts", "src", *LAST)
    return S.last_n_features(j, "sender_id", S.ORDER, LAST).drop(*LAST)


@query("w18_typing_noise", """
WITH k AS (SELECT sender_id, ts, x FROM (SELECT *, message AS x, lead(message) OVER (PARTITION BY sender_id ORDER BY ts) AS nx FROM fx_user) WHERE nx IS NULL OR NOT contains(nx, x))
SELECT sender_id, ts, x AS text FROM k WHERE sender_id IN (SELECT sender_id FROM k GROUP BY 1 HAVING count(*) = 1)""")
def _(t):
    return S.typing_noise(t.fx_user.select("sender_id", "ts", F.col("message").alias("text")), "sender_id", ["ts"], "text")


@query("w19_previous_value", "SELECT sender_id, ts, src, lag_type, lag(ts) OVER (PARTITION BY sender_id ORDER BY ts, src) AS lag_ts FROM ck_jnd")
def _(t):
    return ordered(S.interleave(t.fx_user, t.fx_bot), ["sender_id"], S.ORDER, {"lag_type": lag("product_type"), "lag_ts": lag("ts")}).select(
        "sender_id", "ts", "src", "lag_type", "lag_ts")


@query("w20_sequence_contains", """
SELECT sender_id FROM fx_bot GROUP BY 1 HAVING bool_or(coalesce(response_code = 'color_question', false)) AND bool_or(coalesce(response_code = 'yes_no', false))""")
def _(t):
    return S.holds_codes(t.fx_bot, "sender_id", "response_code", ["color_question", "yes_no"])


@query("j01_interleave", "SELECT sender_id, retailer_id, ts, src, text, response_code FROM ck_union")
def _(t):
    return S.interleave(t.fx_user, t.fx_bot).select("sender_id", "retailer_id", "ts", "src", "text", "response_code")
