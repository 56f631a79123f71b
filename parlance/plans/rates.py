"""Rates, shares, profiles and joins of conversation data (A, J)."""

from pyspark.sql import functions as F

from parlance.functions import expr as X
from parlance.functions.scan import lead, ordered
from parlance.operators import rates as R
from parlance.operators import rows as ROWS
from parlance.operators import sequence as S
from parlance.plans.registry import check_view, query
from parlance.plans.sequences import before_click, conversation, events_s, sessions
from parlance.sources.schemas import CHANNEL

CI = "round(1.96 * sqrt(avg({0}) * (1 - avg({0})) / nullif(count({0}), 0)), 6)"


def ci(x):
    return CI.format(x)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def outcomes(t):
    """One outcome row per user: the lowest conversation id."""
    o = ROWS.distinct_by_key(t.fx_outcomes, ["user_id"], ["conversation_id"])
    return o.select(F.col("user_id").alias("sender_id"), "conversation_id", "customer_type", "add_to_cart", "converted")


check_view("ck_out", """
SELECT user_id AS sender_id, conversation_id, customer_type, add_to_cart, converted FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conversation_id) AS r FROM fx_outcomes) WHERE r = 1""")
check_view("ck_turn_out", """
SELECT f.sender_id, f.ts, f.text, f.source, customer_type, add_to_cart, converted FROM (
SELECT sender_id, ts, text, 'first' AS source FROM (SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY ts) AS a FROM fx_user) WHERE a = 1
UNION ALL SELECT sender_id, ts, text, 'last' FROM (SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY ts DESC) AS a FROM fx_user) WHERE a = 1) f JOIN ck_out USING (sender_id)""")


def ends(t):
    u = t.fx_user.select("sender_id", "ts", "text")
    return ROWS.first_and_last(u, ["sender_id"], ["ts"]).join(outcomes(t), "sender_id").drop("conversation_id")


@query("j02_left_equi", """
SELECT sender_id, ts, src, customer_type, add_to_cart FROM ck_jnd LEFT JOIN ck_out USING (sender_id)""")
def _(t):
    return conversation(t).join(outcomes(t), "sender_id", "left").select("sender_id", "ts", "src", "customer_type", "add_to_cart")


@query("j03_inner_equi", "SELECT * FROM ck_turn_out")
def _(t):
    return ends(t)


@query("j04_two_key_inner", """
WITH s AS (SELECT c.*, CAST(sum(CASE WHEN g IS NULL OR g > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
 SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM ck_clicks) c)
SELECT b.sender_id, b.ts AS bot_ts, s.event_id, s.session FROM (SELECT sender_id, ts, 1 + ts % 5 AS session FROM fx_bot) b JOIN s ON s.user_id = b.sender_id AND s.session = b.session""")
def _(t):
    clicks = S.sessionise(t.fx_clicks.withColumn("ts", X.epoch_s("ts")), "user_id", "ts", ["event_id"])
    c = clicks.select(F.col("user_id").alias("sender_id"), "event_id", "session")
    b = t.fx_bot.select("sender_id", F.col("ts").alias("bot_ts"), (1 + F.col("ts") % 5).alias("session"))
    return b.join(c, ["sender_id", "session"]).select("sender_id", "bot_ts", "event_id", "session")


@query("j12_rank_align", """
WITH l AS (SELECT * FROM (SELECT col, val, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY col) AS share, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, val NULLS LAST) AS rank FROM (
  SELECT 'p_brand' AS col, p_brand AS val FROM part UNION ALL SELECT 'p_type', p_type FROM part) GROUP BY 1, 2) WHERE rank <= 40)
SELECT rank, max(val) FILTER (WHERE col = 'p_brand') AS p_brand_value, round(max(share) FILTER (WHERE col = 'p_brand'), 6) AS p_brand_share,
  max(val) FILTER (WHERE col = 'p_type') AS p_type_value, round(max(share) FILTER (WHERE col = 'p_type'), 6) AS p_type_share FROM l GROUP BY 1""")
def _(t):
    cols = ["p_brand", "p_type"]
    return rounded(R.rank_align(X.top_shares(t.part, cols), cols), "p_brand_share", "p_type_share")


@query("j14_id_semi", """
SELECT sender_id, ts, src FROM ck_union WHERE sender_id IN (SELECT sender_id FROM fx_bot WHERE response_code = 'yes_no')""")
def _(t):
    ids = S.holds_codes(t.fx_bot, "sender_id", "response_code", ["yes_no"])
    return S.interleave(t.fx_user, t.fx_bot).join(ids, "sender_id", "left_semi").select("sender_id", "ts", "src")


check_view("ck_profile", """
SELECT user_id AS sender_id, count(*) FILTER (WHERE action = 'click') AS clicks, count(*) FILTER (WHERE action = 'add to cart') AS adds, max(ts) AS last_ts FROM ck_clicks GROUP BY 1""")


def click_profile(t):
    """The cumulative state of each user's last click row, as one aggregation."""
    c = t.fx_clicks.withColumn("ts", X.epoch_s("ts"))
    return c.groupBy(F.col("user_id").alias("sender_id")).agg(
        F.count_if(F.col("action") == "click").alias("clicks"), F.count_if(F.col("action") == "add to cart").alias("adds"),
        F.max("ts").alias("last_ts"))


@query("j15_click_profile", "SELECT sender_id, ts, src, clicks, adds, last_ts FROM ck_jnd LEFT JOIN ck_profile USING (sender_id)")
def _(t):
    return conversation(t).join(click_profile(t), "sender_id", "left").select("sender_id", "ts", "src", "clicks", "adds", "last_ts")


@query("a01_count_share", """
SELECT source, text, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM ck_turn_out GROUP BY 1, 2""")
def _(t):
    return rounded(R.count_share(ends(t), ["source", "text"], ["source"]), "share")


@query("a02_rates_with_ci", f"""
SELECT source, text, count(add_to_cart) AS add_to_cart_n, round(avg(add_to_cart), 6) AS add_to_cart_mean, {ci('add_to_cart')} AS add_to_cart_ci,
  count(converted) AS converted_n, round(avg(converted), 6) AS converted_mean, {ci('converted')} AS converted_ci FROM ck_turn_out GROUP BY 1, 2""")
def _(t):
    r = R.rates(ends(t), ["source", "text"], ["add_to_cart", "converted"])
    return rounded(r, "add_to_cart_mean", "add_to_cart_ci", "converted_mean", "converted_ci")


@query("a03_rates_from_lists", f"""
SELECT customer_type, count(*) AS n, round(avg(converted), 6) AS mean, {ci('converted')} AS ci FROM fx_outcomes GROUP BY 1""")
def _(t):
    return rounded(R.rates(t.fx_outcomes, ["customer_type"], ["converted"]), "mean", "ci")


@query("a04_distinct_pairs", """
WITH h AS (SELECT CAST(ts // 3600 % 24 AS INT) AS hour, count(DISTINCT (user_id, session)) AS n FROM ck_session GROUP BY 1)
SELECT hour, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM h""")
def _(t):
    s = sessions(t)
    n = s.groupBy((F.floor(F.col("ts") / 3600) % 24).cast("int").alias("hour")).agg(F.countDistinct("user_id", "session").alias("n"))
    return R.share_of(n, "n", [], "pct").withColumn("pct", F.round(100 * F.col("pct"), 6))


@query("a05_distinct_profile", "SELECT count(DISTINCT p_name) AS p_name, count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type FROM part")
def _(t):
    return R.distinct_profile(t.part, ["p_name", "p_brand", "p_type"])


@query("a06_mean_std_nonzero", """
SELECT retailer_id, round(avg(transaction_value), 4) AS mean, round(stddev_samp(transaction_value), 4) AS std FROM fx_outcomes WHERE transaction_value <> 0 GROUP BY 1""")
def _(t):
    x = t.fx_outcomes.where(F.col("transaction_value") != 0)
    return x.groupBy("retailer_id").agg(F.round(F.avg("transaction_value"), 4).alias("mean"), F.round(F.stddev_samp("transaction_value"), 4).alias("std"))


@query("a07_session_stats", """
SELECT user_id, session, max(ts) - min(ts) AS duration, count(*) AS turns, round(avg(CASE WHEN gap < 21600 THEN gap END), 6) AS mean_gap FROM ck_session GROUP BY 1, 2""")
def _(t):
    return rounded(R.session_stats(sessions(t), ["user_id", "session"], "ts", "gap"), "mean_gap")


@query("a08_share_by_time", """
SELECT retailer_id, dayname(d) AS weekday, CAST(hour(d) AS INT) AS hour, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY retailer_id), 6) AS share FROM (
SELECT retailer_id, try_strptime(created_at, '%Y-%m-%d %H:%M:%S') AS d FROM fx_conv_raw) WHERE d IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    c = X.calendar_text("created_at")
    d = t.fx_conv_raw.select("retailer_id", c["weekday"].alias("weekday"), c["hour"].alias("hour")).where(F.col("hour").isNotNull())
    return rounded(R.count_share(d, ["retailer_id", "weekday", "hour"], ["retailer_id"]), "share")


@query("a09_monthly_distinct", """
SELECT retailer_id, substr(created_at, 1, 7) AS month, count(DISTINCT conversation_id) AS n FROM fx_conv_raw WHERE created_at <> 'bad date' GROUP BY 1, 2""")
def _(t):
    d = t.fx_conv_raw.where(X.calendar_text("created_at")["hour"].isNotNull())
    return d.groupBy("retailer_id", F.substring("created_at", 1, 7).alias("month")).agg(F.countDistinct("conversation_id").alias("n"))


@query("a10_pivot", """
SELECT retailer_id, count(*) FILTER (WHERE p = 'web') AS web, count(*) FILTER (WHERE p = 'app') AS app FROM (
SELECT retailer_id, json_extract_string(channel, '$.platform') AS p FROM fx_conv_raw) GROUP BY 1""")
def _(t):
    d = X.json_to_columns(t.fx_conv_raw.select("retailer_id", "channel"), "channel", CHANNEL)
    return R.crosstab(d, "retailer_id", "platform", ["web", "app"])


@query("a11_transitions", """
WITH e AS (SELECT b.sender_id, add_to_cart, coalesce(response_code, 'no_answer') AS "to", lag(coalesce(response_code, 'no_answer')) OVER (PARTITION BY b.sender_id ORDER BY ts) AS "from",
 row_number() OVER (PARTITION BY b.sender_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY b.sender_id) AS c FROM fx_bot b JOIN ck_out USING (sender_id))
SELECT "from", "to", count(*) AS n, CAST(sum(add_to_cart) AS BIGINT) AS conversions, round(sum(add_to_cart) * 1.0 / count(*), 6) AS weight FROM e WHERE r > 1 AND c >= 3 GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t):
    b = t.fx_bot.join(outcomes(t), "sender_id")
    return rounded(R.transitions(b, "sender_id", ["ts"], "response_code", "add_to_cart", min_support=2, min_turns=3), "weight")


check_view("ck_sender", """
SELECT sender_id, count(*) FILTER (WHERE src = 1) AS questions, CAST(sum(is_answered) AS BIGINT) AS answered, coalesce(max(clicks), 0) AS clicks, coalesce(max(adds), 0) AS adds, max(retailer_id) AS retailer_id
FROM ck_jnd LEFT JOIN ck_profile USING (sender_id) GROUP BY 1""")


def sender_profile(t):
    # turns are aggregated per sender before the join, so the join is one to one
    turns = conversation(t).groupBy("sender_id").agg(
        F.count_if(F.col("src") == 1).alias("questions"), F.sum("is_answered").alias("answered"), F.max("retailer_id").alias("retailer_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return turns.join(click_profile(t), "sender_id", "left").select("sender_id", "questions", "answered", zero("clicks"), zero("adds"), "retailer_id")


@query("a24_sender_profile", "SELECT * FROM ck_sender")
def _(t):
    return sender_profile(t)


@query("a25_outcome_by_bin", f"""
WITH b AS (SELECT retailer_id, CASE WHEN answered < 1 THEN '[0,1)' WHEN answered < 2 THEN '[1,2)' ELSE '[2,inf)' END AS bin, CAST(clicks > 5 AS INT) AS clicked, CAST(adds > 5 AS INT) AS added FROM ck_sender)
SELECT retailer_id, bin, count(*) AS clicked_n, round(avg(clicked), 6) AS clicked_mean, {ci('clicked')} AS clicked_ci, count(*) AS added_n, round(avg(added), 6) AS added_mean, {ci('added')} AS added_ci FROM b GROUP BY 1, 2""")
def _(t):
    p = sender_profile(t).select("retailer_id", X.cut("answered", [0, 1, 2]).alias("bin"),
                                 X.flag(F.col("clicks") > 5).alias("clicked"), X.flag(F.col("adds") > 5).alias("added"))
    return rounded(R.rates(p, ["retailer_id", "bin"], ["clicked", "added"]), "clicked_mean", "clicked_ci", "added_mean", "added_ci")


@query("a26_answer_rate_by_code", f"""
SELECT retailer_id, coalesce(response_code, 'no_answer') AS code, count(*) AS n, round(avg(is_answered), 6) AS mean, {ci('is_answered')} AS ci FROM ck_jnd WHERE src = 1 GROUP BY 1, 2""")
def _(t):
    q = conversation(t).where(F.col("src") == 1).withColumn("code", X.label_missing("response_code"))
    return rounded(R.rates(q, ["retailer_id", "code"], ["is_answered"]), "mean", "ci")


@query("a27_answer_rate_by_rank", f"""
SELECT lag_type, rc AS rank_code, count(*) AS n, round(avg(is_answered), 6) AS mean, {ci('is_answered')} AS ci FROM ck_types WHERE response_code IS NOT NULL AND lag_type IS NOT NULL GROUP BY 1, 2""")
def _(t):
    d = S.rank_in_type(conversation(t)).where(F.col("response_code").isNotNull() & F.col("lag_type").isNotNull())
    return rounded(R.rates(d, ["lag_type", "rank_code"], ["is_answered"]), "mean", "ci")


@query("a28_next_code_by_type", """
SELECT product_type, lead_code, count(*) AS n FROM (SELECT product_type, lead(response_code) OVER (PARTITION BY sender_id ORDER BY ts, src) AS lead_code FROM ck_union)
WHERE product_type IS NOT NULL AND lead_code IS NOT NULL GROUP BY 1, 2""")
def _(t):
    j = ordered(S.interleave(t.fx_user, t.fx_bot), ["sender_id"], S.ORDER, {"lead_code": lead("response_code")})
    return j.where(F.col("product_type").isNotNull() & F.col("lead_code").isNotNull()).groupBy("product_type", "lead_code").agg(F.count(F.lit(1)).alias("n"))


# fixed values: edges of the time-to-question bins
WAIT_EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 30, 60, 90]


@query("a29_answer_rate_by_wait", f"""
SELECT CASE WHEN time_from_start < 10 THEN concat('[', time_from_start, ',', time_from_start + 1, ')') WHEN time_from_start < 15 THEN '[10,15)' WHEN time_from_start < 20 THEN '[15,20)'
  WHEN time_from_start < 30 THEN '[20,30)' WHEN time_from_start < 60 THEN '[30,60)' WHEN time_from_start < 90 THEN '[60,90)' ELSE '[90,inf)' END AS bin,
  count(*) AS n, round(avg(is_answered), 6) AS mean, {ci('is_answered')} AS ci FROM ck_jnd WHERE src = 1 AND time_from_start > 0 GROUP BY 1""")
def _(t):
    q = conversation(t).where((F.col("src") == 1) & (F.col("time_from_start") > 0)).withColumn("bin", X.cut("time_from_start", WAIT_EDGES))
    return rounded(R.rates(q, ["bin"], ["is_answered"]), "mean", "ci")


@query("a41_last_question_stats", f"""
SELECT response_code, count(*) AS n, round(avg(is_answered), 6) AS mean, {ci('is_answered')} AS ci, round(avg(question_rank), 6) AS mean_rank,
  round(avg(CAST(question_rank = last_question AS INT)), 6) AS last_share FROM ck_jnd WHERE response_code IS NOT NULL GROUP BY 1""")
def _(t):
    q = conversation(t).where(F.col("response_code").isNotNull())
    g = q.groupBy("response_code").agg(*R.rate("is_answered"), F.avg("question_rank").alias("mean_rank"),
                                       F.avg((F.col("question_rank") == F.col("last_question")).cast("double")).alias("last_share"))
    return rounded(g, "mean", "ci", "mean_rank", "last_share")


@query("a45_collect_texts", """
SELECT sender_id, row_number() OVER (PARTITION BY sender_id ORDER BY ts) AS pos, message AS text FROM fx_user WHERE message IS NOT NULL""")
def _(t):
    return S.ordered_texts(t.fx_user.select("sender_id", "ts", F.col("message").alias("text")), "sender_id", ["ts"], "text")


@query("a48_last_code_by_outcome", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY sender_id) AS m FROM fx_bot)
SELECT which, add_to_cart, code, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY which, add_to_cart), 6) AS share FROM (
SELECT CASE WHEN r = m THEN 'last' ELSE 'before_last' END AS which, add_to_cart, coalesce(response_code, 'no_answer') AS code FROM b JOIN ck_out USING (sender_id) WHERE r >= m - 1) GROUP BY 1, 2, 3""")
def _(t):
    e = S.end_turns(t.fx_bot, "sender_id", ["ts"]).where(F.col("rank") >= F.col("max_rank") - 1)
    d = e.join(outcomes(t), "sender_id").select(F.when(F.col("rank") == F.col("max_rank"), "last").otherwise("before_last").alias("which"),
                                                "add_to_cart", X.label_missing("response_code").alias("code"))
    return rounded(R.count_share(d, ["which", "add_to_cart", "code"], ["which", "add_to_cart"]), "share")


@query("a49_share_by_click", """
SELECT click_flag, "column", "value", n, round(n * 1.0 / tot, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY click_flag, "column") AS tot FROM (
SELECT click_flag, 'product_type' AS "column", product_type AS "value", count(*) AS n FROM ck_before_click WHERE product_type IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT click_flag, 'subvertical', subvertical, count(*) FROM ck_before_click WHERE subvertical IS NOT NULL GROUP BY 1, 3)) WHERE n * 1.0 / tot >= 0.01""")
def _(t):
    cols = ["product_type", "subvertical"]
    long = before_click(t).select("click_flag", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("x"))
    long = long.select("click_flag", "x.*").where(F.col("value").isNotNull())
    s = R.count_share(long, ["click_flag", "column", "value"], ["click_flag", "column"])
    return rounded(s.where(F.col("share") >= 0.01), "share")


@query("a50_rate_by_type_code", f"""
SELECT lag_type, response_code, count(*) AS n, round(avg(is_answered), 6) AS mean, {ci('is_answered')} AS ci FROM ck_jnd WHERE lag_type IS NOT NULL AND response_code IS NOT NULL GROUP BY 1, 2""")
def _(t):
    d = conversation(t).where(F.col("lag_type").isNotNull() & F.col("response_code").isNotNull())
    return rounded(R.rates(d, ["lag_type", "response_code"], ["is_answered"]), "mean", "ci")


# the event stream by user and channel: automatic events come from senders that never click
check_view("ck_stream", """
SELECT concat(CAST(user_id AS VARCHAR), CASE WHEN event_type IN ('error', 'signup') THEN ':auto' ELSE ':own' END) AS sender_id, event_type FROM events""")


@query("a51_silent_senders", """
SELECT CAST(sender_id AS VARCHAR) AS sender_id, n FROM (SELECT sender_id, count(*) AS n, sum(is_answered) AS a FROM ck_jnd GROUP BY 1) LEFT JOIN ck_profile p USING (sender_id) WHERE n >= 5 AND a = 0 AND coalesce(clicks, 0) < 8
UNION ALL SELECT sender_id, count(*) AS n FROM ck_stream GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (WHERE event_type = 'click') = 0""")
def _(t):
    """Senders of conversations and of the event stream.  Conversations are short and every user
    of this data clicks, so for them silent means no answered question and few clicks."""
    turns = S.silent_senders(conversation(t), "sender_id", click_profile(t), 5, fewer_than=8, answered="is_answered")
    channel = F.when(F.col("event_type").isin("error", "signup"), ":auto").otherwise(":own")
    d = t.events.select(F.concat(F.col("user_id").cast("string"), channel).alias("sender_id"), "event_type")
    profile = d.groupBy("sender_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"))
    return turns.select(F.col("sender_id").cast("string").alias("sender_id"), "n").unionByName(S.silent_senders(d, "sender_id", profile))
