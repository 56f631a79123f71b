"""Classification and ranking metrics (A19-A22, A31-A38, A47, A52, A54)."""

from pyspark.sql import functions as F

from parlance.functions import expr as X
from parlance.functions import metrics as M
from parlance.operators import rates as R
from parlance.plans.registry import check_view, query
from parlance.plans.rates import rounded

check_view("ck_hist", "SELECT score, count(*) AS n, CAST(sum(label) AS BIGINT) AS tp FROM fx_scores GROUP BY 1")
check_view("ck_cum", """
SELECT score, n, tp, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(tp) OVER w AS BIGINT) AS cum_tp, CAST(sum(n) OVER () AS BIGINT) AS total_n, CAST(sum(tp) OVER () AS BIGINT) AS total_tp FROM ck_hist WINDOW w AS (ORDER BY score DESC)""")


def pred(t):
    return t.fx_scores.withColumn("pred", X.flag(F.col("score") >= 0.5))


@query("a19_crosstab", """
SELECT label, count(*) FILTER (WHERE score < 0.5) AS "0", count(*) FILTER (WHERE score >= 0.5) AS "1" FROM fx_scores GROUP BY 1""")
def _(t):
    return R.crosstab(pred(t), "label", "pred", [0, 1])


@query("a20_class_report", """
WITH d AS (SELECT CAST(label AS VARCHAR) AS l, CASE WHEN score >= 0.5 THEN '1' ELSE '0' END AS p FROM fx_scores),
c AS (SELECT v AS class, (SELECT count(*) FROM d WHERE l = v AND p = v) AS hit, (SELECT count(*) FROM d WHERE p = v) AS predicted, (SELECT count(*) FROM d WHERE l = v) AS support FROM (VALUES ('0'), ('1')) x(v)),
r AS (SELECT class, hit, support, hit * 1.0 / predicted AS precision, hit * 1.0 / support AS recall FROM c),
f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM r)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) * 1.0 / sum(support), 6), round(sum(hit) * 1.0 / sum(support), 6), round(sum(hit) * 1.0 / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def _(t):
    return rounded(M.class_report(pred(t), "label", "pred"), "precision", "recall", "f1")


@query("a21_confusion_at", """
WITH m AS (SELECT 'median' AS cut, median(score) AS v FROM fx_scores UNION ALL SELECT 'mean', avg(score) FROM fx_scores)
SELECT cut, label, CAST(score > v AS INT) AS pred, count(*) AS n FROM fx_scores CROSS JOIN m GROUP BY 1, 2, 3""")
def _(t):
    s = t.fx_scores
    cuts = M.exact_quantile(s, "score", 0.5, "v").select(F.lit("median").alias("cut"), "v").unionByName(
        s.agg(F.avg("score").alias("v")).select(F.lit("mean").alias("cut"), "v"))
    cuts = cuts.groupBy(F.lit(1).alias("_k")).agg(F.collect_list(F.struct("cut", "v")).alias("_c"))  # two thresholds
    d = s.withColumn("_k", F.lit(1)).join(F.broadcast(cuts), "_k").select("label", "score", F.explode("_c").alias("c"))
    return d.groupBy("c.cut", "label", X.flag(F.col("score") > F.col("c.v")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("a22_chi_square", """
WITH d AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS v, CAST(c_custkey % 11 = 0 AS INT) AS t FROM customer
 UNION ALL SELECT 'add_to_cart', CAST(CAST(c_custkey % 4 = 0 AS INT) AS VARCHAR), CAST(c_custkey % 11 = 0 AS INT) FROM customer),
o AS (SELECT "column", v, t, count(*) AS o FROM d GROUP BY 1, 2, 3), r AS (SELECT "column", v, sum(o) AS rn FROM o GROUP BY 1, 2), c AS (SELECT "column", t, sum(o) AS cn FROM o GROUP BY 1, 2),
n AS (SELECT "column", sum(rn) AS n, count(*) AS k FROM r GROUP BY 1),
g AS (SELECT r."column", k, coalesce(o.o, 0) AS o, rn * cn * 1.0 / n AS e FROM r JOIN c USING ("column") JOIN n USING ("column") LEFT JOIN o ON o."column" = r."column" AND o.v = r.v AND o.t = c.t)
SELECT "column", round(sum(CASE WHEN k = 2 THEN pow(greatest(abs(o - e) - 0.5, 0), 2) ELSE pow(o - e, 2) END / e), 6) AS chi2, max(k - 1) AS dof FROM g GROUP BY 1""")
def _(t):
    d = t.customer.select("c_mktsegment", X.flag(F.col("c_custkey") % 4 == 0).alias("add_to_cart"), X.flag(F.col("c_custkey") % 11 == 0).alias("t"))
    return rounded(M.chi_square(d, ["c_mktsegment", "add_to_cart"], "t"), "chi2").orderBy(F.desc("chi2"), "column")


check_view("ck_judged", "SELECT doc_id, grp AS intent, score AS sim_score, CAST((doc_id * 7 + label) % 4 AS INT) AS score FROM fx_scores")


def judged(t):
    return t.fx_scores.select("doc_id", F.col("grp").alias("intent"), F.col("score").alias("sim_score"),
                              ((F.col("doc_id") * 7 + F.col("label")) % 4).cast("int").alias("score"))


@query("a31_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY sim_score) + (count(*) OVER (PARTITION BY sim_score) - 1) / 2.0 AS rx, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ry FROM ck_judged),
g AS (SELECT intent, rank() OVER (PARTITION BY intent ORDER BY sim_score) + (count(*) OVER (PARTITION BY intent, sim_score) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY intent ORDER BY score) + (count(*) OVER (PARTITION BY intent, score) - 1) / 2.0 AS ry FROM ck_judged)
SELECT CAST(intent AS VARCHAR) AS intent, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM g GROUP BY 1 UNION ALL SELECT 'all', round(corr(rx, ry), 6), count(*) FROM r""")
def _(t):
    j = judged(t)
    per = M.spearman(j, "sim_score", "score", ["intent"]).withColumn("intent", F.col("intent").cast("string"))
    return rounded(per.unionByName(M.spearman(j, "sim_score", "score").withColumn("intent", F.lit("all"))), "rho")


@query("a32_precision_at_score", """
SELECT intent, count(*) FILTER (WHERE score = 0) AS s0, count(*) FILTER (WHERE score = 1) AS s1, count(*) FILTER (WHERE score = 2) AS s2, count(*) FILTER (WHERE score = 3) AS s3,
  round(avg(CAST(score > 0 AS INT)), 6) AS tp_1, round(avg(CAST(score > 1 AS INT)), 6) AS tp_2 FROM ck_judged WHERE sim_score >= 0.2 GROUP BY 1""")
def _(t):
    j = judged(t).where(F.col("sim_score") >= 0.2)
    return j.groupBy("intent").agg(*[F.count_if(F.col("score") == i).alias(f"s{i}") for i in range(4)],
                                   *[F.round(F.avg((F.col("score") > i).cast("double")), 6).alias(f"tp_{i + 1}") for i in range(2)])


AP = "round(sum(tp * 1.0 / total_tp * cum_tp / cum_n), 6)"
AUC = "round((sum(tp * (total_n - cum_n + (n + 1) / 2.0)) - max(total_tp) * (max(total_tp) + 1) / 2.0) / (max(total_tp) * 1.0 * (max(total_n) - max(total_tp))), 6)"


@query("a33_average_precision", f"SELECT {AP} AS ap, max(total_n) AS n FROM ck_cum")
def _(t):
    return M.ap_auc(t.fx_scores, "score", "label").select(F.round("ap", 6).alias("ap"), "n")


@query("a34_roc_auc", f"SELECT {AUC} AS auc, max(total_tp) AS positives FROM ck_cum")
def _(t):
    return M.ap_auc(t.fx_scores, "score", "label").select(F.round("auc", 6).alias("auc"), "positives")


@query("a35_curves", """
SELECT round(score, 6) AS threshold, round(cum_tp * 1.0 / cum_n, 6) AS precision, round(cum_tp * 1.0 / total_tp, 6) AS recall, round((cum_n - cum_tp) * 1.0 / (total_n - total_tp), 6) AS fpr FROM ck_cum""")
def _(t):
    c = M.curve(t.fx_scores, "score", "label")
    return c.select(F.round("score", 6).alias("threshold"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "fpr")])


@query("a36_top_n_metric", f"""
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM fx_scores) WHERE r <= (SELECT sum(label) FROM fx_scores)),
h AS (SELECT score, count(*) AS n, sum(label) AS tp FROM t GROUP BY 1),
c AS (SELECT score, n, tp, sum(n) OVER w AS cum_n, sum(tp) OVER w AS cum_tp, sum(n) OVER () AS total_n, sum(tp) OVER () AS total_tp FROM h WINDOW w AS (ORDER BY score DESC))
SELECT {AP} AS ap, {AUC} AS auc, CAST(max(total_n) AS BIGINT) AS n FROM c""")
def _(t):
    m = M.ap_auc(M.top_n(t.fx_scores, "score", "label", ["doc_id"]), "score", "label")
    return m.select(F.round("ap", 6).alias("ap"), F.round("auc", 6).alias("auc"), "n")


GROUPED = """
h AS (SELECT grp, score, count(*) AS n, sum(label) AS tp FROM t GROUP BY 1, 2),
c AS (SELECT grp, score, n, tp, sum(n) OVER w AS cum_n, sum(tp) OVER w AS cum_tp, sum(n) OVER (PARTITION BY grp) AS total_n, sum(tp) OVER (PARTITION BY grp) AS total_tp FROM h WINDOW w AS (PARTITION BY grp ORDER BY score DESC)),
m AS (SELECT grp, sum(tp * 1.0 / total_tp * cum_tp / cum_n) AS ap, (sum(tp * (total_n - cum_n + (n + 1) / 2.0)) - max(total_tp) * (max(total_tp) + 1) / 2.0) / nullif(max(total_tp) * 1.0 * (max(total_n) - max(total_tp)), 0) AS auc FROM c GROUP BY 1)"""


@query("a37_metric_per_group", f"""
WITH t AS (SELECT * FROM fx_scores), {GROUPED} SELECT 'all' AS rows_used, round(avg(ap), 6) AS mean_ap, round(avg(auc), 6) AS mean_auc, count(*) AS groups FROM m""")
def _(t):
    m = M.mean_per_group(t.fx_scores, "score", "label", ["grp"], ["doc_id"])
    return rounded(m, "mean_ap", "mean_auc").withColumn("rows_used", F.lit("all"))


@query("a37_metric_per_group_at_k", f"""
WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) AS r FROM fx_scores) WHERE r <= 30), {GROUPED}
SELECT round(avg(ap), 6) AS mean_ap, round(avg(auc), 6) AS mean_auc, count(*) AS groups FROM m""")
def _(t):
    return rounded(M.mean_per_group(t.fx_scores, "score", "label", ["grp"], ["doc_id"], k=30), "mean_ap", "mean_auc")


@query("a38_calibration", """
SELECT CAST(floor(score / ((1 + 1e-8) / 20)) + 1 AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positives FROM fx_scores GROUP BY 1""")
def _(t):
    b = t.fx_scores.withColumn("bin", X.equal_bins("score", 0, 1 + 1e-8, 20))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("positives"))


@query("a38_score_histogram", """
SELECT CAST(least(floor((score - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n FROM fx_scores CROSS JOIN (SELECT min(score) AS lo, max(score) AS hi FROM fx_scores) GROUP BY 1""")
def _(t):
    return R.histogram(t.fx_scores, "score", 50)


@query("a43_length_stats", """
WITH l AS (SELECT len(string_split(text, ' ')) AS w FROM fx_texts), e AS (SELECT min(w) AS lo, max(w) AS hi, avg(w) AS mean FROM l)
SELECT CAST(least(floor((w - lo) * 1.0 / (hi - lo) * 10), 9) AS INT) AS bin, count(*) AS n, max(lo) AS lo, max(hi) AS hi, round(max(mean), 6) AS mean FROM l CROSS JOIN e GROUP BY 1""")
def _(t):
    w = t.fx_texts.select(F.size(F.split("text", " ")).cast("long").alias("w"))
    stats = w.agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.round(F.avg("w"), 6).alias("mean")).withColumn("_k", F.lit(1))
    return R.histogram(w, "w", 10).withColumn("_k", F.lit(1)).join(F.broadcast(stats), "_k").drop("_k")  # one row


@query("a47_correlations", """
SELECT 'l_quantity' AS "column", round(corr(l_quantity, CAST(l_returnflag = 'R' AS INT)), 6) AS corr FROM lineitem
UNION ALL SELECT 'l_extendedprice', round(corr(l_extendedprice, CAST(l_returnflag = 'R' AS INT)), 6) FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, CAST(l_returnflag = 'R' AS INT)), 6) FROM lineitem""")
def _(t):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    c = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    one = t.lineitem.agg(*[F.corr(x, c).alias(x) for x in cols])
    return one.unpivot([], cols, "column", "corr").withColumn("corr", F.round("corr", 6)).orderBy(F.desc("corr"))


@query("a52_weighted_accuracy", """
SELECT grp, round(sum(weight * CAST((score >= 0.5) = (label = 1) AS INT)) * 1.0 / sum(weight), 6) AS accuracy, round(sum(weight * abs(label - score)) / sum(weight), 6) AS loss FROM fx_scores GROUP BY 1""")
def _(t):
    hit = (F.col("score") >= 0.5) == (F.col("label") == 1)
    return rounded(M.weighted_accuracy(t.fx_scores, hit, F.abs(F.col("label") - F.col("score")), "weight", ["grp"]), "accuracy", "loss")


@query("a54_misclassified", """
SELECT doc_id, CASE label WHEN 1 THEN 'good' ELSE 'bad' END AS label_name, CASE WHEN score >= 0.5 THEN 'good' ELSE 'bad' END AS pred_name FROM fx_scores WHERE (score >= 0.5) <> (label = 1)""")
def _(t):
    names = t.spark.range(2).select(F.col("id").cast("int").alias("label"), F.when(F.col("id") == 1, "good").otherwise("bad").alias("label_name"))
    d = pred(t).where(F.col("pred") != F.col("label")).join(F.broadcast(names), "label")  # one row per class
    d = d.join(F.broadcast(names.toDF("pred", "pred_name")), "pred")
    return d.select("doc_id", "label_name", "pred_name")
