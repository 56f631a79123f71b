"""Model jobs (M, T06).  Model output has no SQL check; row counts and tests cover it."""

from pyspark.sql import functions as F

from parlance.functions import metrics as MET
from parlance.functions import text as TX
from parlance.operators import catalogue as C
from parlance.operators import models as M
from parlance.operators import model_table as MT
from parlance.operators import rule_mining as RM
from parlance.operators import topic_model as TM
from parlance.operators.sampling import stratified_split
from parlance.operators.textjobs import label_ids
from parlance.plans import catalogue as PC
from parlance.plans.rates import outcomes, rounded
from parlance.plans.registry import query
from parlance.plans.sequences import conversation
from parlance.session import pinned

CODES = ["color_question", "fit_question", "product_type_selection", "subvertical_selection"]
CATEGORIES = {"response_code": CODES, "last_product_type": ["shirt", "jeans", "pants", "other"]}


def table(t):
    """The model table with a row key; every category column is one-hot."""
    m = MT.model_table(conversation(t), outcomes(t), CATEGORIES)
    m = m.withColumn("key", F.concat_ws(":", "sender_id", "ts")).withColumnRenamed("is_answered", "label")
    names = [f"{c}_{v}" for c, vs in CATEGORIES.items() for v in vs] + MT.NUMBERS
    return m, names


def features(t):
    m, names = table(t)
    return M.assemble(m, names).select("key", "label", "features"), names


@query("m03_boosted_trees_cv")
def _(t):
    d, _names = features(t)
    return rounded(M.boosted_trees_cv(d, "key"), "auc", digits=4)


@query("m04_weighted_trees")
def _(t):
    """Scores of the held-out rows."""
    d, _names = features(t)
    d = M.held_out(d, "key")
    s = M.positive_probability(M.weighted_trees(d).transform(d.where("held_out")))
    return s.select("key", "label", F.round("p", 6).alias("p"))


@query("m04_held_out_auc")
def _(t):
    """AP and AUC of the same model on the rows it was fitted on and on the held-out rows."""
    d, _names = features(t)
    d = M.held_out(d, "key")
    s = M.positive_probability(M.weighted_trees(d).transform(d)).withColumn("part", F.when(F.col("held_out"), "test").otherwise("train"))
    return rounded(MET.ap_auc(s.select("part", "p", "label"), "p", "label", ["part"]).select("part", "ap", "auc", "n"), "ap", "auc", digits=4)


@query("t06_top_features")
def _(t):
    d, names = features(t)
    first = M.top_features(M.weighted_trees(M.held_out(d, "key")), names, 20)
    keep = [n for n, _ in first[:3]] or names[:1]
    m, _names = table(t)
    again = M.weighted_trees(M.held_out(M.assemble(m, keep).select("key", "label", "features"), "key"))
    rows = [("all", n, v) for n, v in first] + [("top 3", n, v) for n, v in M.top_features(again, keep, 3)]
    return t.spark.createDataFrame(rows, "model string, feature string, importance double")


@query("m05_multiclass")
def _(t):
    """Which of the question codes was asked: fitted on answered turns, reported on held-out
    answered turns and on all unanswered ones."""
    m, _names = table(t)
    m = m.withColumn("answered", F.col("label")).withColumn("label", sum(F.col(f"response_code_{c}") * (i + 1) for i, c in enumerate(CODES)).cast("double"))
    x = M.assemble(m, [f"last_product_type_{v}" for v in CATEGORIES["last_product_type"]] + MT.NUMBERS).select("key", "answered", "label", "features")
    x = M.held_out(x, "key")
    seen = (F.col("answered") == 1) & ~F.col("held_out")
    p = pinned(M.multiclass(x.where(seen), x.where(~seen)).select("label", "prediction", "answered"))
    parts = [MET.class_report(p.where(F.col("answered") == a), "label", "prediction").withColumn("answered", F.lit(a)) for a in (0, 1)]
    return rounded(parts[0].unionByName(parts[1]), "precision", "recall", "f1", digits=4)


@query("m06_logistic")
def _(t):
    ids = label_ids(t.documents, "lang", "doc_id").withColumnRenamed("id", "label")
    # the whole texts are dealt to the parts and made trigrams there, which are many times as large
    d = stratified_split(t.texts.select("doc_id", "lang", "text"), "doc_id", "lang").join(F.broadcast(ids), "lang")  # a row for each language
    d = d.select("part", "label", TX.label_trigrams(TX.clean_text("text")).alias("grams"))
    p = M.text_classifier(d.where("part = 'train'"), d.where("part = 'test'"), "grams")
    return rounded(MET.class_report(p.withColumn("label", F.col("label").cast("double")), "label", "prediction"), "precision", "recall", "f1", digits=4)


def baskets(t):
    """Rule documents with the label "is festive"."""
    fest = t.fx_product_codes.where("code = 'festive'").select("product_id", F.lit(1).alias("f"))
    d = C.rule_docs(t.fx_items).withColumn("items", F.split("doc", " "))
    return d.join(fest, "product_id", "left").select("product_id", "items", F.coalesce("f", F.lit(0)).alias("label"))


@query("m07_l1_path")
def _(t):
    p = M.l1_path(baskets(t), "items")
    return p.select("step", "strength", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round("score", 4).alias("score"), "best", F.size("features").alias("n_features"))


@query("m10_forest_importance")
def _(t):
    return rounded(M.forest_importance(baskets(t), "items"), "importance", digits=5)


def labelled_items(t):
    """Products of each group (class 1) and of its disjoint groups (class 0) with their items."""
    r = PC.rows(t)
    docs = C.rule_docs(t.fx_items).withColumn("items", F.split("doc", " ")).drop("doc")
    return C.pos_neg_dataset(r.drop("codes"), PC.pairs(r)).join(docs, "product_id"), docs


def counted_sets(t):
    """Item sets of each group (class 1) and of its disjoint groups (class 0) with their
    number of products: equal sets are counted per group before the disjoint groups' sets
    join as negatives, and each group's counts are written once."""
    r = PC.rows(t)
    docs = C.rule_docs(t.fx_items).withColumn("items", F.split("doc", " ")).drop("doc")
    sets = pinned(r.select("product_id", *C.GROUP).join(docs, "product_id").groupBy(*C.GROUP, "items").agg(F.count(F.lit(1)).alias("n")))
    return C.pos_neg_dataset(sets, PC.pairs(r))


def trees(t):
    """Leaves of the trees, grown from counts of equal item sets."""
    return M.group_trees(counted_sets(t).withColumnRenamed("class", "label"), C.GROUP, "items", count="n")


@query("m08_decision_tree")
def _(t):
    return trees(t).select(*C.GROUP, "node", F.array_join("path", " ").alias("path"), "label", "cover", F.round("share", 4).alias("share"), F.round("prob", 4).alias("prob"))


def _split_sql(rows: str, nodes: str) -> str:
    """The best item of every node of ``rows`` (group, class, l, w, total, node)."""
    g = "parent_type, gender, dress_code, node"
    gini = lambda p, q: f"coalesce(2 * ({p}) * ({q}) / nullif(({p}) + ({q}), 0), 0)"
    return f"""
{nodes}_w AS (SELECT {g}, count(*) AS n, sum(w) FILTER (WHERE class = 1) AS p, sum(w) FILTER (WHERE class = 0) AS q, any_value(total) AS s FROM {rows} GROUP BY ALL),
{nodes}_i AS (SELECT {g}, item, count(*) AS hn, coalesce(sum(w) FILTER (WHERE class = 1), 0) AS hp, coalesce(sum(w) FILTER (WHERE class = 0), 0) AS hq FROM (SELECT *, unnest(l) AS item FROM {rows}) GROUP BY ALL),
{nodes}_g AS (SELECT *, round(({gini('p', 'q')} - {gini('hp', 'hq')} - {gini('p - hp', 'q - hq')}) / s, 9) AS gain FROM {nodes}_i JOIN (SELECT {g}, n, coalesce(p, 0) AS p, coalesce(q, 0) AS q, s FROM {nodes}_w) USING ({g}) WHERE hn >= 5 AND n - hn >= 5),
{nodes} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY gain DESC, item) AS r FROM {nodes}_g WHERE gain > 0.01) WHERE r = 1)"""


@query("m08_first_splits", f"""
WITH d AS (SELECT parent_type, gender, dress_code, class, list_distinct(string_split(doc, ' ')) AS l FROM ck_dataset JOIN ck_docs USING (product_id)),
one AS (SELECT *, 1 AS node, total * 1.0 / count(*) OVER (PARTITION BY parent_type, gender, dress_code, class) AS w FROM (SELECT *, count(*) OVER (PARTITION BY parent_type, gender, dress_code) AS total FROM d)),
{_split_sql('one', 'root')},
two AS (SELECT one.* EXCLUDE (node), 2 + CAST(list_contains(l, item) AS INT) AS node FROM one JOIN root USING (parent_type, gender, dress_code)),
{_split_sql('two', 'next')}
SELECT parent_type, gender, dress_code, CAST(node AS BIGINT) AS node, item AS split, n AS cover FROM root
UNION ALL SELECT parent_type, gender, dress_code, CAST(node AS BIGINT), item, n FROM next""")
def _(t):
    """The first two levels of every tree, with the rows they decide."""
    return M.tree_splits(trees(t), C.GROUP).where("node < 4").select(*C.GROUP, "node", "split", "cover")


@query("m08_leaf_covers", """
SELECT parent_type, gender, dress_code, count(*) AS cover FROM ck_dataset JOIN ck_docs USING (product_id) GROUP BY ALL""")
def _(t):
    """The leaves of a group hold all its rows, once."""
    return trees(t).groupBy(*C.GROUP).agg(F.sum("cover").alias("cover"))


@query("m09_tree_rules")
def _(t):
    return M.tree_rules(trees(t), C.GROUP).withColumn("prob", F.round("prob", 2))


@query("m09_rule_of_row")
def _(t):
    d = labelled_items(t)[0].withColumnRenamed("class", "label")
    r = M.rule_of_row(d, C.GROUP, "items", trees(t))
    return r.select(*C.GROUP, "product_id", "label", "node", "predicted", F.round("prob", 4).alias("prob"))


def rule_baskets(t):
    docs = C.rule_docs(t.fx_items).withColumn("items", F.split("doc", " "))
    code = t.fx_product_codes.where("score = 100").groupBy("product_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("code-"), "code"))).alias("c"))
    return docs.join(code, "product_id").select("product_id", F.concat("items", "c").alias("items"))


@query("m11_association_rules", """
WITH d AS (SELECT parent_type, gender, dress_code, class, list_sort(list_distinct(string_split(doc, ' '))) AS l FROM ck_dataset JOIN ck_docs USING (product_id)),
n AS (SELECT parent_type, gender, dress_code, count(*) AS total FROM d GROUP BY ALL),
x AS (SELECT parent_type, gender, dress_code, class, list_filter(l, lambda y, i: (m >> (i - 1)) & 1 = 1) AS a FROM d, unnest(range(1, CAST(1 << len(l) AS BIGINT))) AS u(m)),
c AS (SELECT parent_type, gender, dress_code, a, count(*) AS n, count(*) FILTER (class = 1) AS hits FROM x GROUP BY ALL),
r AS (SELECT c.*, total FROM c JOIN n USING (parent_type, gender, dress_code) WHERE hits >= greatest(1, ceil(round(total * 0.01, 9))) AND hits * 1.0 / n >= 0.8 AND len(a) <= 7)
SELECT parent_type, gender, dress_code, array_to_string(a, ',') AS antecedent, hits AS n, round(hits * 1.0 / n, 6) AS confidence FROM r
WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.parent_type = r.parent_type AND o.gender = r.gender AND o.dress_code = r.dress_code AND len(o.a) > len(r.a) AND list_has_all(o.a, r.a))""")
def _(t):
    """Rules for the code of each group, over its products and those of its disjoint groups."""
    r = RM.grouped_rules(counted_sets(t), C.GROUP, "items", "class", count="n")
    return r.select(*C.GROUP, F.array_join("antecedent", ",").alias("antecedent"), F.col("hits").alias("n"), F.round("confidence", 6).alias("confidence"))


@query("m11_pair_rules", """
WITH b AS (SELECT product_id, unnest(string_split(doc, ' ')) AS item FROM ck_docs WHERE product_id IN (SELECT product_id FROM fx_product_codes WHERE score = 100)
 UNION SELECT product_id, concat('code-', code) FROM fx_product_codes WHERE score = 100),
n AS (SELECT count(DISTINCT product_id) AS n FROM b), c AS (SELECT item, count(*) AS c FROM b GROUP BY 1),
p AS (SELECT x.item AS antecedent, y.item AS consequent, count(*) AS k FROM b x JOIN b y ON x.product_id = y.product_id AND x.item <> y.item GROUP BY 1, 2)
SELECT antecedent, consequent, round(k * 1.0 / c.c, 6) AS confidence, k AS n FROM p JOIN c ON c.item = antecedent CROSS JOIN n WHERE k >= 0.01 * n.n AND k * 1.0 / c.c >= 0.15 AND consequent LIKE 'code-%'""")
def _(t):
    codes = ["festive", "economy", "standard", "medium", "small", "large", "promo"]
    r = M.association_rules(rule_baskets(t), "items", right=[f"code-{c}" for c in codes], confidence=0.15, longest=2, maximal=False)
    return r.select(F.get("antecedent", F.lit(0)).alias("antecedent"), F.get("consequent", F.lit(0)).alias("consequent"), F.round("confidence", 6).alias("confidence"), "n")


@query("m12_topics")
def _(t):
    d = t.texts.select("doc_id", TX.words("text").alias("w")).where(F.size("w") > 0)
    return rounded(TM.topics(d, "doc_id", "w"), "weight", digits=4)


def choices(t):
    d, names = features(t)
    model = M.weighted_trees(M.held_out(d, "key"))
    j = conversation(t).where(F.col("response_code").isNotNull()).withColumns({
        "hour": F.hour(F.timestamp_seconds("ts")), "day_of_week": F.weekday(F.timestamp_seconds("ts")) + 1, "sum_answer": F.coalesce("sum_answer", F.lit(0)),
        "key": F.concat_ws(":", "sender_id", "ts"), "options": F.array(*[F.lit(c) for c in CODES])})
    s = M.option_scores(j.select("key", "options", "last_product_type", *MT.NUMBERS), "key", "options", model, names, CATEGORIES)
    return j.select("key", "response_code", "is_answered"), s


@query("m13_option_scoring")
def _(t):
    _, s = choices(t)
    return rounded(M.best_option(s, "key"), "score")


@query("m14_policy_compare")
def _(t):
    history, s = choices(t)
    return rounded(M.policy_compare(history, M.best_option(s, "key"), "key"), "mean", "ci", digits=4)
