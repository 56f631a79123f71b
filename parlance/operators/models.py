"""Model jobs on Spark ML, and decision trees for all groups at once.

Training and scoring are Spark jobs; only model sizes (coefficients, importances,
metrics of a few folds) reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from parlance.functions import metrics as M
from parlance.functions.scan import null_safe_join
from parlance.operators.rule_mining import maximal as keep_maximal
from parlance.operators.sampling import stratified_folds
from parlance.operators.textjobs import word_ids
from parlance.session import pinned, release, scratch


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def positive_probability(df: DataFrame, out: str = "p") -> DataFrame:
    return df.withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))


# --- answered-question model ------------------------------------------------------

def boosted_trees(rounds: int = 500, depth: int = 6, rate: float = 0.03, sample: float = 0.8, seed: int = 2, **more) -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate,
                         subsamplingRate=sample, seed=seed, **more)


def boosted_trees_cv(df: DataFrame, key: str, folds: int = 3, **params) -> DataFrame:
    """(fold, part, auc, n): boosted trees per stratified fold; training stops early on
    the held-out fold."""
    d = pinned(stratified_folds(pinned(df), key, "label", folds))
    out = []
    for k in range(folds):
        marked = d.withColumn("held_out", F.col("fold") == k)
        model = boosted_trees(validationIndicatorCol="held_out", **params).fit(marked)
        scored = positive_probability(model.transform(marked)).withColumn("part", F.when(F.col("held_out"), "test").otherwise("train"))
        scored = scored.select("part", "p", "label")
        out.append(M.ap_auc(scored, "p", "label", ["part"]).select(F.lit(k).alias("fold"), "part", "auc", "n"))
    return reduce(DataFrame.unionByName, out)


def held_out(df: DataFrame, key: str, label: str = "label", share: float = 0.2) -> DataFrame:
    """The rows written once with ``held_out``: true for ``share`` of each label."""
    from parlance.operators.sampling import stratified_split
    d = stratified_split(pinned(df), key, label, test=share, dev=0.0)
    return pinned(d.withColumn("held_out", F.col("part") == "test").drop("part"))


def weighted_trees(df: DataFrame, negative: float = 0.5, **params):
    """Boosted trees with row weight 1 for positives and ``negative`` for the rest.  With a
    column ``held_out`` those rows are not fitted, and rounds end when they gain no more."""
    w = df.withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(negative))
    more = {"validationIndicatorCol": "held_out"} if "held_out" in df.columns else {}
    return boosted_trees(weightCol="weight", **more, **params).fit(pinned(w.select("label", "features", "weight", *(["held_out"] if more else []))))


def top_features(model, names: list[str], n: int = 20, least: float = 0.0) -> list[tuple[str, float]]:
    """The n most important features with their importance."""
    pairs = sorted(zip(names, (float(x) for x in model.featureImportances.toArray())), key=lambda p: (-p[1], p[0]))
    return [p for p in pairs[:n] if p[1] > least]


def multiclass(train: DataFrame, test: DataFrame, trees: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """Predictions of a random forest for a label with several classes."""
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(pinned(train.select("label", "features")))
    return model.transform(test)


# --- text -------------------------------------------------------------------------

def numbered(df: DataFrame) -> DataFrame:
    """The rows written once with a number that stays."""
    return pinned(df.withColumn("_row", F.monotonically_increasing_id()))


def token_ids(df: DataFrame, tokens: str) -> DataFrame:
    """(word, id) of all tokens of the rows, however many and however rare; the table
    stays on the executors."""
    return pinned(word_ids(df.select(F.explode(tokens).alias("word")).where(F.col("word").isNotNull())))


def count_vectors(df: DataFrame, tokens: str, ids: DataFrame, binary: bool = False) -> DataFrame:
    """``features`` in place of the tokens: the sparse counts (or 0/1) of those that have an
    id; a row without any has an empty vector.  ``df`` is a ``numbered`` table.

    The vectors are made of columns: the table is written with the fields of a sparse
    vector and read back as vectors, so no row passes through Python."""
    size = ids.count()
    n = F.lit(1.0) if binary else F.count(F.lit(1)).cast("double")
    counts = df.select("_row", F.explode(tokens).alias("word")).groupBy("_row", "word").agg(n.alias("n"))
    pairs = counts.join(ids, "word").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "n"))).alias("_p"))
    none = F.array().cast("array<struct<id:int,n:double>>")
    d = df.drop(tokens).join(pairs, "_row", "left").withColumn("_p", F.coalesce("_p", none))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("_p.id").alias("indices"), F.col("_p.n").alias("values"))
    d = d.withColumn("features", vector).drop("_row", "_p")
    path = scratch(df.sparkSession)
    d.write.parquet(path)
    kept = [f for f in d.schema.fields if f.name != "features"]
    out = df.sparkSession.read.schema(StructType([*kept, StructField("features", VectorUDT())])).parquet(path)
    out._pinned_at = path
    return out


def names_of(ids: DataFrame, wanted: set[int]) -> dict[int, str]:
    """Words of the ids that a model picked."""
    few = ids.sparkSession.createDataFrame([(i,) for i in sorted(wanted)], "id long")
    return {r["id"]: r["word"] for r in ids.join(few, "id").collect()}


def text_classifier(train: DataFrame, test: DataFrame, tokens: str, rounds: int = 50) -> DataFrame:
    """Token counts to logistic regression; predictions on the test rows."""
    train = numbered(train.select("label", tokens))
    ids = token_ids(train, tokens)
    x = count_vectors(train, tokens, ids).select(F.col("label").cast("double").alias("label"), "features")
    release(train)
    lr = LogisticRegression(labelCol="label", featuresCol="features", maxIter=rounds).fit(x)
    return lr.transform(count_vectors(numbered(test.select("label", tokens)), tokens, ids))


# --- rules over items -------------------------------------------------------------

def item_features(df: DataFrame, items: str) -> tuple[DataFrame, DataFrame]:
    """0/1 vectors of all items, and (word, id) of the items."""
    df = numbered(df)
    ids = token_ids(df, items)
    return count_vectors(df, items, ids, binary=True), ids


def l1_path(df: DataFrame, items: str, steps: int = 16, rounds: int = 100, least: float = 0.01) -> DataFrame:
    """L1 logistic regression over a grid of strengths: (step, strength, precision,
    recall, score, best, features).  The grid starts from the strength at which every
    coefficient is zero, divided by 10^3 .. 10^7; ``best`` marks the highest score, 0.9
    precision + 0.1 recall, and of equal ones the strongest penalty."""
    x, ids = item_features(df, items)
    x = x.select("label", "features")
    sign = F.when(F.col("label") == 1, 1).otherwise(-1)
    # the largest |sum of signed labels| over the items gives the empty model
    sums = df.select(F.explode(F.array_distinct(items)).alias("i"), sign.alias("s")).groupBy("i").agg(F.abs(F.sum("s")).alias("a"))
    top, n = sums.agg(F.max("a")).first()[0], df.count()
    rows = []
    for i in range(steps):
        strength = top / (2.0 * n) / 10 ** (3 + 4 * i / (steps - 1))
        model = LogisticRegression(labelCol="label", featuresCol="features", elasticNetParam=1.0, regParam=strength,
                                   maxIter=rounds, standardization=False).fit(x)
        c = model.transform(x).agg(F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("tp"),
                                   F.count_if(F.col("prediction") == 1).alias("pp"), F.count_if(F.col("label") == 1).alias("ap")).first()
        precision, recall = (c.tp / c.pp if c.pp else 0.0), (c.tp / c.ap if c.ap else 0.0)
        coef = {m: float(v) for m, v in enumerate(model.coefficients.toArray()) if abs(v) > least}
        rows.append((i, strength, precision, recall, 0.9 * precision + 0.1 * recall, coef))
    names = names_of(ids, {m for r in rows for m in r[-1]})
    best = max(rows, key=lambda r: (r[4], -r[0]))[0] if rows else None
    for k, (*head, coef) in enumerate(rows):
        rows[k] = (*head, head[0] == best, [t for _, t in sorted(((abs(v), f"{names[m]}:{v:.4f}") for m, v in coef.items()), reverse=True)])
    return df.sparkSession.createDataFrame(rows, "step int, strength double, precision double, recall double, score double, best boolean, features array<string>")


def forest_importance(df: DataFrame, items: str, trees: int = 50, least: float = 0.001, strength: float = 1.0, seed: int = 0) -> DataFrame:
    """(method, item, importance) of one-split trees and of an L1 linear model of the given
    strength on the plain 0/1 features."""
    x, ids = item_features(df, items)
    # on 0/1 labels the variance of a regression tree is half the Gini impurity, and unlike a
    # classification tree it keeps a split whose sides have one majority
    x = x.withColumn("label", F.col("label").cast("double"))
    rf = RandomForestRegressor(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=1, featureSubsetStrategy="sqrt", seed=seed).fit(x)
    lasso = LinearRegression(labelCol="label", featuresCol="features", elasticNetParam=1.0, regParam=strength, standardization=False).fit(x)
    found = [(how, i, abs(float(v))) for how, x in (("forest", rf.featureImportances), ("linear", lasso.coefficients)) for i, v in enumerate(x.toArray()) if abs(v) > least]
    names = names_of(ids, {i for _, i, _ in found})
    rows = [(how, names[i], v) for how, i, v in found]
    return df.sparkSession.createDataFrame(rows, "method string, item string, importance double")


def association_rules(baskets: DataFrame, items: str, right: list[str] | None = None, support: float = 0.01, confidence: float = 0.8,
                      shortest: int = 2, longest: int = 8, maximal: bool = True) -> DataFrame:
    """Rules with a fixed right side, 2 to 8 items, only those whose left side is not
    part of a longer one: (antecedent, consequent, confidence, lift, support, n)."""
    total = baskets.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    model = FPGrowth(itemsCol=items, minSupport=support, minConfidence=confidence).fit(baskets)
    r = model.associationRules
    size = F.size("antecedent") + 1
    r = r.where((size >= shortest) & (size <= longest)).withColumn("antecedent", F.array_sort("antecedent"))
    if right:
        r = r.where(F.get(F.col("consequent"), F.lit(0)).isin(right))
    if maximal:
        r = keep_maximal(r, ["consequent"], "antecedent")
    return (r.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")  # one row
            .withColumn("n", F.round(F.col("support") * F.col("_n")).cast("long")).drop("_k", "_n"))


# --- trees for every group --------------------------------------------------------

def _impurity(pos: Column, neg: Column) -> Column:
    """Gini impurity times weight."""
    return F.coalesce(2 * pos * neg / F.nullif(pos + neg, F.lit(0.0)), F.lit(0.0))


def _class_weight(positive: bool) -> Column:
    """Summed row weight of the positive class or of the rest."""
    w = F.col("_w")
    return F.sum(F.when(F.col("label") == 1, w if positive else 0.0).otherwise(0.0 if positive else w))


def grow_trees(rows: DataFrame, keys: list[str], items: str, depth: int = 30, min_leaf: int = 5, min_gain: float = 0.01, count: str | None = None) -> DataFrame:
    """The rows' distinct item sets, each with its leaf in the tree of its group, for all
    groups in one level-wise pass: (keys, label, items, node, path, n).

    rows: keys, label (0/1), items, and in ``count`` how many rows one stands for (1 if
    None).  Only counts of equal item sets go on: a set is kept once for a group and label,
    however many rows have it.  Row weight is n / n_class of the row's class in its group.
    A level counts (node, item) pairs of every group, picks the best item per node and
    sends the sets on; each level is written, so the plan stays flat and a lost executor
    repeats one level only.  Levels go on until no node splits, or to ``depth``, the
    reference library's limit.  A group of one class is one leaf."""
    times = F.sum(F.col(count) if count else F.lit(1)).cast("long")
    d = rows.groupBy(*keys, "label", F.array_sort(F.array_distinct(items)).alias("items")).agg(times.alias("n"))
    one = d.groupBy(*keys, "label").agg(F.sum("n").alias("_c"))
    size = one.groupBy(*keys).agg(F.sum("_c").alias("_size"))
    weights = null_safe_join(one, size, keys).withColumn("_w", F.col("_size") / F.col("_c")).drop("_c")
    d = null_safe_join(d, weights, [*keys, "label"]).withColumn("_w", F.col("_w") * F.col("n"))
    d = pinned(d.withColumns({"node": F.lit(1).cast("long"), "path": F.array().cast("array<string>"), "open": F.lit(True)}))
    node = [*keys, "node"]
    for _ in range(depth):
        live = d.where("open")  # a node that did not split never will
        whole = live.groupBy(*node).agg(F.sum("n").alias("n"), _class_weight(True).alias("p"), _class_weight(False).alias("q"), F.max("_size").alias("s"))
        has = live.select(*node, "label", "_w", "n", F.explode("items").alias("item")).groupBy(*node, "item").agg(
            F.sum("n").alias("hn"), _class_weight(True).alias("hp"), _class_weight(False).alias("hq"))
        c = null_safe_join(has, whole, node).where((F.col("hn") >= min_leaf) & (F.col("n") - F.col("hn") >= min_leaf))
        gain = _impurity(F.col("p"), F.col("q")) - _impurity(F.col("hp"), F.col("hq")) - _impurity(F.col("p") - F.col("hp"), F.col("q") - F.col("hq"))
        # a balanced root has impurity size; rounding makes equal gains tie
        c = c.withColumn("gain", F.round(gain / F.col("s"), 9)).where(F.col("gain") > min_gain)
        best = c.groupBy(*node).agg(F.min(F.struct((-F.col("gain")).alias("g"), "item")).alias("b")).select(*node, F.col("b.item").alias("split"))
        d = null_safe_join(d, best, node, "left")
        inside = F.array_contains("items", F.col("split"))
        term = F.concat("split", F.when(inside, ">=0.5").otherwise("< 0.5"))
        d = pinned(d.withColumns({
            "node": F.when(F.col("split").isNull(), F.col("node")).otherwise(F.col("node") * 2 + inside.cast("long")),
            "path": F.when(F.col("split").isNull(), F.col("path")).otherwise(F.array_append("path", term)),
            "open": F.col("split").isNotNull()}).drop("split"))
        if d.where("open").isEmpty():
            break
    return d


def tree_leaves(grown: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, path, label, cover, share, prob) per leaf of grown trees."""
    leaf = grown.groupBy(*keys, "node", "path").agg(F.sum("n").alias("cover"), _class_weight(True).alias("p"), _class_weight(False).alias("q"), F.max("_size").alias("s"))
    prob = F.col("p") / (F.col("p") + F.col("q"))
    return leaf.select(*keys, "node", "path", F.when(prob > 0.5, 1).otherwise(0).alias("label"), "cover", (F.col("cover") / F.col("s")).alias("share"), prob.alias("prob"))


def group_trees(rows: DataFrame, keys: list[str], items: str, depth: int = 30, min_leaf: int = 5, min_gain: float = 0.01, count: str | None = None) -> DataFrame:
    """Leaves of a classification tree per group; see ``grow_trees``."""
    return tree_leaves(grow_trees(rows, keys, items, depth, min_leaf, min_gain, count), keys)


def tree_splits(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, split, cover) of the inner nodes of the trees, read from the leaves'
    paths: the root is node 1, and node k has the children 2 k (without the item), 2 k + 1."""
    inner = leaves.select(*keys, "cover", F.explode(F.transform("path", lambda c, i: F.struct(
        F.col("node").alias("leaf"), (F.size("path") - i).alias("up"), F.regexp_replace(c, r"(>=|< )0\.5$", "").alias("split")))).alias("x"))
    node = F.expr("shiftright(x.leaf, x.up)").alias("node")
    return inner.select(*keys, node, F.col("x.split").alias("split"), "cover").groupBy(*keys, "node", "split").agg(F.sum("cover").alias("cover"))


def tree_rules(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Readable rules of the positive leaves: (keys, rule, prob, cover)."""
    from parlance.operators.catalogue import readable_rules
    every = F.array(F.lit("product_type-all>=0.5"))  # a group of one class has the rule "all"
    r = leaves.where("label = 1").withColumn("path", F.when(F.size("path") == 0, every).otherwise(F.col("path")))
    return readable_rules(r, "path").select(*keys, "rule", "prob", "cover")


def rule_of_row(rows: DataFrame, keys: list[str], items: str, leaves: DataFrame) -> DataFrame:
    """The leaf each row falls into.  A row walks down its group's tree: one join with the
    split of the node it is at for each level, so a row meets one node at a time, never all
    leaves of its group.  A row of a group without a tree is left out."""
    splits = pinned(tree_splits(leaves, keys).select(*keys, F.col("node").alias("_node"), "split"))
    deep = leaves.agg(F.max(F.size("path"))).head()[0] or 0
    d = rows.withColumn("_node", F.lit(1).cast("long"))
    for level in range(1, deep + 1):
        d = null_safe_join(d, splits, [*keys, "_node"], "left")
        step = F.col("_node") * 2 + F.coalesce(F.array_contains(items, F.col("split")), F.lit(False)).cast("long")
        d = d.withColumn("_node", F.when(F.col("split").isNull(), F.col("_node")).otherwise(step)).drop("split")
        if level % 4 == 0:
            d = pinned(d)
    ends = leaves.select(*keys, F.col("node").alias("_node"), "path", F.col("label").alias("predicted"), "prob")
    return null_safe_join(d, ends, [*keys, "_node"]).withColumnRenamed("_node", "node")


# --- choosing the next question ---------------------------------------------------

def option_scores(contexts: DataFrame, key: str, options: str, model, features: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """One row per context and candidate question with its score: unseen categories
    become ``other``, categories one-hot as in training, then the model."""
    from parlance.functions.expr import bind_categories
    from parlance.operators.model_table import one_hot
    d = contexts.withColumn("response_code", F.explode(options)).withColumn("option", F.col("response_code"))
    d = d.withColumns({c: bind_categories(c, vs) for c, vs in categories.items()})
    d = one_hot(d, categories)
    missing = [c for c in features if c not in d.columns]
    d = assemble(d.withColumns({c: F.lit(0.0) for c in missing}), features)
    return positive_probability(model.transform(d), "score").select(key, "option", "score")


def best_option(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "option")).alias("b")).select(
        key, F.col("b.option").alias("choice"), (-F.col("b.s")).alias("score"))


def policy_compare(history: DataFrame, choices: DataFrame, key: str) -> DataFrame:
    """Asked question against suggested question: count and answer rate."""
    from parlance.operators.rates import rates
    return rates(history.join(choices.select(key, "choice"), key), ["response_code", "choice"], ["is_answered"])
