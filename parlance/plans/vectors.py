"""Vectors, similarity search and retrieval evaluation (V, T02-T04, J10, J16, J17)."""

from pyspark.sql import functions as F

from parlance.functions import vectors as V
from parlance.operators import retrieval as R
from parlance.operators import rows as ROWS
from parlance.operators import sampling as S
from parlance.plans.registry import check_view, query

check_view("ck_vec", "SELECT vec_id, label AS intent, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
check_view("ck_center", """
SELECT intent, list(m ORDER BY dim) AS c FROM (SELECT intent, dim, avg(x) AS m FROM (SELECT intent, unnest(v) AS x, unnest(range(len(v))) AS dim FROM ck_vec) GROUP BY 1, 2) GROUP BY 1""")
COS = "list_cosine_similarity({}, {})"


def vecs(t):
    return t.fx_vectors.select(F.col("vec_id").alias("id"), F.col("intent").cast("long").alias("intent"), F.col("embedding").alias("vector"))


def centers(t):
    """Mean vector per intent: as many rows as there are intents."""
    return R.mean_vectors(vecs(t), ["intent"], "vector", "center")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def paired(t):
    return vecs(t).join(centers(t), "intent")


@query("v01_cosine_pairs", "SELECT vec_id, intent, round(list_cosine_similarity(v, c), 6) AS cos FROM ck_vec JOIN ck_center USING (intent)")
def _(t):
    return paired(t).select(F.col("id").alias("vec_id"), "intent", F.round(V.cosine("vector", "center"), 6).alias("cos"))


@query("v02_angular", "SELECT vec_id, round(1 - acos(least(1, greatest(-1, list_cosine_similarity(v, c)))), 6) AS score FROM ck_vec JOIN ck_center USING (intent)")
def _(t):
    return paired(t).select(F.col("id").alias("vec_id"), F.round(V.angular("vector", "center"), 6).alias("score"))


@query("v03_similarity_matrix", """
SELECT intent AS q_id, vec_id AS id, round(round(cos, 9), 6) AS cos, round(1 - acos(least(1, greatest(-1, round(cos, 9)))), 5) AS angular FROM (
SELECT c.intent, vec_id, list_cosine_similarity(v, c) AS cos FROM ck_vec CROSS JOIN ck_center c)""")
def _(t):
    q = centers(t).select(F.col("intent").alias("id"), F.col("center").alias("vector"))
    return R.score_pairs(vecs(t), q).select("q_id", "id", F.round("cos", 6).alias("cos"), F.round("angular", 5).alias("angular"))


@query("v04_inner_product", "SELECT vec_id, round(list_inner_product(v, c), 6) AS dot, round(sqrt(list_inner_product(v, v)), 6) AS length FROM ck_vec JOIN ck_center USING (intent)")
def _(t):
    return paired(t).select(F.col("id").alias("vec_id"), F.round(V.inner_product("vector", "center"), 6).alias("dot"), F.round(V.norm("vector"), 6).alias("length"))


check_view("ck_query", "SELECT intent, min(vec_id) AS q_id FROM ck_vec GROUP BY 1")
check_view("ck_hits", """
SELECT q.q_id, c.vec_id AS id, round(list_cosine_similarity(a.v, c.v), 9) AS score FROM ck_query q JOIN ck_vec a ON a.vec_id = q.q_id CROSS JOIN ck_vec c""")


def first_of_intent(t):
    """One query message per intent."""
    return ROWS.distinct_by_key(vecs(t), ["intent"], ["id"])


@query("t02_top_k_similar", """
SELECT q_id, id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS r FROM ck_hits) WHERE r <= 10""")
def _(t):
    return rounded(R.top_k_similar(vecs(t), first_of_intent(t), 10), "score")


@query("t03_top_k_for_message", """
SELECT q_id, id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS r FROM ck_hits WHERE id <> q_id) WHERE r <= 10""")
def _(t):
    return rounded(R.top_k_similar(vecs(t), first_of_intent(t), 10, drop_self=True), "score")


check_view("ck_msg", """
SELECT vec_id, intent, v, concat(coalesce(source, 'none'), '-', CAST(vec_id % 3 AS VARCHAR)) AS text FROM ck_vec LEFT JOIN documents ON doc_id = vec_id""")


def messages(t):
    d = t.documents.select(F.col("doc_id").alias("id"), "source")
    text = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), (F.col("id") % 3).cast("string"))
    return vecs(t).join(d, "id", "left").withColumn("text", text)


@query("t04_candidate_set", """
WITH h AS (SELECT q.q_id, a.text AS own, c.text, c.vec_id AS id, round(list_cosine_similarity(a.v, c.v), 9) AS score FROM ck_query q JOIN ck_msg a ON a.vec_id = q.q_id CROSS JOIN ck_msg c),
b AS (SELECT q_id, text, max(score) AS score FROM h WHERE text <> own GROUP BY 1, 2),
d AS (SELECT *, (q_id % 2147483647 * 48271 + id % 2147483647 * 69621 + 1) % 2147483647 AS x FROM h),
s AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY (x * 16807 + x * x % 2147483647) % 2147483647, id) AS r FROM d)
SELECT q_id, text, round(score, 6) AS score, false AS is_random FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, text) AS r FROM b) WHERE r <= 10
UNION ALL SELECT q_id, text, round(score, 6), true FROM s WHERE r <= 10""")
def _(t):
    m = messages(t)
    return rounded(R.candidate_set(m, ROWS.distinct_by_key(m, ["intent"], ["id"]), 10), "score")


@query("j10_cross", """
WITH q AS (SELECT vec_id, intent, v FROM ck_vec ORDER BY md5(concat('3:', CAST(vec_id AS VARCHAR))), vec_id LIMIT 20)
SELECT q.vec_id AS q_id, c.vec_id AS id, round(round(list_cosine_similarity(q.v, c.v), 9), 6) AS cos FROM q CROSS JOIN ck_vec c WHERE c.vec_id NOT IN (SELECT vec_id FROM q)""")
def _(t):
    v = vecs(t)
    q = S.sample_n(v, "id", 20, 3)
    return R.score_pairs(v.join(q.select("id"), "id", "left_anti"), q).select("q_id", "id", F.round("cos", 6).alias("cos"))


@query("j16_tag_messages", """
SELECT message_id, intent AS name, category, doc_id, n_chars FROM (SELECT DISTINCT * FROM fx_tags WHERE tag = 'true') JOIN documents ON doc_id = message_id""")
def _(t):
    m = t.documents.select(F.col("doc_id").alias("message_id"), "doc_id", "n_chars")
    return R.tag_messages(R.tag_documents(t.fx_tags), m).select("message_id", "name", "category", "doc_id", "n_chars")


@query("j17_cache_lookup", """
WITH c AS (SELECT text, min(vec_id) AS vec_id FROM ck_msg WHERE vec_id % 5 <> 0 GROUP BY 1)
SELECT m.vec_id, m.text, round(list_inner_product(v.v, v.v), 6) AS length2 FROM ck_msg m LEFT JOIN c ON c.text = m.text LEFT JOIN ck_vec v ON v.vec_id = c.vec_id""")
def _(t):
    m = messages(t)
    cache = ROWS.distinct_by_key(m.where("id % 5 <> 0"), ["text"], ["id"]).select("text", F.lit("base").alias("encoder"), F.col("vector").alias("stored"))
    return R.cache_lookup(m.select("id", "text"), cache, "base").select(
        F.col("id").alias("vec_id"), "text", F.round(V.inner_product("stored", "stored"), 6).alias("length2"))


@query("v05_encode_job")
def _(t):
    texts = t.texts.select("text")
    cache = t.benchmark.select("text", F.lit("trigram").alias("encoder"))
    e = R.encode_missing(texts, cache, "trigram", R.trigram_encoder(64))
    return e.select(F.md5("text").alias("text_key"), "encoder", F.size("vector").alias("dims"), F.round(V.norm("vector"), 4).alias("length"))


# entities of the checks: the intent, and for even ids the next one, which for the last
# intent is a name without a vector; an entity's vector is its intent's mean
check_view("ck_ent", """
SELECT concat('i', CAST(intent AS VARCHAR)) AS name, c AS e FROM ck_center UNION ALL SELECT '*', list_transform(c, lambda x: 0.5) FROM (SELECT c FROM ck_center LIMIT 1)""")
check_view("ck_fields", """
SELECT f.*, a.e AS e1, coalesce(b.e, z.e) AS e2 FROM (
  SELECT vec_id, intent, v AS t, concat('i', CAST(intent AS VARCHAR)) AS f1, CASE WHEN vec_id % 2 = 0 THEN concat('i', CAST(intent + 1 AS VARCHAR)) ELSE '*' END AS f2 FROM ck_vec) f
JOIN ck_ent a ON a.name = f1 LEFT JOIN ck_ent b ON b.name = f2 JOIN ck_ent z ON z.name = '*'""")


def spec_messages(t):
    name = lambda i: F.concat(F.lit("i"), i.cast("string"))
    second = F.when(F.col("id") % 2 == 0, name(F.col("intent") + 1))
    return vecs(t).withColumn("entities", F.array_compact(F.array(name(F.col("intent")), second))).withColumn("text", F.concat_ws(" ", "entities"))


def entity_vectors(t):
    c = centers(t).select(F.concat(F.lit("i"), F.col("intent").cast("string")).alias("name"), F.col("center").alias("vector"))
    return c.unionByName(c.limit(1).select(F.lit("*").alias("name"), F.transform("vector", lambda x: F.lit(0.5)).alias("vector")))


def dims(df):
    """One row per dimension, so that vectors compare number by number."""
    return df.select(F.col("id").alias("vec_id"), F.posexplode("vector").alias("dim", "v")).select("vec_id", "dim", F.round("v", 6).alias("v"))


DIMS = "SELECT vec_id, CAST(dim AS INT) AS dim, round(v, 6) AS v FROM (SELECT vec_id, unnest(v) AS v, unnest(range(len(v))) AS dim FROM ({}))"
FIELDS = R.VectorSpec(fields=(("entities", 2),))
MEAN = R.VectorSpec(fields=(("entities", 2),), mean=True)
COUNTS = R.VectorSpec(fields=(("entities", 2),), counts=True, text_length=True)
SPEC_SQL = {
    "text": "SELECT vec_id, t AS v FROM ck_fields",
    "fields": "SELECT vec_id, list_concat(t, list_concat(e1, e2)) AS v FROM ck_fields",
    "mean": "SELECT vec_id, list_concat(t, CASE WHEN f2 = '*' THEN e1 ELSE list_transform(e1, lambda x, i: (x + e2[i]) / 2) END) AS v FROM ck_fields",
    "counts": "SELECT vec_id, list_concat(t, list_concat(list_concat(e1, e2), CASE WHEN f2 = '*' THEN [1.0, 1.0] ELSE [2.0, 2.0] END)) AS v FROM ck_fields",
}


@query("v06_concat_fields", DIMS.format(SPEC_SQL["fields"]))
def _(t):
    return dims(R.message_vectors(spec_messages(t), "id", entity_vectors(t), FIELDS))


@query("v07_mean_entities", DIMS.format(SPEC_SQL["mean"]))
def _(t):
    return dims(R.message_vectors(spec_messages(t), "id", entity_vectors(t), MEAN))


@query("v08_counts_as_dims", DIMS.format(SPEC_SQL["counts"]))
def _(t):
    return dims(R.message_vectors(spec_messages(t), "id", entity_vectors(t), COUNTS))


@query("v12_message_vector_spec", "SELECT spec, vec_id, len(v) AS n, round(list_sum(v), 5) AS total FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS spec, * FROM ({q})" for k, q in SPEC_SQL.items()) + ")")
def _(t):
    m, e, out = spec_messages(t), entity_vectors(t), None
    for name, s in {"text": R.VectorSpec(), "fields": FIELDS, "mean": MEAN, "counts": COUNTS}.items():
        total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
        one = R.message_vectors(m, "id", e, s).select(F.lit(name).alias("spec"), F.col("id").alias("vec_id"), F.size("vector").cast("long").alias("n"), F.round(total, 5).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


check_view("ck_tok", "SELECT intent, vec_id, CAST(vec_id % 5 <> 0 AS INT) AS mask, v FROM ck_vec")
POOL = """SELECT intent, dim, {} AS x FROM (SELECT intent, vec_id, unnest(v) AS v, unnest(range(len(v))) AS dim FROM ck_tok WHERE mask = 1) GROUP BY 1, 2"""


@query("v09_pooling", f"""
SELECT how, intent, CAST(dim AS INT) AS dim, round(x, 6) AS v FROM (
SELECT 'mean' AS how, * FROM ({POOL.format('avg(v)')}) UNION ALL SELECT 'max', * FROM ({POOL.format('max(v)')})
UNION ALL SELECT 'mean+max', * FROM ({POOL.format('avg(v)')}) UNION ALL SELECT 'mean+max', intent, dim + (SELECT max(len(v)) FROM ck_tok), x FROM ({POOL.format('max(v)')})
UNION ALL SELECT 'first', * FROM ({POOL.format('arg_min(v, vec_id)')}) UNION ALL SELECT 'last', * FROM ({POOL.format('arg_max(v, vec_id)')})
UNION ALL SELECT 'none', intent, row_number() OVER (PARTITION BY intent ORDER BY vec_id, dim) - 1, v FROM (SELECT intent, vec_id, unnest(v) AS v, unnest(range(len(v))) AS dim FROM ck_tok WHERE mask = 1))""")
def _(t):
    tok = vecs(t).select("intent", "id", (F.col("id") % 5 != 0).cast("int").alias("mask"), "vector")
    out = None
    for how in ("mean", "max", "mean+max", "first", "last", "none"):
        p = R.pooled(tok, "intent", "id", "vector", "mask", how).select(F.lit(how).alias("how"), "intent", F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "v"))
        out = p if out is None else out.unionByName(p)
    return rounded(out, "v")


N_QUERIES = 40
check_view("ck_eval_q", f"SELECT vec_id, intent, v FROM ck_vec ORDER BY md5(concat('1:', CAST(vec_id AS VARCHAR))), vec_id LIMIT {N_QUERIES}")
check_view("ck_eval_p", """
SELECT q.vec_id AS q_id, c.vec_id AS id, q.intent, CAST(q.intent = c.intent AS INT) AS same, round(1 - acos(least(1, greatest(-1, round(list_cosine_similarity(q.v, c.v), 9)))), 9) AS score
FROM ck_eval_q q CROSS JOIN ck_vec c WHERE c.vec_id NOT IN (SELECT vec_id FROM ck_eval_q)""")
CUM = """SELECT {g}score, n, tp, sum(n) OVER w AS cum_n, sum(tp) OVER w AS cum_tp, sum(n) OVER ({p}) AS total_n, sum(tp) OVER ({p}) AS total_tp FROM (SELECT {g}score, count(*) AS n, sum(same) AS tp FROM {src} GROUP BY ALL) WINDOW w AS ({p} ORDER BY score DESC)"""
AP = "sum(tp * 1.0 / nullif(total_tp, 0) * cum_tp / cum_n)"
AUC = "(sum(tp * (total_n - cum_n + (n + 1) / 2.0)) - max(total_tp) * (max(total_tp) + 1) / 2.0) / nullif(max(total_tp) * 1.0 * (max(total_n) - max(total_tp)), 0)"


@query("v10_retrieval_eval", f"""
WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, q_id, id) AS r FROM ck_eval_p) WHERE r <= (SELECT sum(same) FROM ck_eval_p)),
a AS ({CUM.format(g='', p='', src='ck_eval_p')}), b AS ({CUM.format(g='', p='', src='top')}), c AS ({CUM.format(g='intent, ', p='PARTITION BY intent', src='ck_eval_p')}),
m AS (SELECT intent, {AP} AS ap, {AUC} AS auc FROM c GROUP BY 1)
SELECT 'all' AS rows_used, round({AP}, 5) AS ap, round({AUC}, 5) AS auc, CAST(max(total_n) AS BIGINT) AS n FROM a
UNION ALL SELECT 'top_n', round({AP}, 5), round({AUC}, 5), CAST(max(total_n) AS BIGINT) FROM b UNION ALL SELECT 'per_intent', round(avg(ap), 5), round(avg(auc), 5), count(*) FROM m""")
def _(t):
    return rounded(R.retrieval_eval(vecs(t), N_QUERIES), "ap", "auc", digits=5)


@query("a42_split_stats", """
WITH d AS (SELECT intent, count(*) AS n_data FROM ck_vec WHERE vec_id NOT IN (SELECT vec_id FROM ck_eval_q) GROUP BY 1), q AS (SELECT intent, count(*) AS n_queries FROM ck_eval_q GROUP BY 1),
j AS (SELECT intent, coalesce(n_data, 0) AS n_data, coalesce(n_queries, 0) AS n_queries FROM d FULL JOIN q USING (intent))
SELECT CAST(intent AS BIGINT) AS intent, n_data, n_queries, n_data * n_queries AS true_pairs, round(n_data * 1.0 / sum(n_data) OVER (), 6) AS data_share, round(n_data * n_queries * 1.0 / sum(n_data * n_queries) OVER (), 6) AS pair_share FROM j""")
def _(t):
    v = vecs(t)
    q = S.sample_n(v, "id", N_QUERIES, 1)
    return rounded(R.split_stats(v.join(q.select("id"), "id", "left_anti"), q), "data_share", "pair_share")


check_view("ck_results", """
SELECT concat('v', CAST(grp AS VARCHAR)) AS version, CASE WHEN label = 1 THEN 'mean' ELSE 'max' END AS pooling, 'ap' AS metric, round(avg(score), 6) AS v FROM fx_scores GROUP BY 1, 2
UNION ALL SELECT concat('v', CAST(grp AS VARCHAR)), CASE WHEN label = 1 THEN 'mean' ELSE 'max' END, 'auc', round(max(score), 6) FROM fx_scores GROUP BY 1, 2""")


def results(t):
    """Metric records (version, pooling, metric, v), as an evaluation run appends them."""
    s = t.fx_scores.groupBy(F.concat(F.lit("v"), F.col("grp").cast("string")).alias("version"), F.when(F.col("label") == 1, "mean").otherwise("max").alias("pooling"))
    s = s.agg(F.round(F.avg("score"), 6).alias("ap"), F.round(F.max("score"), 6).alias("auc"))
    return s.unpivot(["version", "pooling"], ["ap", "auc"], "metric", "v")


@query("v11_eval_summary", """
SELECT version, pooling, max(v) FILTER (WHERE metric = 'ap') AS ap, max(v) FILTER (WHERE metric = 'auc') AS auc FROM ck_results WHERE version IN ('v1', 'v2', 'v3') GROUP BY 1, 2""")
def _(t):
    return R.eval_summary(results(t).where(F.col("version").isin("v1", "v2", "v3")), ["version", "pooling"], "metric", "v", ["ap", "auc"])


@query("a30_intent_stats", """
SELECT name, category, count(*) FILTER (WHERE tag = 'true') AS "true", count(*) FILTER (WHERE tag = 'false') AS "false" FROM (SELECT DISTINCT message_id, intent AS name, category, tag FROM fx_tags) GROUP BY 1, 2""")
def _(t):
    flat = R.tag_documents(t.fx_tags).select("message_id", F.explode("intents").alias("i")).select("i.*")
    return flat.groupBy("name", "category").pivot("tag", ["true", "false"]).agg(F.count(F.lit(1))).na.fill(0)
