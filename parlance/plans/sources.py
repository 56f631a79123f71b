"""Sources and sinks (S): each query writes the whole table and reads it back."""

from pyspark.sql import functions as F

from parlance.operators import retrieval as R
from parlance.plans import vectors as PV
from parlance.plans.registry import query
from parlance.sources import files as S

STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"


@query("s01_csv_events", f"SELECT event_id, {STAMP}, user_id, event_type, value, props FROM events")
def _(t):
    path, e = S.scratch(t.spark), t.events
    S.write_table(e, path)
    return S.read_events(t.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("s02_tsv_events", "SELECT * FROM fx_conv_raw")
def _(t):
    path, d = S.scratch(t.spark), t.fx_conv_raw
    S.write_table(d, path, sep="\t")
    return S.read_events(t.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields), sep="\t")


@query("s03_parquet_io", "SELECT sender_id, ts, response_code, replies FROM fx_bot")
def _(t):
    path = S.scratch(t.spark)
    t.fx_bot.withColumn("replies", F.split("replies", ",")).write.mode("overwrite").parquet(path)
    back = t.spark.read.parquet(path)
    return back.select("sender_id", "ts", "response_code", F.array_join("replies", ",").alias("replies"))


@query("s04_csv_sink", "SELECT code, count(*) AS n FROM fx_product_codes GROUP BY 1")
def _(t):
    path = S.scratch(t.spark)
    S.write_table(t.fx_product_codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")), path)
    return S.read_events(t.spark, path, "code string, n long")


@query("s05_replace_table", "SELECT product_id, code FROM fx_product_codes WHERE score >= 100")
def _(t):
    path = S.scratch(t.spark)
    S.replace_table(t.fx_product_codes, path)
    S.replace_table(t.spark.read.parquet(path).where("score >= 100").select("product_id", "code"), path)
    return t.spark.read.schema("product_id long, code string").parquet(path)


@query("s06_group_files", """
SELECT product_id, lower(gender) AS gender, code FROM fx_products JOIN fx_product_codes USING (product_id)""")
def _(t):
    path = S.scratch(t.spark)
    d = t.fx_products.join(t.fx_product_codes, "product_id").select("product_id", F.lower("gender").alias("gender"), "code")
    S.write_groups(d, ["gender", "code"], path)
    return t.spark.read.schema("product_id long, gender string, code string").parquet(path)


def documents_as_lines(t):
    path = S.scratch(t.spark)
    t.fx_texts.select(F.concat("text", F.lit("\n")).alias("value")).write.text(path)
    return path


@query("s07_sentence_lines", r"""
WITH d AS (SELECT unnest(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t\f]*\n\s*')) AS v FROM fx_texts),
l AS (SELECT list_filter(list_transform(string_split(v, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(12))), lambda s: s <> '') AS l FROM d)
SELECT md5(array_to_string(l, chr(10))) AS doc_key, CAST(unnest(range(len(l))) AS INT) AS sent_no, unnest(l) AS text FROM l WHERE len(l) > 0""")
def _(t):
    d = S.read_sentences(t.spark, documents_as_lines(t))
    # the key names a file and place of this run: shown as the document's digest
    whole = d.groupBy("doc_key").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "text"))), lambda x: x["text"]), "\n")).alias("digest"))
    return d.join(whole, "doc_key").select(F.col("digest").alias("doc_key"), "sent_no", "text")


@query("s08_pair_lines", """
SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS text_a, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS text_b FROM part""")
def _(t):
    path = S.scratch(t.spark)
    line = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_brand", F.lit(" ||| "), "p_type"))
    t.part.select(line.alias("value")).write.text(path)
    return S.read_pairs(t.spark, path)


def write_lines(t, df, order):
    """One line per row in a stated order, over as many files as there are tasks."""
    path = S.scratch(t.spark)
    df.repartitionByRange(4, order).sortWithinPartitions(order).select("value").write.text(path)
    return path


@query("s09_nli_tsv", """
SELECT concat('dev-', CAST(row_number() OVER (ORDER BY p_partkey) - 0 AS VARCHAR)) AS guid, p_name AS text_a, p_brand AS text_b, CASE p_partkey % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'neutral' ELSE 'entailment' END AS label, 'xnli_dev' AS corpus FROM part
QUALIFY p_partkey % 2 = 0
UNION ALL SELECT concat('test-x', CAST(p_partkey AS VARCHAR)), p_name, p_brand, 'contradiction', 'mnli' FROM part""")
def _(t):
    head = t.spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("h").alias("value"))
    lang = F.when(F.col("p_partkey") % 2 == 0, "en").otherwise("fr")
    label = F.when(F.col("p_partkey") % 3 == 0, "contradictory").when(F.col("p_partkey") % 3 == 1, "neutral").otherwise("entailment")
    blank = [F.lit("")] * 4
    xnli = t.part.select(F.col("p_partkey").alias("k"), F.concat_ws("\t", lang, label, *blank, "p_name", "p_brand").alias("value"))
    mnli = t.part.select(F.col("p_partkey").alias("k"), F.concat_ws("\t", F.concat(F.lit("x"), F.col("p_partkey").cast("string")), *blank, *blank[:3], "p_name", "p_brand").alias("value"))
    a = S.read_corpus(t.spark, write_lines(t, xnli.unionByName(head), "k"), "xnli_dev", "dev", "en").withColumn("corpus", F.lit("xnli_dev"))
    b = S.read_corpus(t.spark, write_lines(t, mnli.unionByName(head), "k"), "mnli", "test").withColumn("corpus", F.lit("mnli"))
    return a.unionByName(b)


@query("s10_qa_json", r"""
WITH q AS (SELECT doc_id, text, doc_id % 4 = 0 AS bad, substr(text, 6, 10) AS answer FROM fx_texts),
w AS (SELECT *, len(list_filter(regexp_split_to_array(substr(text, 1, 6), '\s+'), lambda x: x <> '')) - 1 AS s, len(list_filter(regexp_split_to_array(substr(text, 1, 5 + length(answer)), '\s+'), lambda x: x <> '')) - 1 AS e,
 list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM q)
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN bad THEN '' ELSE answer END AS answer, CASE WHEN bad THEN -1 ELSE s END AS start_position, CASE WHEN bad THEN -1 ELSE e END AS end_position, len(ws) AS n_words FROM w
WHERE bad OR contains(array_to_string(ws[s + 1:e + 1], ' '), array_to_string(list_filter(regexp_split_to_array(answer, '\s+'), lambda x: x <> ''), ' '))""")
def _(t):
    path = S.scratch(t.spark)
    answer = F.struct(F.substring("text", 6, 10).alias("text"), F.lit(5).alias("answer_start"))
    bad = F.col("doc_id") % 4 == 0
    qa = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("what is said").alias("question"), bad.alias("is_impossible"),
                  F.when(bad, F.slice(F.array(answer), 1, 0)).otherwise(F.array(answer)).alias("answers"))
    entry = F.struct(F.array(F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))
    t.fx_texts.select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("value")).write.text(path)
    q = S.read_qa(t.spark, path)
    return q.select("id", "answer", F.col("start_position").cast("long").alias("start_position"), F.col("end_position").cast("long").alias("end_position"), F.size("words").cast("long").alias("n_words"))


@query("s11_parallel_files", """
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, p_name AS s1, p_type AS s2, CAST(p_partkey % 3 AS INT) AS label FROM part""")
def _(t):
    name = F.when(F.col("p_partkey") % 3 == 0, "entailment").when(F.col("p_partkey") % 3 == 1, "neutral").otherwise("contradiction")
    paths = [write_lines(t, t.part.select("p_partkey", F.col(c).alias("value") if isinstance(c, str) else c.alias("value")), "p_partkey") for c in ("p_name", "p_type", name)]
    return S.read_parallel(t.spark, *paths, {"entailment": 0, "neutral": 1, "contradiction": 2})


@query("s12_word_vectors", """
WITH v AS (SELECT concat('w', CAST(vec_id AS VARCHAR)) AS word, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS line_no FROM embeddings)
SELECT 'vocab' AS how, word, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 4) AS v0 FROM v WHERE word IN (SELECT concat('w', CAST(doc_id AS VARCHAR)) FROM documents WHERE lang = 'en')
UNION ALL SELECT 'first', word, len(embedding), round(CAST(embedding[1] AS DOUBLE), 4) FROM v WHERE line_no <= 100
UNION ALL SELECT 'first', '</s>', 2, 0.5""")
def _(t):
    word = F.concat(F.lit("w"), F.col("vec_id").cast("string"))
    lines = t.embeddings.select("vec_id", F.concat_ws(" ", word, F.concat_ws(" ", F.col("embedding").cast("array<string>"))).alias("value"))
    mark = t.spark.range(1).select(F.lit(1 << 40).alias("vec_id"), F.lit("</s> 0.5 0.5").alias("value"))
    path = write_lines(t, lines.unionByName(mark), "vec_id")
    vocab = t.documents.where("lang = 'en'").select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("word"))
    a = S.read_word_vectors(t.spark, path, vocab=vocab).withColumn("how", F.lit("vocab"))
    b = S.read_word_vectors(t.spark, path, first=100).withColumn("how", F.lit("first"))
    return a.unionByName(b).select("how", "word", F.size("vector").cast("long").alias("dims"), F.round(F.get("vector", F.lit(0)), 4).alias("v0"))


@query("s13_upsert_embeddings", """
WITH v AS (SELECT vec_id AS message_id, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 3 END AS version, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS f, embedding FROM embeddings
 UNION ALL SELECT vec_id + 1000000000, 2, 2, embedding FROM embeddings WHERE vec_id % 2 = 1)
SELECT message_id, version, CAST(dim AS INT) AS dim, round(CAST(x AS DOUBLE) * f, 5) AS v FROM (SELECT *, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM v)""")
def _(t):
    """Stored vectors have version 3, new ones 2: a new row replaces all the same."""
    path = S.scratch(t.spark)
    e = t.embeddings.select(F.col("vec_id").alias("message_id"), (F.col("vec_id") % 10).alias("conversation_id"), F.lit(0).alias("message_index"), F.lit("text").alias("rpr_key"),
                            F.col("embedding").cast("array<double>").alias("vector"))
    S.replace_table(e.withColumn("version", F.lit(3)), path)
    new = e.withColumn("version", F.lit(2)).withColumn("vector", F.transform("vector", lambda x: x * 2)).withColumn(
        "message_id", F.when(F.col("message_id") % 2 == 0, F.col("message_id")).otherwise(F.col("message_id") + 1000000000))
    S.replace_table(S.upsert(t.spark.read.parquet(path), new, ["message_id", "conversation_id", "message_index", "rpr_key"], "version"), path)
    return t.spark.read.parquet(path).select("message_id", "version", F.posexplode("vector").alias("dim", "v")).withColumn("v", F.round("v", 5))


@query("s14_results_log", "SELECT version, pooling, metric, v FROM ck_results UNION ALL SELECT version, pooling, concat(metric, '_again'), v FROM ck_results")
def _(t):
    path = S.scratch(t.spark)
    r = PV.results(t).withColumn("run", F.struct(F.col("version"), F.col("pooling"))).drop("version", "pooling")
    S.append_results(r, path)
    S.append_results(r.withColumn("metric", F.concat("metric", F.lit("_again"))), path)
    return t.spark.read.parquet(path).select("run.version", "run.pooling", "metric", "v")


@query("s15_copy_referenced", """
SELECT doc_id, (SELECT count(DISTINCT message_id) FROM fx_tags WHERE message_id NOT IN (SELECT doc_id FROM documents)) AS missing FROM documents WHERE doc_id IN (SELECT message_id FROM fx_tags)""")
def _(t):
    m = t.documents.select(F.col("doc_id").alias("message_id"), "doc_id")
    kept, missing = S.copy_referenced(t.fx_tags, m, "message_id")
    return kept.select("doc_id", F.lit(1).alias("_k")).join(F.broadcast(missing.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row


@query("s16_query_table", """
SELECT q_id, id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS r FROM ck_hits) WHERE r <= 5""")
def _(t):
    queries, ranked = S.scratch(t.spark), S.scratch(t.spark)
    S.write_table(PV.first_of_intent(t).select(F.col("id").cast("string").alias("query")), queries)
    q = S.read_events(t.spark, queries, "query string").select(F.col("query").cast("long").alias("id")).join(PV.vecs(t), "id")
    S.write_table(R.top_k_similar(PV.vecs(t), q, 5), ranked)
    return S.read_events(t.spark, ranked, "q_id long, id long, score double, rank int").withColumn("score", F.round("score", 6))


@query("s17_token_vectors", """
SELECT vec_id, CAST(i // 16 AS INT) AS tok, CAST(layer AS INT) AS layer, CAST(i % 16 AS INT) AS dim, round(CAST(x AS DOUBLE) * CASE layer WHEN -1 THEN 1 ELSE 0.5 END, 6) AS v
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), (VALUES (-1), (-2)) l(layer)""")
def _(t):
    """Every vector as tokens of 16 numbers, in two layers."""
    path = S.scratch(t.spark)
    n = F.ceil(F.size("embedding") / 16).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(F.col("embedding"), k * 16 + 1, F.lit(16)))
    d = t.embeddings.select("vec_id", F.transform(cut, lambda _, k: F.concat(F.lit("t"), k.cast("string"))).alias("tokens"), cut.alias("a"),
                            F.transform(cut, lambda v: F.transform(v, lambda x: x.cast("double") * 0.5)).alias("b"))
    S.token_layers(d, "vec_id", "tokens", {-1: "a", -2: "b"}).write.parquet(path)
    back = t.spark.read.parquet(path).select("vec_id", F.posexplode("features").alias("tok", "f"))
    back = back.select("vec_id", "tok", F.explode("f.layers").alias("l"))
    return back.select("vec_id", "tok", F.col("l.index").alias("layer"), F.posexplode("l.values").alias("dim", "v"))
