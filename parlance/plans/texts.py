"""Text jobs (X), word counts (A23, A53) and label queries."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import rates as R
from parlance.operators import textjobs as J
from parlance.plans.registry import check_view, query
from parlance.session import pinned

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
check_view("ck_words", """
SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM fx_texts""")
check_view("ck_clean", f"""
SELECT doc_id, lang, source, trim(regexp_replace({'replace(' * len(T.CONTRACTIONS)}lower(text){''.join(", '" + a.replace("'", "''") + "', '" + b + "')" for a, b in T.CONTRACTIONS)}, '[^a-zA-Z0-9 ]', '', 'g'), ' ') AS text FROM fx_texts""")


def tokens(t):
    """One row per document with its words."""
    return t.texts.select("doc_id", "lang", "source", T.split_words("text").alias("ws"))


@query("x01_clean_text", "SELECT doc_id, md5(text) AS text_key, length(text) AS n FROM ck_clean")
def _(t):
    d = t.texts.select("doc_id", T.clean_text("text").alias("text"))
    return d.select("doc_id", F.md5("text").alias("text_key"), F.length("text").cast("long").alias("n"))


@query("x02_words", f"""
SELECT doc_id, md5(array_to_string(w, ' ')) AS words_key, len(w) AS n FROM (SELECT doc_id, list_filter(list_transform(list_filter(ws, lambda x: x NOT IN ('yes', 'new', 'search') AND regexp_full_match(x, '\\p{{L}}+')), lambda x: lower(x)), lambda x: x NOT IN ({STOP})) AS w FROM ck_words)""")
def _(t):
    d = t.texts.select("doc_id", T.words("text").alias("w"))
    return d.select("doc_id", F.md5(F.array_join("w", " ")).alias("words_key"), F.size("w").cast("long").alias("n"))


@query("x03_trigrams", f"""
SELECT doc_id, md5(array_to_string(g, ' ')) AS grams_key, len(g) AS n FROM (SELECT doc_id, flatten(list_transform(list_filter(string_split(text, ' '), lambda w: w <> '' AND w NOT IN ({STOP})),
 lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(concat('#', w, '#'), i, 3)))) AS g FROM ck_clean)""")
def _(t):
    g = T.label_trigrams(T.clean_text("text"))
    d = t.texts.select("doc_id", g.alias("g"))
    return d.select("doc_id", F.md5(F.array_join("g", " ")).alias("grams_key"), F.size("g").cast("long").alias("n"))


@query("x04_count_vectors", """
SELECT doc_id, token, count(*) AS n, 1 AS present FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM fx_texts) GROUP BY 1, 2""")
def _(t):
    return J.token_counts(t.texts.select("doc_id", T.pattern_tokens("text").alias("tokens")), "doc_id", "tokens", t.fx_texts).withColumn("present", F.lit(1))


check_view("ck_label_ids", "SELECT source, row_number() OVER (ORDER BY f) - 1 AS id FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY 1)")


@query("x05_label_ids", "SELECT doc_id, source, id FROM documents JOIN ck_label_ids USING (source)")
def _(t):
    ids = J.label_ids(t.documents, "source", "doc_id")
    return t.documents.select("doc_id", "source").join(ids, "source").select("doc_id", "source", "id")


@query("x06_augment_rare", """
WITH s AS (SELECT DISTINCT word, concat(word, 'ly') AS synonym FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) AS word FROM benchmark) WHERE length(word) > 5),
l AS (SELECT doc_id, concat(source, '-', lang) AS label, text FROM ck_clean), r AS (SELECT label FROM l GROUP BY 1 HAVING count(*) < 100),
tok AS (SELECT doc_id, label, text, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM l WHERE label IN (SELECT label FROM r)),
v AS (SELECT doc_id, label, any_value(text) AS old, trim(string_agg(coalesce(synonym, word), ' ' ORDER BY i), ' ') AS text FROM tok LEFT JOIN s USING (word) GROUP BY 1, 2)
SELECT doc_id, label, 0 AS variant, md5(text) AS text_key FROM l UNION ALL SELECT doc_id, label, 1, md5(text) FROM v WHERE text <> old""")
def _(t):
    w = t.benchmark.select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")).alias("word")).where(F.length("word") > 5)
    syn = w.distinct().withColumn("synonym", F.concat("word", F.lit("ly")))
    d = t.texts.select("doc_id", F.concat_ws("-", "source", "lang").alias("label"), "text")
    return J.augment_rare(d, "doc_id", "label", "text", syn).select("doc_id", "label", "variant", F.md5("text").alias("text_key"))


# word vectors of the benchmark words: the embedding of word number n mod (number of vectors)
check_view("ck_known", "SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark")


def known(t):
    return t.benchmark.select(F.explode(F.split("text", " ")).alias("word")).distinct()


@query("x07_vocabulary", """
WITH v AS (SELECT DISTINCT unnest(ws) AS word FROM ck_words UNION SELECT '<s>' UNION SELECT '</s>')
SELECT word, CAST(word IN (SELECT word FROM ck_known) AS INT) AS found FROM v""")
def _(t):
    return J.with_vectors(J.vocabulary(tokens(t), F.col("ws")), known(t))


@query("x08_known_words", """
WITH t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM ck_words),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS ws, count(*) AS n FROM t WHERE word IN (SELECT word FROM ck_known) GROUP BY 1)
SELECT w.doc_id, len(w.ws) + 2 AS total, coalesce(n, 1) AS kept, md5(coalesce(k.ws, '</s>')) AS words_key FROM ck_words w LEFT JOIN k USING (doc_id)""")
def _(t):
    k = J.known_words(tokens(t), "doc_id", F.col("ws"), known(t))
    return k.select("doc_id", F.col("total").cast("long").alias("total"), F.col("kept").cast("long").alias("kept"),
                    F.md5(F.array_join("words", " ")).alias("words_key")).orderBy(F.desc("kept"), "doc_id")


@query("x09_basic_tokens", "SELECT doc_id, md5(array_to_string(w, ' ')) AS tokens_key, len(w) AS n FROM ck_basic")
def _(t):
    d = t.texts.select("doc_id", T.basic_tokens("text").alias("w"))
    return d.select("doc_id", F.md5(F.array_join("w", " ")).alias("tokens_key"), F.size("w").cast("long").alias("n"))


def vocab(t):
    """Pieces of the benchmark words: whole words, endings and single characters."""
    w = t.benchmark.select(F.explode(T.basic_tokens("text")).alias("w"))
    n = F.length("w")
    pieces = F.concat(F.array("w"), F.array(F.substring("w", 1, 2), F.concat(F.lit("##"), F.expr("right(w, 2)"))),
                      F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.when(i > 1, "##").otherwise(""), F.substring("w", i, F.lit(1)))))
    return w.select(F.explode(pieces).alias("piece")).distinct()


check_view("ck_basic", r"""
SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(text, '[\t\n\r]', ' ', 'g'))), '[\p{Cc}\p{Cf}]', '', 'g'), '([\p{P}$+<=>^`|~])', ' \1 ', 'g'), ' '), lambda w: w <> '') AS w FROM fx_texts""")
check_view("ck_bench_basic", r"""
SELECT DISTINCT w FROM (SELECT unnest(list_filter(string_split(regexp_replace(strip_accents(lower(regexp_replace(text, '[\t\n\r]', ' ', 'g'))), '([\p{P}$+<=>^`|~])', ' \1 ', 'g'), ' '), lambda w: w <> '')) AS w FROM benchmark)""")


@query("x10_wordpiece", """
WITH RECURSIVE v AS (SELECT w AS piece FROM ck_bench_basic UNION SELECT substr(w, 1, 2) FROM ck_bench_basic UNION SELECT concat('##', right(w, 2)) FROM ck_bench_basic
 UNION SELECT concat(CASE WHEN i > 1 THEN '##' ELSE '' END, substr(w, i, 1)) FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM ck_bench_basic)),
d AS (SELECT DISTINCT unnest(w) AS word FROM ck_basic),
r AS (SELECT word, CAST(1 AS BIGINT) AS pos, '' AS pieces, CAST(0 AS BIGINT) AS n FROM d WHERE length(word) <= 200
 UNION ALL SELECT word, pos + max(l), concat(any_value(pieces), CASE WHEN pos > 1 THEN ' ##' ELSE '' END, substr(word, pos, max(l))), any_value(n) + 1 FROM (
  SELECT word, pos, pieces, n, l FROM (SELECT word, pos, pieces, n, unnest(range(1, length(word) - pos + 2)) AS l FROM r WHERE pos <= length(word)) c
  JOIN v ON v.piece = concat(CASE WHEN pos > 1 THEN '##' ELSE '' END, substr(word, pos, l))) GROUP BY word, pos)
SELECT d.word, coalesce(r.pieces, '[UNK]') AS pieces, CAST(coalesce(r.n, 1) AS INT) AS n FROM d LEFT JOIN r ON r.word = d.word AND r.pos = length(d.word) + 1""")
def _(t):
    w = t.texts.select(F.explode(T.basic_tokens("text")).alias("word"))
    return J.wordpieces(w, vocab(t)).select("word", F.array_join("pieces", " ").alias("pieces"), F.size("pieces").alias("n"))


check_view("ck_pairs_ab", """
SELECT doc_id, ws[1:len(ws) // 2] AS a, ws[len(ws) // 2 + 1:] AS b, CAST(len(ws) // 2 AS INT) AS na, CAST(len(ws) - len(ws) // 2 AS INT) AS nb FROM ck_words""")


check_view("ck_vocab", """
SELECT word, row_number() OVER (ORDER BY word) + 99 AS id FROM ck_known UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]']), unnest(range(4))""")


def id_vocab(t):
    """(word, id): the special tokens first, then the known words from 100 on."""
    special = t.spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3)], "word string, id long")
    return J.word_ids(known(t)).select("word", (F.col("id") + 100).alias("id")).unionByName(special)


@query("x11_to_features", """
WITH c AS (SELECT *, CASE WHEN na + nb > 125 THEN least(na, greatest(63, 125 - nb)) ELSE na END AS ka, CASE WHEN na + nb > 125 THEN least(nb, greatest(62, 125 - na)) ELSE nb END AS kb FROM ck_pairs_ab),
k AS (SELECT doc_id, ka, kb, list_concat(['[CLS]'], a[1:ka], ['[SEP]'], b[1:kb], ['[SEP]']) AS t FROM c),
e AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS i FROM k),
i AS (SELECT doc_id, list(coalesce(v.id, 1) ORDER BY i) AS ids FROM e LEFT JOIN ck_vocab v ON v.word = e.word GROUP BY 1)
SELECT doc_id, md5(array_to_string(t, ' ')) AS tokens_key, CAST(ka + kb + 3 AS BIGINT) AS n_mask, CAST(kb + 1 AS BIGINT) AS n_second,
  md5(array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda x: CAST(0 AS BIGINT))), ' ')) AS ids_key FROM k JOIN i USING (doc_id)""")
def _(t):
    half = F.floor(F.size("ws") / 2).cast("int")
    d = tokens(t).select("doc_id", F.slice("ws", F.lit(1), half).alias("a"), F.slice("ws", half + 1, F.size("ws")).alias("b"))
    f = T.model_features(F.col("a"), F.col("b"), 128)
    add = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("long")
    d = d.select("doc_id", f["tokens"].alias("tokens"), add(f["mask"]).alias("n_mask"), add(f["segments"]).alias("n_second"))
    ids = J.token_ids(d, ["doc_id"], "tokens", id_vocab(t), 128).select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_key"))
    return d.join(ids, "doc_id").select("doc_id", F.md5(F.array_join("tokens", " ")).alias("tokens_key"), "n_mask", "n_second", "ids_key")


# window settings of the checks: at most 64 tokens, stride 24, query of doc_id % 8 tokens
N_MAX, STRIDE = 64, 24


def long_docs(t):
    return tokens(t).where(F.size("ws") > 0).select("doc_id", "ws", F.size("ws").alias("len"), (F.col("doc_id") % 8).cast("int").alias("q"))


check_view("ck_spans", """
SELECT doc_id, i AS span, i * step AS start, least(room, len - i * step) AS length, q, len, room, step, n FROM (
SELECT *, unnest(range(n)) AS i FROM (SELECT doc_id, q, len, room, least(room, 24) AS step, CAST(1 + greatest(0, ceil((len - room) * 1.0 / least(room, 24))) AS BIGINT) AS n FROM (
SELECT doc_id, len(ws) AS len, doc_id % 8 AS q, 64 - doc_id % 8 - 3 AS room FROM ck_words WHERE len(ws) > 0)))""")


def spans(t):
    return J.doc_spans(long_docs(t), "doc_id", F.col("len"), F.col("q"), N_MAX, STRIDE)


def longs(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query("x12_doc_spans", "SELECT doc_id, CAST(span AS BIGINT) AS span, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length FROM ck_spans")
def _(t):
    return longs(spans(t), "span", "start", "length")


check_view("ck_best", """
SELECT doc_id, start + k AS tok, span, row_number() OVER (PARTITION BY doc_id, start + k ORDER BY least(k, length - 1 - k) + 0.01 * length DESC, span) AS r
FROM (SELECT *, unnest(range(length)) AS k FROM ck_spans)""")


@query("x12_best_context", "SELECT doc_id, CAST(tok AS BIGINT) AS tok, CAST(span AS BIGINT) AS span FROM ck_best WHERE r = 1")
def _(t):
    return longs(J.best_context(long_docs(t), "doc_id", F.col("len"), F.col("q"), N_MAX, STRIDE), "tok", "span")


@query("x12_subtoken_map", """
WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS word_no FROM ck_words),
p AS (SELECT doc_id, word_no, unnest(range((length(w) + 3) // 4)) AS i, w FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_no, i) - 1 AS tok, word_no, substr(w, i * 4 + 1, 4) AS piece FROM p""")
def _(t):
    # pieces of four characters stand in for word pieces
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w), F.lit(4)), lambda i: F.substring(w, i, F.lit(4)))
    d = tokens(t).select("doc_id", F.transform("ws", cut).alias("p"))
    return longs(J.subtoken_map(d, "doc_id", "p"), "tok", "word_no")


@query("x13_span_labels", """
SELECT doc_id, CAST(span AS BIGINT) AS span, CAST(CASE WHEN ok THEN s - start + q + 2 ELSE 0 END AS BIGINT) AS start_position, CAST(CASE WHEN ok THEN e - start + q + 2 ELSE 0 END AS BIGINT) AS end_position FROM (
SELECT *, s >= start AND e < start + length AS ok FROM (SELECT *, len // 3 AS s, least(len // 3 + 2, len - 1) AS e FROM ck_spans))""")
def _(t):
    third = F.floor(F.col("len") / 3).cast("int")
    a = long_docs(t).select("doc_id", third.alias("tok_start"), F.least(third + 2, F.col("len") - 1).alias("tok_end"), "q")
    return longs(J.span_labels(spans(t), a, "doc_id", "q"), "span", "start_position", "end_position")


@query("x13_tighten", """
WITH d AS (SELECT doc_id, ws, len(ws) // 3 AS lo, len(ws) - 1 AS hi, (2 * len(ws)) // 3 AS a FROM ck_words WHERE len(ws) > 0),
x AS (SELECT *, least(3, len(ws) - a) AS m, array_to_string(ws[a + 1:a + 3], ' ') AS answer FROM d),
h AS (SELECT *, list_min(list_filter(range(lo, hi - m + 2), lambda i: array_to_string(ws[i + 1:i + m], ' ') = answer)) AS hit FROM x)
SELECT doc_id, CAST(coalesce(hit, lo) AS BIGINT) AS tok_start, CAST(coalesce(hit + m - 1, hi) AS BIGINT) AS tok_end FROM h""")
def _(t):
    third = F.floor(F.col("len") / 3).cast("int")
    d = long_docs(t).select("doc_id", "ws", third.alias("tok_start"), (F.col("len") - 1).alias("tok_end"), F.floor(2 * F.col("len") / 3).cast("int").alias("a"))
    d = d.withColumn("answer", F.array_join(F.slice("ws", F.col("a") + 1, F.lit(3)), " "))
    return longs(J.tighten(d, "ws", "tok_start", "tok_end", F.col("answer")).select("doc_id", "tok_start", "tok_end"), "tok_start", "tok_end")


N_BEST, MAX_LEN = 5, 8


def _stand_in(a, b, m):
    """Numbers that stand in for a model's scores of the tokens of a window."""
    @F.arrow_udf("array<double>")
    def scores(doc: pa.Array, span: pa.Array, start: pa.Array, length: pa.Array) -> pa.Array:
        doc, span, start, length = (c.to_numpy().astype(np.int64) for c in (doc, span, start, length))
        cuts = np.concatenate(([0], np.cumsum(length)))
        row = np.repeat(np.arange(len(length)), length)
        tok = start[row] + np.arange(cuts[-1]) - cuts[row]
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.fmod(tok * a + (doc * b + span)[row], m) / 10.0))
    return scores


@query("x14_best_spans", f"""
WITH sc AS (SELECT b.doc_id, b.span, b.tok, ((b.tok * 37 + b.doc_id * 11 + b.span) % 101) / 10.0 AS sl, ((b.tok * 53 + b.doc_id * 7 + b.span) % 97) / 10.0 AS el, b.r = 1 AS is_max FROM ck_best b),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, span ORDER BY sl DESC, tok) AS k FROM sc) WHERE k <= {N_BEST} AND is_max),
en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, span ORDER BY el DESC, tok) AS k FROM sc) WHERE k <= {N_BEST}),
pr AS (SELECT st.doc_id, array_to_string(ws[st.tok + 1:en.tok + 1], ' ') AS text, st.sl + en.el AS score FROM st JOIN en USING (doc_id, span) JOIN ck_words w ON w.doc_id = st.doc_id WHERE en.tok >= st.tok AND en.tok - st.tok + 1 <= {MAX_LEN}),
tx AS (SELECT doc_id, text, max(score) AS score FROM pr GROUP BY 1, 2 UNION ALL SELECT doc_id, '', (doc_id % 13) * 1.0 FROM ck_words WHERE len(ws) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, text) AS r FROM tx),
kp AS (SELECT doc_id, text, score, CASE WHEN r <= {N_BEST} THEN r ELSE {N_BEST + 1} END AS rank FROM rk WHERE r <= {N_BEST} OR text = '')
SELECT doc_id, CAST(rank AS INT) AS rank, text, round(score, 4) AS score, round(exp(score - max(score) OVER (PARTITION BY doc_id)) / sum(exp(score - mx)) OVER (PARTITION BY doc_id), 6) AS probability,
  coalesce(max(CASE WHEN text = '' THEN score END) OVER (PARTITION BY doc_id) - max(CASE WHEN text <> '' THEN score END) OVER (PARTITION BY doc_id) > 0, true) AS no_answer
FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS mx FROM kp)""")
def _(t):
    d = pinned(long_docs(t))  # read three times
    w = J.window_flags(d, "doc_id", F.col("len"), F.col("q"), N_MAX, STRIDE)
    at = lambda a, b, m: _stand_in(a, b, m)("doc_id", "span", "start", "length")
    sc = w.select("doc_id", "start", "is_max", at(37, 11, 101).alias("start_logits"), at(53, 7, 97).alias("end_logits"))
    nulls = d.select("doc_id", (F.col("doc_id") % 13).cast("double").alias("null_score"))
    b = J.best_spans(sc, d.select("doc_id", F.col("ws").alias("words")), nulls, "doc_id", N_BEST, MAX_LEN)
    return b.select("doc_id", "rank", "text", F.round("score", 4).alias("score"), F.round("probability", 6).alias("probability"), "no_answer")


def sentences(t):
    lines = F.filter(F.split("text", "\n"), lambda s: F.length(F.trim(s)) > 0)
    return t.texts.select("doc_id", F.filter(F.transform(lines, T.split_words), lambda s: F.size(s) > 0).alias("sentences"))


UNIT = "(CAST(concat('0x', substr(md5(concat_ws(':', {})), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def drawn(*parts):
    """The check's number in [0, 1) of an instance or document."""
    return UNIT.format("'1', name, " + ", ".join(parts))


CHUNK = f"""SELECT *, CASE WHEN random THEN p0 + a_len ELSE stop END AS nxt FROM (
 SELECT *, CASE WHEN stop - p0 >= 2 THEN 1 + CAST(floor({drawn("'a'", "CAST(p0 AS VARCHAR)")} * (stop - p0 - 1)) AS BIGINT) ELSE 1 END AS a_len, stop - p0 = 1 OR {drawn("'next'", "CAST(p0 AS VARCHAR)")} < 0.5 AS random FROM (
 SELECT *, coalesce(list_min(list_filter(range(p0 + 1, n + 1), lambda j: cum[j + 1] - cum[p0 + 1] >= target)), n) AS stop FROM ({{}})))"""


@query("x15_pair_instances", f"""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda l: length(trim(l, ' ')) > 0), lambda l: list_filter(regexp_split_to_array(l, '\\s+'), lambda w: w <> '')), lambda l: len(l) > 0) AS ss FROM fx_texts),
d AS (SELECT doc_id, ss, len(ss) AS n, list_transform(range(0, len(ss) + 1), lambda j: CAST(coalesce(list_sum(list_transform(ss[1:j], lambda x: len(x))), 0) AS BIGINT)) AS cum,
  row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS m FROM s WHERE len(ss) > 0),
t AS (SELECT *, CASE WHEN {drawn("'short'")} < 0.1 THEN 2 + CAST(floor({drawn("'len'")} * 60) AS BIGINT) ELSE 61 END AS target FROM (SELECT doc_id, n, cum, c, concat(CAST(doc_id AS VARCHAR), ':', CAST(c AS VARCHAR)) AS name FROM d, unnest(range(2)) AS u(c))),
w AS ({CHUNK.format("SELECT doc_id, c, name, target, n, cum, CAST(0 AS BIGINT) AS inst, CAST(0 AS BIGINT) AS p0 FROM t")}
 UNION ALL {CHUNK.format("SELECT doc_id, c, name, target, n, cum, inst + 1 AS inst, nxt AS p0 FROM w WHERE nxt < n")}),
p AS (SELECT w.*, d.ss, pos, m, flatten(d.ss[p0 + 1:p0 + a_len]) AS a, 1 + CAST(floor({drawn("'other'", "CAST(inst AS VARCHAR)")} * (m - 1)) AS BIGINT) AS pk FROM w JOIN d USING (doc_id)),
o AS (SELECT p.*, o.ss AS oss FROM p JOIN d o ON o.pos = pk + CASE WHEN pk >= p.pos AND p.m > 1 THEN 1 ELSE 0 END),
b AS (SELECT *, CASE WHEN random THEN flatten(oss[CAST(floor({drawn("'start'", "CAST(inst AS VARCHAR)")} * len(oss)) AS BIGINT) + 1:])[1:greatest(target - len(a), 1)] ELSE flatten(ss[p0 + a_len + 1:stop]) END AS b FROM o),
l AS (SELECT *, CASE WHEN len(a) + len(b) > 61 THEN least(len(a), greatest(31, 61 - len(b))) ELSE len(a) END AS na, CASE WHEN len(a) + len(b) > 61 THEN least(len(b), greatest(30, 61 - len(a))) ELSE len(b) END AS nb FROM b),
f AS (SELECT *, CAST(floor({drawn("'fa'", "CAST(inst AS VARCHAR)")} * (len(a) - na + 1)) AS BIGINT) AS fa, CAST(floor({drawn("'fb'", "CAST(inst AS VARCHAR)")} * (len(b) - nb + 1)) AS BIGINT) AS fb FROM l)
SELECT doc_id, CAST(c AS INT) AS copy, CAST(inst AS INT) AS instance, random AS is_random, CAST(na AS INT) AS n_a, CAST(nb AS INT) AS n_b,
  md5(array_to_string(list_concat(list_append(a[fa + 1:fa + na], '|'), b[fb + 1:fb + nb]), ' ')) AS tokens_key FROM f""")
def _(t):
    p = J.pair_instances(sentences(t), "doc_id", n_max=64, copies=2)
    return p.select("doc_id", "copy", "instance", "is_random", F.size("a").alias("n_a"), F.size("b").alias("n_b"),
                    F.md5(F.array_join(F.concat("a", F.array(F.lit("|")), "b"), " ")).alias("tokens_key"))


@query("x16_masked_tokens", f"""
WITH tk AS (SELECT doc_id, w, concat(CAST(doc_id AS VARCHAR), '#', CAST(w AS VARCHAR)) AS k, list_concat(['[CLS]'], ws[62 * w + 1:62 * w + 62], ['[SEP]']) AS t FROM ck_words, unnest(range((len(ws) + 61) // 62)) AS u(w)),
c AS (SELECT doc_id, w, k, unnest(t) AS label, unnest(range(len(t))) AS pos, len(t) AS n FROM tk),
h AS (SELECT *, {UNIT.format("'1', k, CAST(pos AS VARCHAR)")} AS h FROM c WHERE label NOT IN ('[CLS]', '[SEP]')),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, pos) AS r FROM h),
m AS (SELECT *, {UNIT.format("'1', 'kind', k, CAST(pos AS VARCHAR)")} AS kind FROM r WHERE r <= least(20, greatest(1, CAST(round_even(n * 0.15, 0) AS INT)))),
v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM ck_known),
o AS (SELECT m.*, CAST(floor({UNIT.format("'1', 'word', k, CAST(pos AS VARCHAR)")} * (SELECT count(*) FROM v)) AS BIGINT) AS id FROM m)
SELECT doc_id, CAST(w AS INT) AS window, CAST(pos AS INT) AS pos, label, CASE WHEN kind < 0.8 THEN '[MASK]' WHEN kind < 0.9 THEN label ELSE v.word END AS token FROM o LEFT JOIN v USING (id)""")
def _(t):
    w = J.token_windows(tokens(t), "doc_id", "ws", 62).withColumn("key", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("window").cast("string")))
    m = J.masked_tokens(w, "key", "tokens", J.word_ids(known(t)))
    return m.select(F.split_part("key", F.lit("#"), F.lit(1)).cast("long").alias("doc_id"), F.split_part("key", F.lit("#"), F.lit(2)).cast("int").alias("window"), "pos", "label", "token")


@query("x17_training_text_stats", """
WITH d AS (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings),
b AS (SELECT label, dim, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label, dim ORDER BY v DESC, vec_id) AS r FROM d) WHERE r = 1)
SELECT label, vec_id, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM b GROUP BY 1, 2""")
def _(t):
    return J.importance_share(t.embeddings, "label", "vec_id", "embedding").withColumn("share", F.round("share", 6))


@query("a23_word_counts", f"""
SELECT lang, word, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (
SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_transform(list_filter(ws, lambda x: x NOT IN ('yes', 'new', 'search') AND regexp_full_match(x, '\\p{{L}}+')), lambda x: lower(x))) AS word FROM ck_words) WHERE word NOT IN ({STOP}) GROUP BY 1, 2)) WHERE rank <= 30""")
def _(t):
    return R.top_words(t.texts.select("lang", F.explode(T.words("text")).alias("word")), ["lang"], 30)


@query("a23_text_counts", "SELECT message AS text, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM fx_user GROUP BY 1")
def _(t):
    return R.count_share(t.fx_user.select(F.col("message").alias("text")), ["text"]).withColumn("share", F.round("share", 6))


@query("a53_label_word_freq", f"""
SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split(text, ' '), lambda w: w <> '' AND w NOT IN ({STOP}))) AS word FROM ck_clean WHERE source = 'src0') GROUP BY 1""")
def _(t):
    w = F.filter(F.split(T.clean_text("text"), " "), lambda x: (x != "") & ~x.isin(T.STOP_WORDS))
    return t.texts.where(F.col("source") == "src0").select(F.explode(w).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("t05_top_words", "SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM ck_words) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def _(t):
    return R.top_words(t.texts.select(F.explode(T.split_words("text")).alias("word")), [], 50)
