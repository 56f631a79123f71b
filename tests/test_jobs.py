"""Jobs against brute force on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import metrics as ME
from parlance.functions import vectors as V
from parlance.operators import sequence as Q
from parlance.operators import models as M
from parlance.operators import retrieval as R
from parlance.operators import sampling as S
from parlance.operators import textjobs as J
from parlance.sources import files


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows.append((60, 0, rows[7][2]))  # an exact copy ties
    return spark.createDataFrame(rows, "id long, intent long, vector array<double>")


def cos(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("query_rows,slice_rows", [(1000, 1000), (3, 11)])
def test_top_k(spark, vecs, query_rows, slice_rows):
    queries = vecs.where("id < 8")
    data = {r.id: r.vector for r in vecs.collect()}
    got = R.top_k_similar(vecs, queries, 5, drop_self=True, query_rows=query_rows, slice_rows=slice_rows).collect()
    for q in range(8):
        want = sorted(((-round(cos(data[q], v), 9), i) for i, v in data.items() if i != q))[:5]
        mine = sorted((r.rank, r.id) for r in got if r.q_id == q)
        assert [i for _, i in mine] == [i for _, i in want]
        scores = [r.score for r in sorted((r for r in got if r.q_id == q), key=lambda r: r.rank)]
        assert scores == sorted(scores, reverse=True)


def test_cosine_symmetric(vecs):
    a = vecs.alias("a").crossJoin(vecs.where("id < 3").alias("b"))
    r = a.select(F.max(F.abs(V.cosine("a.vector", "b.vector") - V.cosine("b.vector", "a.vector"))).alias("d"), F.max(V.angular("a.vector", "b.vector")).alias("m")).first()
    assert r.d < 1e-12 and r.m <= 1.0


def test_pooling_none(vecs):
    tok = vecs.withColumn("mask", F.lit(1))
    r = R.pooled(tok, "intent", "id", "vector", "mask", "none").where("intent = 1").first()
    assert len(r.vector) == 20 * 6


def test_split_disjoint_and_complete(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "id int, label string")
    for hot in (None, 20):
        s = S.stratified_split(df, "id", "label", 0.2, 0.3, hot_rows=hot)
        n = {(r.label, r.part): r.n for r in s.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
        assert n == {("a", "test"): 40, ("a", "dev"): 48, ("a", "train"): 112, ("b", "test"): 20, ("b", "dev"): 24, ("b", "train"): 56}
    f = S.stratified_folds(df, "id", "label").groupBy("label", "fold").count().collect()
    assert all(abs(r["count"] - (200 if r.label == "a" else 100) / 3) < 1 for r in f)


def tree(rows, n_size, depth, min_leaf=5):
    """Brute-force tree on (label, items, weight): list of (path, cover, pos, neg)."""
    def gini(rs):
        p, q = sum(w for y, _, w in rs if y), sum(w for y, _, w in rs if not y)
        return 2 * p * q / (p + q) if p + q else 0.0
    best = None
    if depth:
        for item in sorted({i for _, its, _ in rows for i in its}):
            has, no = [r for r in rows if item in r[1]], [r for r in rows if item not in r[1]]
            if min(len(has), len(no)) < min_leaf:
                continue
            gain = round((gini(rows) - gini(has) - gini(no)) / n_size, 9)
            if gain > 0.01 and (best is None or gain > best[0]):
                best = (gain, item, has, no)
    if best is None:
        return [((), len(rows), sum(w for y, _, w in rows if y), sum(w for y, _, w in rows if not y))]
    _, item, has, no = best
    return ([((f"{item}>=0.5",) + p, *x) for p, *x in tree(has, n_size, depth - 1)] + [((f"{item}< 0.5",) + p, *x) for p, *x in tree(no, n_size, depth - 1)])


def test_group_trees(spark):
    rnd = random.Random(4)
    rows = []
    for g in ("x", "y", "only"):
        for i in range(120):
            items = [t for t in "abcde" if rnd.random() < 0.5]
            y = 1 if g == "only" else int(("a" in items and "b" not in items) or rnd.random() < 0.2)
            rows.append((g, y, items))
    df = spark.createDataFrame(rows, "g string, label int, items array<string>")
    got = {(r.g, tuple(r.path)): (r.cover, round(r.prob, 6)) for r in M.group_trees(df, ["g"], "items", depth=3).collect()}
    want = {}
    for g in ("x", "y", "only"):
        mine = [r for r in rows if r[0] == g]
        n1 = sum(r[1] for r in mine)
        weighted = [(y, its, len(mine) / (n1 if y else len(mine) - n1)) for _, y, its in mine]
        for path, cover, p, q in tree(weighted, len(mine), 3):
            want[(g, path)] = (cover, round(p / (p + q), 6))
    assert got == want
    leaves = M.group_trees(df, ["g"], "items", depth=3)
    hit = M.rule_of_row(df.withColumn("id", F.monotonically_increasing_id()), ["g"], "items", leaves)
    assert hit.count() == hit.select("id").distinct().count() == len(rows)
    rules = M.tree_rules(leaves, ["g"]).where("g = 'only'").first()
    assert rules.rule == "all" and rules.prob == 1.0


def test_group_trees_until_no_node_splits(spark):
    rnd = random.Random(6)
    rows = [("x", [t for t in "abcdef" if rnd.random() < 0.85]) for _ in range(600)]
    rows = [(g, int(len(its) == 6), its) for g, its in rows]
    df = spark.createDataFrame(rows, "g string, label int, items array<string>")
    n1 = sum(r[1] for r in rows)
    weighted = [(y, its, len(rows) / (n1 if y else len(rows) - n1)) for _, y, its in rows]
    want = {p: cover for p, cover, _, _ in tree(weighted, len(rows), 30)}
    assert max(map(len, want)) == 6
    assert {tuple(r.path): r.cover for r in M.group_trees(df, ["g"], "items").collect()} == want


def test_vectors_hold_every_item(spark):
    df = spark.range(70).select("id", F.concat(F.array(F.lit("a"), F.lit("a")), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat_ws("_", "id", i))).alias("items"))
    df = df.unionByName(spark.createDataFrame([(70, [])], df.schema))
    x, ids = M.item_features(df, "items")
    assert ids.count() == 70_001 and {v.features.size for v in x.collect()} == {70_001}
    assert sorted(v.features.numNonzeros() for v in x.collect()) == [0] + [1001] * 70
    n = M.count_vectors(M.numbered(df.where("id IN (3, 70)")), "items", ids.where("word IN ('a', '3_7')").withColumn("id", F.when(F.col("word") == "a", 1).otherwise(0))).collect()
    assert {r.id: r.features.toArray().tolist() for r in n} == {3: [1.0, 2.0], 70: [0.0, 0.0]}


def test_category_values_without_limit(spark):
    from parlance.operators.model_table import category_values
    got = category_values(spark.range(70).select(F.format_string("v%02d", "id").alias("c")), ["c"])
    assert got == {"c": [f"v{i:02d}" for i in range(70)]}


def test_association_rules(spark):
    rnd = random.Random(9)
    baskets = [[x for x, p in zip("abcdz", (0.6, 0.5, 0.4, 0.3, 0.5)) if rnd.random() < p] for _ in range(80)]
    baskets = [b for b in baskets if b]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    sup, conf = 0.05, 0.5
    rules = {}
    for n in range(1, 5):
        for a in itertools.combinations("abcd", n):
            k = sum(set(a) | {"z"} <= set(b) for b in baskets)
            base = sum(set(a) <= set(b) for b in baskets)
            if base and k >= math.ceil(sup * len(baskets)) and k / base >= conf:
                rules[a] = k
    want = {a: k for a, k in rules.items() if not any(set(a) < set(b) for b in rules)}
    got = {tuple(r.antecedent): r.n for r in M.association_rules(df, "items", right=["z"], support=sup, confidence=conf).collect()}
    assert got == want


def test_spearman_matches_pandas(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(9), rnd.randrange(5), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "x int, y int, g int")
    for hot in (None, 3):
        got = ME.spearman(df, "x", "y", hot_rows=hot).first().rho
        p = df.toPandas()
        assert got == pytest.approx(p["x"].rank().corr(p["y"].rank()))


def test_masked_tokens(spark):
    df = spark.createDataFrame([(i, ["[CLS]"] + [f"w{j}" for j in range(i)] + ["[SEP]"]) for i in range(1, 60, 6)], "id int, tokens array<string>")
    vocab = spark.createDataFrame([("v0", 0), ("v1", 1)], "word string, id long")
    got = J.masked_tokens(df, "id", "tokens", vocab, most=5).collect()
    for i in range(1, 60, 6):
        mine = [r for r in got if r.id == i]
        assert len(mine) == min(5, max(1, round((i + 2) * 0.15)), i)
        assert len({r.pos for r in mine}) == len(mine) and all(r.label == f"w{r.pos - 1}" for r in mine)
        assert all(r.token in ("[MASK]", r.label, "v0", "v1") for r in mine)


def test_pair_instances(spark):
    rnd = random.Random(6)
    docs = [(i, [[f"d{i}s{s}t{k}" for k in range(rnd.randrange(1, 9))] for s in range(rnd.randrange(1, 15))]) for i in range(30)]
    df = spark.createDataFrame(docs, "id int, sentences array<array<string>>")
    rows = J.pair_instances(df, "id", n_max=24).collect()
    again = J.pair_instances(df, "id", n_max=24).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert {r.id for r in rows} == set(range(30))
    for r in rows:
        assert 1 <= len(r.a) and 1 <= len(r.b) and len(r.a) + len(r.b) <= 21
        assert all(t.startswith(f"d{r.id}s") for t in r.a)
        own = [t.startswith(f"d{r.id}s") for t in r.b]
        assert not any(own) if r.is_random else all(own)
    assert any(r.is_random for r in rows) and not all(r.is_random for r in rows)


def test_encoder_cache(spark):
    texts = spark.createDataFrame([("aa",), ("bb",), ("bb",), ("c",)], "text string")
    cache = spark.createDataFrame([("aa", "tri"), ("bb", "other")], "text string, encoder string")
    got = R.encode_missing(texts, cache, "tri", R.trigram_encoder(8)).collect()
    assert [(r.text, len(r.vector)) for r in got] == [("bb", 8)]


def test_numbered_lines_over_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"part-{n}.txt").write_text("".join(f"{n}:{i}\n" for i in range(50 + n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [r.value for r in files.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
        no = sorted(r.line_no for r in files.numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304")
    assert got == [f"{n}:{i}" for n in range(3) for i in range(50 + n)] and no == list(range(153))


def test_word_vectors_first(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 2\nb 3 4\nc 5 6\nd 7 8\n</s> 0 0\n")
    got = {r.word: r.vector for r in files.read_word_vectors(spark, str(tmp_path), first=1).collect()}
    assert got == {"a": [1.0, 2.0], "b": [3.0, 4.0], "</s>": [0.0, 0.0]}


def test_tighten(spark):
    df = spark.createDataFrame([(1, ["(", "1895", "-", "1943", ")"], 0, 4), (2, ["a", "b"], 0, 1)], "id int, t array<string>, s int, e int")
    got = [(r.s, r.e) for r in J.tighten(df, "t", "s", "e", F.lit("1895")).orderBy("id").collect()]
    assert got == [(1, 1), (0, 1)]


@pytest.mark.parametrize("only_maximal", [True, False])
def test_rules_per_group_equal_brute_force(spark, only_maximal):
    from parlance.operators.rule_mining import grouped_rules
    rnd = random.Random(4)
    rows = [(g, [x for x, p in zip("abcdef", (0.7, 0.6, 0.5, 0.4, 0.3, 0.2)) if rnd.random() < p] + (["a", None] if i % 9 == 0 else []), int(rnd.random() < 0.4))
            for g in ("x", "y", None) for i in range(60)] + [("none", [], 1), ("none", None, None)]
    sup, conf, want = 0.05, 0.4, set()
    for g in {r[0] for r in rows}:
        own = [({x for x in items or [] if x}, hit) for k, items, hit in rows if k == g]
        rules = {}
        for n in range(1, 5):
            for a in itertools.combinations("abcdef", n):
                n_a = [hit for b, hit in own if set(a) <= b]
                if sum(n_a) >= max(1, math.ceil(round(sup * len(own), 9))) and sum(n_a) / len(n_a) >= conf:
                    rules[a] = (len(n_a), sum(n_a))
        want |= {(g, a, *v) for a, v in rules.items() if not only_maximal or not any(set(a) < set(b) for b in rules)}
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, items array<string>, hit int, n int")
    got = grouped_rules(df, ["g"], "items", "hit", sup, conf, longest=5, only_maximal=only_maximal)
    assert {(r.g, tuple(r.antecedent), r.n, r.hits) for r in got.collect()} == want and len(want) > 10
    assert grouped_rules(df.limit(0), ["g"], "items", "hit").count() == 0


def test_maximal_rules_skip_sizes(spark):
    """A rule inside one that is two items longer goes, even if none lies between."""
    from parlance.operators.rule_mining import maximal
    df = spark.createDataFrame([("g", ["a"]), ("g", ["a", "b", "c"]), ("h", ["a"]), ("g", ["b", "d"])], "g string, l array<string>")
    assert {(r.g, *r.l) for r in maximal(df, ["g"], "l").collect()} == {("g", "a", "b", "c"), ("h", "a"), ("g", "b", "d")}


def test_sentence_files(spark, tmp_path):
    from parlance.sources.files import read_sentences
    (tmp_path / "a.txt").write_bytes(b"one\n \ntwo\r\nthree\r\n\r\n\t\r\nfour")
    (tmp_path / "b.txt").write_bytes(b"\n\none\n\none\n")
    (tmp_path / "c.txt").write_bytes(b"")
    rows = read_sentences(spark, str(tmp_path)).collect()
    docs = {}
    for r in sorted(rows, key=lambda r: r.sent_no):
        docs.setdefault(r.doc_key, []).append((r.sent_no, r.text))
    assert sorted(docs.values()) == sorted([[(0, "one")], [(0, "two"), (1, "three")], [(0, "four")], [(0, "one")], [(0, "one")]])


def test_sentences_across_file_blocks(spark, tmp_path):
    """Documents that begin in one block and go on in others, with small blocks."""
    from parlance.sources.files import read_sentences
    rnd = random.Random(8)
    lines = ["" if rnd.random() < 0.1 else f"line {i} " + "x" * rnd.randrange(40) for i in range(2000)] + [f"tail {i}" for i in range(500)]
    (tmp_path / "t.txt").write_text("\n".join(lines))
    want, doc = [], []
    for x in [*lines, ""]:
        if x.strip():
            doc.append(x.strip())
        elif doc:
            want += [(i, s) for i, s in enumerate(doc)]
            doc = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        rows = read_sentences(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.sent_no, r.text) for r in rows) == sorted(want)
    assert len({r.doc_key for r in rows}) == sum(i == 0 for i, _ in want)


def test_new_row_replaces_a_higher_version(spark):
    from parlance.sources.files import upsert
    old = spark.createDataFrame([(1, 9, "old"), (2, 1, "stays")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "new"), (1, 3, "newest"), (3, 1, "added")], "k int, v int, x string")
    assert {(r.k, r.v, r.x) for r in upsert(old, new, ["k"], "v").collect()} == {(1, 3, "newest"), (2, 1, "stays"), (3, 1, "added")}


def test_names_without_vector_keep_the_length(spark):
    m = spark.createDataFrame([(1, [1.0, 2.0], ["a", "zzz"]), (2, [3.0, 4.0], None)], "id int, vector array<double>, f array<string>")
    v = spark.createDataFrame([("a", [5.0, 6.0]), ("*", [0.0, 8.0])], "name string, vector array<double>")
    got = {r.id: r.vector for r in R.message_vectors(m, "id", v, R.VectorSpec(fields=(("f", 2),))).collect()}
    assert got == {1: [1, 2, 5, 6, 0, 8], 2: [3, 4, 0, 8, 0, 8]}
    mean = {r.id: r.vector for r in R.message_vectors(m, "id", v, R.VectorSpec(fields=(("f", 2),), mean=True)).collect()}
    assert mean == {1: [1, 2, 2.5, 7], 2: [3, 4, 0, 8]}


def test_candidates_are_drawn_per_query(spark):
    c = spark.createDataFrame([(i, [float(i % 7), 1.0], f"t{i % 40}") for i in range(200)] + [(500, [1.0, 1.0], None)], "id long, vector array<double>, text string")
    q = c.where("id < 5")
    rows = R.candidate_set(c, q, 8).collect()
    drawn = {k: sorted(r.text for r in rows if r.q_id == k and r.is_random) for k in range(5)}
    assert all(len(v) == 8 for v in drawn.values()) and len({tuple(v) for v in drawn.values()}) == 5
    for k in range(5):
        top = [r.text for r in rows if r.q_id == k and not r.is_random]
        assert len(top) == len(set(top)) == 8 and f"t{k}" not in top


def test_token_ids(spark):
    vocab = ["[UNK]", "[CLS]", "[SEP]", "want", "##want", "##ed", "wa", "un", "runn", "##ing", ","]
    v = spark.createDataFrame([(w, i) for i, w in enumerate(vocab)], "word string, id long")
    df = spark.createDataFrame([(1, ["un", "##want", "##ed", ",", "runn", "##ing"]), (2, ["zzz", None, "un"])], "k int, t array<string>")
    assert {r.k: r.ids for r in J.token_ids(df, ["k"], "t", v).collect()} == {1: [7, 4, 5, 10, 8, 9], 2: [0, 0, 7]}
    assert {r.k: r.ids for r in J.token_ids(df, ["k"], "t", v, 4).collect()} == {1: [7, 4, 5, 10], 2: [0, 0, 7, 0]}


def test_token_windows_keep_every_word(spark):
    df = spark.createDataFrame([(n, [f"w{i}" for i in range(n)]) for n in range(12)], "k int, t array<string>")
    got = {}
    for r in J.token_windows(df, "k", "t", 5).orderBy("k", "window").collect():
        assert r.tokens[0] == "[CLS]" and r.tokens[-1] == "[SEP]" and len(r.tokens) <= 7
        got[r.k] = got.get(r.k, []) + r.tokens[1:-1]
    assert got == {n: [f"w{i}" for i in range(n)] for n in range(1, 12)}


def test_pairs_of_one_document_and_of_copies(spark):
    one = spark.createDataFrame([("only", [["a", "b"], ["c"]] * 4)], "id string, sentences array<array<string>>")
    rows = J.pair_instances(one, "id", n_max=8, copies=5).collect()
    assert {r.copy for r in rows} == set(range(5)) and any(r.is_random for r in rows)
    assert all(r.a and r.b for r in rows if r.is_random)
    docs = spark.createDataFrame([(i, [[f"{i}:{j}"] * 3 for j in range(20)]) for i in range(10)], "id int, sentences array<array<string>>")
    made = {}
    for r in J.pair_instances(docs, "id", n_max=20, copies=3).collect():
        made.setdefault(r.copy, []).append((r.id, r.instance, r.is_random, tuple(r.a), tuple(r.b)))
    assert len({tuple(sorted(v)) for v in made.values()}) == 3  # every copy draws for itself


@pytest.mark.parametrize("seed", range(3))
def test_best_spans_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = {k: [rnd.choice("abcdé") for _ in range(rnd.randrange(1, 40))] for k in range(12)}
    nulls = {k: rnd.choice([-9.0, 1.0, 3.0]) for k in words}
    scores = []
    for k, ws in words.items():
        for start in range(0, len(ws), 7):
            n = min(10, len(ws) - start)
            scores.append((k, start, [rnd.randrange(9) / 4 for _ in range(n)], [rnd.randrange(9) / 4 for _ in range(n)], [rnd.random() < 0.7 for _ in range(n)]))
    want = set()
    for k, ws in words.items():
        best = {"": nulls[k]}
        for key, start, s, e, fit in scores:
            if key != k:
                continue
            top = lambda v: sorted(range(len(v)), key=lambda i: (-v[i], i))[:3]
            for i in top(s):
                for j in top(e):
                    if fit[i] and i <= j < i + 4:
                        t = " ".join(ws[start + i: start + j + 1])
                        best[t] = max(best.get(t, -99), s[i] + e[j])
        order = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        want |= {(k, i + 1, t, v) for i, (t, v) in enumerate(order[:3])}
        if "" not in [t for t, _ in order[:3]]:
            want.add((k, 4, "", nulls[k]))
    df = spark.createDataFrame(scores, "k int, start int, start_logits array<double>, end_logits array<double>, is_max array<boolean>")
    got = J.best_spans(df, spark.createDataFrame(list(words.items()), "k int, words array<string>"), spark.createDataFrame(list(nulls.items()), "k int, null_score double"), "k", 3, 4)
    assert {(r.k, r["rank"], r.text, r.score) for r in got.collect()} == want


def test_silent_senders(spark):
    turns = spark.createDataFrame([(k,) for k, n in (("a", 40), ("b", 40), ("c", 29), ("d", 30), ("e", 50)) for _ in range(n)], "s string")
    profile = spark.createDataFrame([("a", 0), ("b", 3), ("d", None)], "s string, clicks int")
    assert {tuple(r) for r in Q.silent_senders(turns, "s", profile).collect()} == {("a", 40), ("d", 30), ("e", 50)}


def test_rules_keep_equal_baskets_once(spark):
    """Counted baskets give the rules of the written-out ones, and equal ones are one row."""
    from parlance.operators.rule_mining import grouped_rules
    rows = [("x", ["a", "b"], 1, 40), ("x", ["b", "a", "a"], 0, 5), ("x", ["c"], 0, 20), ("y", ["a"], 1, 3)]
    counted = spark.createDataFrame(rows, "g string, items array<string>, hit int, n int")
    single = counted.select("g", "items", "hit", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("one"))
    got = [sorted((r.g, tuple(r.antecedent), r.n, r.hits, r.lift) for r in grouped_rules(d, ["g"], "items", "hit", count=c).collect()) for d, c in ((counted, "n"), (single, None))]
    assert got[0] == got[1] and [g[:4] for g in got[0]] == [("x", ("a", "b"), 45, 40), ("y", ("a",), 3, 3)]


def test_small_files_of_large_tables_are_not_broadcast(spark, tmp_path):
    """A million equal rows take few bytes in a file; the planner counts them as they are in a task."""
    from parlance.sources.tables import Tables
    path = str(tmp_path)
    spark.range(1_000_000, numPartitions=1).selectExpr("id AS p_partkey", "repeat('x', 50) AS p_name").write.parquet(f"{path}/part.parquet")
    part = Tables(spark, path).part
    assert "BroadcastHashJoin" not in spark.range(10**7).join(part, F.col("id") == F.col("p_partkey"))._jdf.queryExecution().executedPlan().toString()


def test_silent_senders_answer_no_question(spark):
    turns = spark.createDataFrame([(k, int(a and i == 0)) for k, n, a in (("a", 6, 0), ("b", 6, 1), ("c", 6, 0), ("d", 4, 0), ("e", 5, 0)) for i in range(n)], "s string, hit int")
    profile = spark.createDataFrame([("a", 7), ("c", 8)], "s string, clicks int")
    assert {tuple(r) for r in Q.silent_senders(turns, "s", profile, 5, fewer_than=8, answered="hit").collect()} == {("a", 6), ("e", 5)}


def test_silent_senders_of_conversations_and_of_events(spark):
    from parlance.plans import load
    got = {r.sender_id for r in load().QUERIES["a51_silent_senders"](spark, "/root/testdata/sf0.01").collect()}
    assert {":" in s for s in got} == {True, False}


def test_split_orders_keys_only(spark):
    """Wide columns do not meet in the one task of their label."""
    df = spark.range(200).select("id", F.lit("a").alias("label"), F.repeat(F.lit("x"), F.lit(1000)).alias("wide"))
    s = S.stratified_split(df, "id", "label")
    assert s.columns[:3] == df.columns and s.select("id", "wide").exceptAll(df.select("id", "wide")).count() == 0 and s.count() == 200
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):].split("\n")[0]
    assert "wide" not in window and all("wide" not in line for line in plan[plan.index("Window"):].split("\n") if "Project" in line)


def test_augment_rare_cleans_each_text_once(spark):
    """All texts are cleaned in one branch; the rare ones are written before the others read them."""
    rows = [(i, "often" if i else "rare", "It's a Big, house!") for i in range(101)]
    syn = spark.createDataFrame([("big", "large")], "word string, synonym string")
    out = J.augment_rare(spark.createDataFrame(rows, "id int, label string, text string"), "id", "label", "text", syn)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # the texts and the synonyms
    got = sorted((r.id, r.label, r.variant, r.text) for r in out.collect())
    assert got[:2] == [(0, "rare", 0, "it a big house"), (0, "rare", 1, "it a large house")] and len(got) == 102


def test_masked_tokens_are_chosen_once(spark):
    df = spark.createDataFrame([(i, ["[CLS]", *"abcdefgh", "[SEP]"]) for i in range(60)], "id int, tokens array<string>")
    out = J.masked_tokens(df, "id", "tokens", spark.createDataFrame([("x", 0), ("y", 1)], "word string, id long"), 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "lambda" not in plan
    unit = lambda *p: int(__import__("hashlib").md5(":".join(map(str, p)).encode()).hexdigest()[:13], 16) / 16**13
    want = {(i, p) for i in range(60) for p in sorted(range(1, 9), key=lambda p: (unit(1, i, p), p))[:2]}
    assert {(r.id, r.pos) for r in out.collect()} == want


def test_python_batches_are_bounded_in_bytes(spark):
    from parlance.sources.tables import Tables
    Tables(spark, "")
    wide = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(20_000)).alias("t"))
    sizes = wide.mapInPandas(lambda batches: (b.iloc[:1].assign(n=len(b))[["n"]] for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) * 20_000 < 2 * (8 << 20)


def test_trigram_encoder_equals_one_by_one():
    import zlib
    texts = ["", "a", "a house", "h\u00e4user \U0001f600!", "a house", "zz" * 40, ""]
    want = np.zeros((len(texts), 16))
    for i, t in enumerate(texts):
        p = f"#{t}#"
        for j in range(len(p) - 2):
            h = zlib.crc32(p[j:j + 3].encode())
            want[i, h % 16] += 1.0 if h & 0x80000000 else -1.0
    assert all((R.trigram_encoder(16, c)(texts) == want).all() for c in (1, 9, 1000)) and R.trigram_encoder(16)([]).shape == (0, 16)


def test_trigram_encoder_hashes_each_trigram_once(monkeypatch):
    import zlib
    calls, real = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda b: calls.append(b) or real(b))
    R.trigram_encoder(16)(["a house", "a house", "zz" * 40])
    assert len(calls) == len(set(calls)) == 10
