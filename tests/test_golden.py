"""Golden cases of the survey."""

import math

import pytest
from pyspark.sql import functions as F

from parlance.functions import expr as X
from parlance.functions import metrics as M
from parlance.functions import text as T
from parlance.operators import catalogue as C
from parlance.operators import rates as R
from parlance.operators import sequence as S
from parlance.operators import textjobs as J

VOCAB = ["[UNK]", "[CLS]", "[SEP]", "want", "##want", "##ed", "wa", "un", "runn", "##ing", ","]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_tokenise(spark):
    v = spark.createDataFrame([(p,) for p in VOCAB], "piece string")
    df = spark.createDataFrame([(1, "UNwantéd,running")], "id int, text string").select("id", T.basic_tokens("text").alias("w"))
    assert J.tokenise(df, "id", "w", v).first().pieces == ["un", "##want", "##ed", ",", "runn", "##ing"]


@pytest.mark.parametrize("shared", [0, 1000])
def test_word_pieces(spark, shared):
    v = spark.createDataFrame([(p,) for p in VOCAB], "piece string")
    words = spark.createDataFrame([(w,) for w in ["unwanted", "running", "unwantedX", "x" * 201, "un", "wa"]], "word string")
    got = {r.word: r.pieces for r in J.wordpieces(words, v, most_shared=shared).collect()}
    assert got == {"unwanted": ["un", "##want", "##ed"], "running": ["runn", "##ing"], "unwantedX": ["[UNK]"], "x" * 201: ["[UNK]"], "un": ["un"], "wa": ["wa"]}


def test_basic_tokens(spark):
    r = one(spark, a=T.basic_tokens(F.lit(" \tHeLLo!how  \n Are yoU?  ")), b=T.basic_tokens(F.lit("Héllo")), c=T.basic_tokens(F.lit("ah博推zz")))
    assert r.a == ["hello", "!", "how", "are", "you", "?"] and r.b == ["hello"] and r.c == ["ah", "博", "推", "zz"]


def test_trigrams(spark):
    r = one(spark, a=T.trigrams(F.array(F.lit("pie"))), b=T.trigrams(F.array(F.lit("no"))), c=T.trigrams(F.array(F.lit("i"))))
    assert (r.a, r.b, r.c) == (["#pi", "pie", "ie#"], ["#no", "no#"], ["#i#"])


def test_clean_text(spark):
    assert one(spark, a=T.clean_text(F.lit("What's up? I can't go"))).a == "what is up i can not go"


SCENARIOS = [
    ([(1, .8)] + [(1, .7)] * 2 + [(0, .6)] * 6, 1.0, 1.0),
    ([(1, .5)] * 3 + [(1, .6)] * 3 + [(0, .7)] * 4, 0.5142857, 0.0),
    ([(1, .8)] * 5 + [(1, .6)] + [(0, .7)] * 4, 0.9333333, 0.8333333),
]


@pytest.mark.parametrize("rows,ap,auc", SCENARIOS)
def test_ap_auc(spark, rows, ap, auc):
    df = spark.createDataFrame(rows, "label int, score double")
    for hot in (None, 1):
        r = M.ap_auc(df, "score", "label", hot_rows=hot).first()
        assert r.ap == pytest.approx(ap, abs=1e-6) and r.auc == pytest.approx(auc, abs=1e-6)
    # metrics do not change under a monotone map of the scores
    r = M.ap_auc(df.withColumn("score", F.exp("score") * 3), "score", "label").first()
    assert r.ap == pytest.approx(ap, abs=1e-6) and r.auc == pytest.approx(auc, abs=1e-6)


def test_pr_points(spark):
    df = spark.createDataFrame(SCENARIOS[2][0], "label int, score double")
    pts = {(round(r.recall, 6), round(r.precision, 6)) for r in M.curve(df, "score", "label").collect()}
    assert (round(5 / 6, 6), 1.0) in pts and (1.0, 0.6) in pts


def test_transition_weight(spark):
    rows = [(i, t, "q", 1 if i < 451 else 0) for i in range(4102) for t in range(2)]
    e = R.transitions(spark.createDataFrame(rows, "s int, t int, code string, won int"), "s", ["t"], "code", "won", min_turns=2).first()
    assert (e.n, e.conversions) == (4102, 451) and e.weight == 0.10994636762554852


def test_before_after(spark):
    b = spark.createDataFrame([("x", 350)], "k string, n long")
    a = spark.createDataFrame([("x", 125), ("y", 3)], "k string, n long")
    got = {r.k: (r.before, r.added, r.after) for r in C.before_after(b, a, ["k"]).collect()}
    assert got == {"x": (350, 125, 475), "y": (0, 3, 3)}


def test_ci(spark):
    df = spark.createDataFrame([(i % 2, None) for i in range(100)], "x int, y int")
    r = R.rates(df, [], ["x", "y"]).first()
    assert r.x_mean == 0.5 and r.x_ci == pytest.approx(0.098) and r.y_n == 0 and r.y_ci is None


def test_identity_bins_pad(spark):
    df = spark.createDataFrame([("NULL", 9, 0, ["a"]), ("123456", 9, 7, ["a", "b", "c"])], "ga string, s int, n int, a array<string>")
    rows = df.select(X.resolve_identity("ga", "s").alias("i"), X.cut("n", [0, 1, 2]).alias("b"), X.pad_array("a", 2).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("9", "[0,1)", ["a", "*"]), ("123456", "[2,inf)", ["a", "b"])]


def answered(spark, bot, before, after, later=None):
    cols = "sender_id int, retailer_id int, ts long, src int, text string, positive_aspects array<string>, subvertical string, product_type string, response_code string, replies array<string>"
    rows = []
    for i, u in enumerate([before, None, after, later]):
        if i == 1:
            rows.append((1, 0, 1, 1, None, None, None, None, bot[0], bot[1]))
        elif u is not None:
            rows.append((1, 0, i, 0, u.get("text"), u.get("asp"), u.get("sub"), u.get("pt"), None, None))
    d = S.conversation_features(spark.createDataFrame(rows, cols))
    return d.where("src = 1").first().is_answered


@pytest.mark.parametrize("bot,before,after,later,want", [
    (("x", ["no", "yes"]), {}, {"text": "yes"}, None, 1),
    (("x", ["no", "yes"]), {}, {"text": "what"}, {"text": "no"}, 1),
    (("x", ["no", "yes"]), {}, {"text": "what"}, {"text": "hm"}, 0),
    (("x", None), {}, {"text": "yes"}, None, 0),
    (("color_question", ["r"]), {"asp": ["fit"]}, {"asp": ["color"]}, None, 1),
    (("color_question", ["r"]), {"asp": ["color"]}, {"asp": ["color"]}, None, 0),
    (("color_question", ["r"]), {}, {"asp": ["color"]}, None, 0),
    (("color_question", None), {"asp": ["fit"]}, {"asp": ["color"]}, None, 0),
    (("subvertical_selection", ["r"]), {}, {"sub": "shoes"}, None, 1),
    (("subvertical_selection_second", ["r"]), {"sub": "a"}, {"sub": "shoes"}, None, 0),
    (("product_type_selection", ["r"]), {}, {}, {"pt": "shirt"}, 1),
    (("product_type_selection", ["r"]), {"pt": "x"}, {}, {"pt": "shirt"}, 0),
])
def test_is_answered(spark, bot, before, after, later, want):
    assert answered(spark, bot, before, after, later) == want


def test_chi_square(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 5
    df = spark.createDataFrame(rows, "c string, t int")
    plain = M.chi_square(df, ["c"], "t", yates=False).first().chi2
    fixed = M.chi_square(df, ["c"], "t").first().chi2
    n, cells = 65, {("a", 1): 10, ("a", 0): 20, ("b", 1): 30, ("b", 0): 5}
    e = lambda r, c: sum(v for k, v in cells.items() if k[0] == r) * sum(v for k, v in cells.items() if k[1] == c) / n
    assert plain == pytest.approx(sum((o - e(*k)) ** 2 / e(*k) for k, o in cells.items()))
    assert fixed == pytest.approx(sum((abs(o - e(*k)) - 0.5) ** 2 / e(*k) for k, o in cells.items()))


def test_quantile(spark):
    for data in ([3.0, 1.0, 2.0], [4.0, 1.0, 1.0, 2.0], [5.0]):
        df = spark.createDataFrame([(x,) for x in data], "x double")
        s = sorted(data)
        for q in (0.0, 0.25, 0.5, 0.9):
            at = (len(s) - 1) * q
            want = s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))
            assert M.exact_quantile(df, "x", q).first().value == pytest.approx(want)


def test_pair_limits(spark):
    rows = [(a, b, n) for a in range(0, 25, 3) for b in range(0, 25, 4) for n in range(1, 40, 5)]
    df = spark.createDataFrame(rows, "a int, b int, n int")
    na, nb = T.pair_limits(F.col("a"), F.col("b"), F.col("n"))
    for r in df.select("a", "b", "n", na.alias("na"), nb.alias("nb")).collect():
        a, b = r.a, r.b
        while a + b > r.n:
            a, b = (a - 1, b) if a > b else (a, b - 1)
        assert (r.na, r.nb) == (a, b)


def test_doc_spans(spark):
    rows = [(i, n) for i, n in enumerate(range(1, 60, 7))]
    df = spark.createDataFrame(rows, "id int, n int")
    got = {}
    for r in J.doc_spans(df, "id", F.col("n"), F.lit(2), 15, 6).collect():
        got.setdefault(r.id, []).append((r.start, r.length))
    for i, n in rows:
        want, start = [], 0
        while start < n:
            size = min(n - start, 10)
            want.append((start, size))
            if start + size == n:
                break
            start += min(size, 6)
        assert sorted(got[i]) == want


def test_readable_rules(spark):
    df = spark.createDataFrame([(1, ["neck-crew_neck< 0.5", "product_type-shirt>=0.5", "color-red>=0.5"]), (2, ["color-red< 0.5"])], "id int, c array<string>")
    got = [(r.id, r.rule) for r in C.readable_rules(df, "c").collect()]
    assert got == [(1, "shirt,color red,neck not crew neck")]


def test_rule_lines(spark):
    lines = ["noise", " Rule number: 3 [class=1 cover=20 (10%) prob=0.96]", "   product_type-shirt>=0.5", "   color-red< 0.5", "", "Rule number: 2 [class=0 cover=7 (2%) prob=0.1]", "  a-b>=0.5", "Rule number: 9 [class=1 cover=4 (1%) prob=0.80]"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", 0, None), ("g", 1, "Rule number: 1 [class=1 cover=1 (1%) prob=0.5]"), ("g", 2, "x-y>=0.5")], "file string, no int, line string")
    got = {(r.file, r.rule_no): (r.label, r.cover, r.prob, r.conditions) for r in C.parse_rule_lines(df, ["file"], "no", "line").collect()}
    assert got == {("f", 1): (1, 20, "0.96", ["product_type-shirt>=0.5", "color-red< 0.5"]), ("f", 2): (0, 7, "0.1", ["a-b>=0.5"]), ("f", 3): (1, 4, "0.80", []), ("g", 1): (1, 1, "0.5", ["x-y>=0.5"])}
