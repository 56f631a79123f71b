"""The skew-safe ordered features give the same rows as plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import scan as S
from parlance.operators import sequence as Q


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(900):
        # one key holds a third of all rows, one key is null
        k = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", "d", None])
        data.append((k, rnd.randrange(300), i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "x", "y"])))
    return spark.createDataFrame(data, "k string, t int, id int, v int, s string").repartition(5, "id")


def features():
    return {
        "l1": S.lag("v"), "l2": S.lag("s", 2), "n1": S.lead("s"), "n3": S.lead("v", 3),
        "sum": S.running("v"), "cnt": S.running("v", "count"), "lo": S.running("v", "min"), "hi": S.running("t", "max"),
        "bsum": S.before("v"), "bcnt": S.before("s", "count"), "known": S.last_known("s"), "bknown": S.last_known_before("s"), "pos": S.position(),
        "all": S.total("v"), "alln": S.total("s", "count"), "mean": S.total("v", "avg"), "top": S.total("v", "max"),
    }


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[2])


@pytest.mark.parametrize("limit", [7, 60, 250])
def test_blocked_equals_plain(rows, limit):
    plain = S.ordered(rows, ["k"], ["t", "id"], features(), hot_rows=10**9)
    blocked = S.ordered(rows, ["k"], ["t", "id"], features(), hot_rows=limit)
    assert collected(plain) == collected(blocked)


def test_no_key_and_descending(rows):
    f = {"pos": S.position(), "sum": S.running("v")}
    a = S.ordered(rows, [], [F.desc("t"), "id"], f, hot_rows=10**9)
    b = S.ordered(rows, [], [F.desc("t"), "id"], f, hot_rows=50)
    assert collected(a) == collected(b)
    assert a.columns == b.columns == rows.columns + ["pos", "sum"]


def test_hot_keys(rows):
    assert [r.k for r in S.hot_keys(rows, ["k"], 290).collect()] == ["hot"]


def test_sessions_hot(spark):
    data = [(1, i * 7000 + (30000 if i % 11 == 0 else 0), i) for i in range(200)] + [(2, i * 90000, 1000 + i) for i in range(5)]
    df = spark.createDataFrame(data, "u int, ts int, id int")
    f = lambda n: sorted(tuple(r) for r in Q.sessionise(df, "u", "ts", ["id"], hot_rows=n).collect())
    assert f(10**9) == f(20)


def test_session_gap_edge(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 21600, 2), (1, 43201, 3)], "u int, ts int, id int")
    got = [r.session for r in Q.sessionise(df, "u", "ts", ["id"]).orderBy("id").collect()]
    assert got == [1, 1, 2]


def test_conversation_hot(spark):
    rnd = random.Random(2)
    user, bot = [], []
    for i in range(160):
        s = 1 if i % 2 else rnd.randrange(2, 6)
        user.append((s, 0, i * 10, rnd.choice("ab") + str(rnd.randrange(3)), rnd.choice([None, "color", "fit,color"]), rnd.choice([None, "x"]), rnd.choice([None, "shirt"])))
        bot.append((s, 0, i * 10 + 3, 1, rnd.choice([None, "color_question", "subvertical_selection", "product_type_selection"]), rnd.choice([None, "a0,b1", "q"])))
    u = spark.createDataFrame(user, "sender_id int, retailer_id int, ts long, text string, positive_aspects string, subvertical string, product_type string")
    b = spark.createDataFrame(bot, "sender_id int, retailer_id int, ts long, next_response_time long, response_code string, replies string")
    j = Q.interleave(u, b)
    f = lambda n: sorted((str(tuple(r)) for r in Q.conversation_features(j, hot_rows=n).collect()))
    assert f(10**9) == f(15)
    g = lambda n: sorted(str(tuple(r)) for r in Q.last_n_features(j.select("sender_id", "ts", "src", "response_code"), "sender_id", Q.ORDER, ["response_code"], hot_rows=n).collect())
    assert g(10**9) == g(15)


def test_last_n_features(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, "c"), (1, 5, "d"), (1, 6, None)], "k int, t int, v string")
    got = [(r.v_0, r.v_1, r.v_2) for r in Q.last_n_features(df, "k", ["t"], ["v"]).orderBy("t").collect()]
    n = "None"
    assert got == [(n, n, n), (n, n, "a"), (n, n, "a"), (n, "a", "b"), ("a", "b", "c"), ("b", "c", "d")]


def test_collected_chunks(spark):
    df = spark.createDataFrame([(1, i) for i in range(25)], "k int, t int")
    got = sorted((r.chunk, r.l) for r in Q.collected(df, ["k"], ["t"], "t", "l", chunk=10).collect())
    assert [x for _, l in got for x in l] == list(range(25)) and [len(l) for _, l in got] == [10, 10, 5]


def test_large_keys_give_one_row(spark, monkeypatch):
    from types import SimpleNamespace
    from parlance.plans import load
    user = spark.range(10_500).select(F.lit("s").alias("sender_id"), F.col("id").alias("ts"), F.col("id").cast("string").alias("message"))
    clicks = spark.range(2500).select(F.lit("u").alias("user_id"), F.col("id").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, "add to cart").otherwise("click").alias("action"))
    registry = load()
    monkeypatch.setattr(registry, "Tables", lambda spark, path: SimpleNamespace(fx_user=user, fx_clicks=clicks))
    texts = registry.QUERIES["a45_collect_texts"](spark, "").collect()
    assert sorted((r.pos, r.text) for r in texts) == [(i + 1, str(i)) for i in range(10_500)]
    assert sorted(tuple(r) for r in Q.ordered_texts(user, "sender_id", ["ts"], "message", hot_rows=1000).collect()) == sorted(("s", r.pos, r.text) for r in texts)
    assert [tuple(r) for r in registry.QUERIES["p35_count_actions"](spark, "").collect()] == [("u", 2000, 500)]


def test_actions_are_counted_in_ordered_lists(spark, monkeypatch):
    import random
    from types import SimpleNamespace
    from parlance.functions import expr as X
    from parlance.plans import load
    rnd = random.Random(3)
    rows = [(k, i // 2, i, rnd.choice(["click", "click", "add to cart", None])) for k, n in (("u", 2500), ("v", 3), (None, 1001)) for i in range(n)]
    clicks = spark.createDataFrame(rnd.sample(rows, len(rows)), "user_id string, ts int, event_id int, action string")
    collected, made = Q.collected, []

    def lists(*args, **kw):
        made.append(collected(*args, **kw))
        return made[-1]

    monkeypatch.setattr(Q, "collected", lists)
    registry = load()
    monkeypatch.setattr(registry, "Tables", lambda spark, path: SimpleNamespace(fx_clicks=clicks))
    want = {(k, *[sum(r[0] == k and r[3] == a for r in rows) for a in ("click", "add to cart")]) for k in ("u", "v", None)}
    assert {tuple(r) for r in registry.QUERIES["p35_count_actions"](spark, "").collect()} == want
    parts = sorted(made[0].collect(), key=lambda r: r["chunk"])
    assert sorted(len(r["_actions"]) for r in parts) == [1, 3, 500, 1000, 1000, 1000]
    for k in ("u", "v", None):
        assert [a for r in parts if r["user_id"] == k for a in r["_actions"]] == [r[3] for r in rows if r[0] == k]
    hot = Q.action_counts(clicks, "user_id", ["ts", "event_id"], "action", {"clicks": "click", "adds": "add to cart"}, chunk=7, hot_rows=100)
    assert {tuple(r) for r in hot.collect()} == want
    assert spark.sql("SELECT CAST(NULL AS array<string>) AS a").select(X.count_actions("a", "click")).first()[0] is None


@pytest.mark.parametrize("hot", [10**9, 20])
def test_last_n_of_three_columns_in_one_scan(spark, hot):
    import random
    rnd = random.Random(2)
    rows = [(i % 3, i, *[rnd.choice(["a", "b", "c", None, None]) for _ in range(3)]) for i in range(150)] + [(None, i, None, "x", None) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, t int, u string, v string, w string")
    out = Q.last_n_features(df, "k", ["t"], ["u", "v", "w"], hot_rows=hot)
    got = {(r.k, r.t): [r[f"{c}_{j}"] for c in "uvw" for j in range(3)] for r in out.collect()}
    for k, t, *_ in rows:
        before = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == k and r[1] < t]
        want = []
        for c in range(2, 5):
            known = [r[c] for r in before if r[c] is not None][-3:]
            want += ["None"] * (3 - len(known)) + known
        assert got[k, t] == want
    assert len(got) == len(rows)
    if hot == 10**9:
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
