"""Topics against a plain loop over documents, and what of a model reaches the driver."""

import os
import random
import subprocess
import sys
import textwrap
from collections import Counter

import numpy as np
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from parlance.operators import topic_model as TM


def plain_topics(spark, docs, k, passes, seed, share, offset=1024, decay=0.51):
    """{key: (topic, weight)} by dictionaries, one document after the other."""
    psi = TM.digamma
    words = sorted({w for ws in docs.values() for w in ws if w is not None})
    table = spark.createDataFrame([(w,) for w in words], "word string").select("word", *TM.first_weights(k, seed)).collect()
    lam = {r[0]: np.array(r[1:]) for r in table}
    drawn = {(r[0], i) for i in range(passes) for r in spark.createDataFrame([(d,) for d in docs], "id long").where(TM.unit(seed, F.lit("draw"), F.lit(i), F.col("id")) < share).collect()}
    alpha, steps = np.full(k, 1 / k), 0

    def one(ws, total):
        n = Counter(w for w in ws if w is not None)
        beta = {w: np.exp(psi(lam[w]) - psi(total)) for w in n}
        gamma, moved = np.ones(k), 1.0
        while n and moved > TM.CHANGE:
            theta = np.exp(psi(gamma) - psi(gamma.sum()))
            new = alpha + sum(c * theta * beta[w] / (theta * beta[w]).sum() for w, c in n.items())
            gamma, moved = new, np.abs(new - gamma).mean()
        theta = np.exp(psi(gamma) - psi(gamma.sum()))
        return gamma, np.log(theta), {w: c * theta * beta[w] / (theta * beta[w]).sum() for w, c in n.items()}

    for i in range(passes):
        total = sum(lam.values())
        got = [one(ws, total) for d, ws in docs.items() if (d, i) in drawn and any(w is not None for w in ws)]
        if got:
            steps += 1
            rate = (offset + steps) ** -decay
            for w in lam:
                lam[w] = (1 - rate) * lam[w] + rate * (1 / k + len(docs) / np.ceil(share * len(docs)) * sum(g[2].get(w, 0) for g in got))
            alpha = TM._prior_step(alpha, sum(g[1] for g in got), len(got), rate)
    total = sum(lam.values())
    shares = {d: (g := one(ws, total)[0]) / g.sum() for d, ws in docs.items() if any(w is not None for w in ws)}
    return {d: (int(s.argmax()), float(s.max())) for d, s in shares.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_topics_equal_plain_loops(spark, parts):
    rng = random.Random(3)
    docs = {i: [rng.choice("abcdefgh" if i % 2 else "efghijklmn") for _ in range(rng.randint(1, 40))] for i in range(40)}
    docs |= {40: [], 41: [None], 42: ["a", None, "z"]}
    df = spark.createDataFrame(list(docs.items()), "id long, w array<string>").repartition(parts)
    got = {r["id"]: (r["topic"], r["weight"]) for r in TM.topics(df, "id", "w", k=3, passes=4, least=0.0, share=0.4).collect()}
    want = plain_topics(spark, docs, 3, 4, 100, 0.4)
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and got[d][1] == pytest.approx(want[d][1], abs=1e-4) for d in want)


def test_no_documents_have_no_topics(spark):
    assert TM.topics(spark.createDataFrame([], "id long, w array<string>"), "id", "w").collect() == []


def test_word_weights_do_not_reach_the_driver(tmp_path):
    """80,000 words of 4 topics are 2.6 MB of weights in each step; the driver takes 1 MB a job."""
    code = f"""
        from parlance.session import get_session
        from parlance.plans import load
        s = get_session("local[4]", spark__driver__maxResultSize="1m", spark__sql__shuffle__partitions="4", spark__checkpoint__dir={str(tmp_path / 'shared')!r})
        words = "concat(translate(cast(id as string), '0123456789', 'qwrtzuplkj'), ' b')"
        s.range(80000).selectExpr("id as doc_id", "'x' as lang", "'y' as source", "array_join(transform(sequence(1, 3), i -> " + words + "), ' ') as text", "9 as n_chars").coalesce(2).write.parquet({str(tmp_path / 'documents.parquet')!r})
        print("rows", load().QUERIES["m12_topics"](s, {str(tmp_path)!r}).count())"""
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=400, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert "rows 80000" in run.stdout, run.stderr[-2000:]
