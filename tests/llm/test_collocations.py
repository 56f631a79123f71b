import random
import re
from collections import Counter

import pytest

from parlance.llm import collocations as co
from tests.llm.cases import LOWER, frame, texts

PIECE, WORD = re.compile(r"[.,;:!?\x0a-\x0d]"), re.compile(r"[^\x20\x09]+")


def expected(rows, least, longest, top):
    f, n = {}, Counter()
    for lang, text in rows:
        c = f.setdefault(lang or "und", Counter())
        for p in PIECE.split((text or "").translate(LOWER)):
            ws = WORD.findall(p)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                c.update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= c[p[i:j]]}
        rows = []
        for p, a in cand.items():
            if p in inside:
                continue
            s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((s, a, " ".join(p), c[p[:k]], c[p[k:]]))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(rows[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    passage = " ".join(f"P{i}" for i in range(40))
    rows = [("en", " ".join(rng.choice(["a", "b", "c", "D", "é", "und"]) + rng.choice(["", "", "", ".", ",", "\t", "\n", "\r\n", "  "]) for _ in range(rng.randrange(0, 60)))) for _ in range(150)]
    rows += [("de", f"x {passage}. y"), ("de", passage), ("de", f"{passage} {passage}")] * 3 + [(None, "one two three"), ("und", "One two. three")] * 6
    return rows + [("fr", "z " * 30), ("fr", None), ("fr", ""), (None, None), ("empty", " .,\t")] + [("en", t) for _, t in texts()]


@pytest.mark.parametrize("buckets,chunk,longest,least", [(1 << 24, 8 << 20, 5, 5), (1 << 16, 2000, 5, 9), (1 << 16, 50, 3, 2)])
def test_equals_brute_force(spark, buckets, chunk, longest, least):
    docs = spark.createDataFrame([(x, t, 1, "k") for x, t in corpus()], "lang string, text string, n long, phrase string")
    got = [tuple(r) for r in co.collocations(docs, least, longest, top=60, buckets=buckets, chunk=chunk).collect()]
    assert sorted(got) == expected(corpus(), least, longest, 60)


def test_full_buckets_cut_nothing(spark):
    want = expected(corpus(), 5, 4, 2000)
    docs = spark.createDataFrame([(x, t) for x, t in corpus()], "lang string, text string")
    assert sorted(tuple(r) for r in co.collocations(docs, 5, 4, buckets=8).collect()) == want


def test_exact_arithmetic_and_empty(spark):
    assert co.collocations(frame(spark).limit(0)).count() == 0
    big = spark.createDataFrame([(9 * 10**15, 9 * 10**17, 3 * 10**16, 10**16)], "a long, n long, l long, r long")
    e = big.selectExpr("(CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) * 1000BD) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) s")
    assert e.head().s == 1000 * 9 * 10**15 * 9 * 10**17 // (3 * 10**16 * 10**16)


def test_paths_are_compacted(spark):
    docs = spark.createDataFrame([(x, t) for x, t in corpus()], "lang string, text string")
    got = co.phrase_paths(docs, 9, 5).where("lang = 'de'").collect()
    path = {r.path for r in got}
    assert len(got) == 36 and len(path) == 1 and sorted(r.at for r in got) == list(range(36))
