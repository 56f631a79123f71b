import hashlib
import re
from collections import defaultdict

import pytest

from parlance.llm import exact_dup, near_dup
from parlance.llm.graph import components
from tests.llm.cases import frame, shingles, texts


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("bits", [64, 3])  # few bits: chunk hashes collide
def test_exact_groups(spark, bits):
    long = [(100 + i, ("chunk %d " % (i % 2)) * 2000 + "x" * (i // 2)) for i in range(6)]
    rows = texts() + long
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeezed(t)].append((-len(t or ""), i is None, i or 0, i))
    got = exact_dup.exact_duplicates(frame(spark, rows), bits=bits).collect()
    want = []
    for i, t in rows:
        g = groups[squeezed(t)]
        best = min(g)
        want.append((i, best[3], len(g), i == best[3] and -len(t or "") == best[0], hashlib.sha256(squeezed(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_drop_exact_keeps_one_row_and_all_columns(spark):
    rows = frame(spark)
    kept = exact_dup.drop_exact_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted(squeezed(r.text) for r in kept.collect()) == sorted({squeezed(t) for _, t in texts()})
    assert exact_dup.drop_exact_duplicates(rows.limit(0)).count() == 0


def linked(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return sets, label


@pytest.mark.parametrize("block", [512, 1])  # 1: every member is a block of its own
def test_near_components(spark, block):
    body = [f"n{i}" for i in range(80)]
    chain = [(200 + j, " ".join(body[:j] + [f"z{j}"] + body[j + 1:])) for j in range(0, 80, 4)]
    steps = [(300 + j, " ".join(f"s{i}" for i in range(6 * j, 6 * j + 60))) for j in range(8)]  # only neighbours are linked
    rows = texts() + chain + steps
    sets, label = linked(rows)
    least = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    want = [(i, len(s), (least.get(x) if s else i)) for (i, _), s, x in zip(rows, sets, label)]
    got = near_dup.near_duplicates(frame(spark, rows), block=block)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


@pytest.mark.parametrize("few", [4, 0])  # 0: every bucket is dense
def test_dense_group(spark, few):
    """Near copies of one text, most pairs between 0.60 and 0.80, against brute force."""
    import random
    rng = random.Random(6)
    body = [f"d{i}" for i in range(100)]
    rows = [(i, " ".join(w if rng.random() > rng.choice([0.01, 0.03, 0.05]) else f"x{rng.randrange(9)}" for w in body)) for i in range(250)]
    sets, label = linked(rows)
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(i, least.get(x, i))
    across = near_dup._across
    try:
        near_dup._across = lambda value: across(value, few)
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), block=64).collect()}
    finally:
        near_dup._across = across
    assert got == {i: least[x] for (i, _), x in zip(rows, label)}


def test_drop_near_keeps_one_of_each_group(spark):
    rows = frame(spark)
    kept = near_dup.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    sets, label = linked(texts())
    bare = {(i, t or "") for (i, t), s in zip(texts(), sets) if not s}
    assert kept.count() == len({x for x, s in zip(label, sets) if s}) + len(bare)
    assert near_dup.near_duplicates(rows.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (150, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}
