import functools
import hashlib
import random
import re

import duckdb
import pytest
import xxhash

from parlance.llm import fingerprint, mixing
from parlance.llm.queries import TAKEN_SQL
from tests.llm.cases import frame, shingles, texts


def test_mix_equals_plain_sums(spark):
    rows = frame(spark)
    got = mixing.mix_sources(rows)
    table_ = rows.select("doc_id", "text", "source").toArrow()  # noqa: F841  read by DuckDB
    want = duckdb.sql(TAKEN_SQL.format(docs="table_")).fetchall()
    cols = ["doc_id", "source", "size", "source_size", "target", "copies"]
    key = lambda t: tuple(map(str, t[:4]))
    mine = sorted({tuple(r) for r in got.select(*cols).collect()}, key=key)
    assert mine == sorted(set(want), key=key)
    assert got.where("copies > 3 OR copies < 0").count() == 0
    taken = mixing.mixed_documents(rows)
    assert taken.columns == rows.columns
    assert taken.count() == got.agg({"copies": "sum"}).head()[0]
    assert mixing.mix_sources(rows.limit(0)).count() == 0


def test_edited_texts_and_likeness(spark):
    rows = [r for r in texts() if r[0] != 3] + [(3, "the only three")]
    docs = fingerprint.edited_likeness(frame(spark, rows), part_bytes=2000)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    got = sorted(docs.collect(), key=lambda r: (str(r.doc_id), r.n_chars, r.edited_sha256))
    want.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [w[:3] for w in want]
    for r, (_, _, _, t, edited, after) in zip(got, want):
        for near, a, b in ((r.near_edited, t, edited), (r.near_next, t, after)):
            x, y = shingles_exact(a), shingles_exact(b)
            assert abs(near - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.25
    prints = {}
    for r, w in zip(got, want):
        prints.setdefault(w[3], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint.edited_likeness(frame(spark, rows[:1])).head().near_next == 1.0
    assert fingerprint.edited_likeness(frame(spark).limit(0)).count() == 0


def shingles_exact(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("name", ["op1_mixing", "op10_fingerprints"])
def test_native_plans_hold_no_python(spark, name):
    from parlance.llm.queries import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_fingerprint(text):
    """One permutation, bins, and for an empty bin the first full one on its probes."""
    seeded = lambda data, seed: xxhash.xxh64_intdigest(data, seed & (2**64 - 1))
    chain = lambda values: functools.reduce(lambda h, v: seeded(v.to_bytes(8, "little"), h), values, 42)
    words = [seeded(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return ""
    hashes = [chain(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [chain(words)]
    least = {}
    for h in hashes:
        b = h >> (64 - fingerprint.BIN_BITS)
        least[b] = min(h, least.get(b, h))
    out = []
    for i, (start, step) in enumerate(zip(fingerprint._START, fingerprint._STEP)):
        at = i
        for t in range(fingerprint.BINS):
            if at in least:
                break
            at = (start + t * step) % fingerprint.BINS
        out.append(f"{least[at] & 255:02x}")
    return "".join(out)


def test_fingerprints_equal_a_plain_implementation(spark):
    rng = random.Random(1)
    rows = texts() + [(1000 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 300)))) for i in range(60)]
    got = sorted((tuple(r) for r in fingerprint.fingerprints(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, plain_fingerprint(t)) for i, t in rows), key=str)
