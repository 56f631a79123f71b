import hashlib
from collections import defaultdict

import pytest

from parlance.llm import substring_dup as sd
from tests.llm.cases import WORD, frame, texts


def expected(rows, k):
    starts = defaultdict(list)
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        if i is not None:
            for p in range(len(w) - k + 1):
                starts[tuple(w[p:p + k])].append(i)
    out = []
    for (i, _), w in zip(rows, words):
        cut = set()
        for p in range(len(w) - k + 1):
            if i is not None and min(starts[tuple(w[p:p + k])]) < i:
                cut |= set(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in cut)
        out.append((i, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 6])  # few bits: many windows meet, and content decides
def test_kept_words_equal_brute_force(spark, bits):
    got = [tuple(r) for r in sd.kept_digests(frame(spark), 13, hash_bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == expected(texts(), 13)


def test_kept_text_and_empty_table(spark):
    rows = frame(spark)
    got = {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in sd.remove_repeats(rows, 13).collect()}
    assert got == set(expected(texts(), 13))
    assert sd.kept_digests(rows.limit(0)).count() == 0
