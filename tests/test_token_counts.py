"""Token counts: inside rows, and added up only where a key stands in several rows."""

import random
from collections import Counter

import pytest

from parlance.operators import textjobs as J
from parlance.plans import load


@pytest.mark.parametrize("repeated", [False, True])
def test_token_counts_equal_plain_counts(spark, repeated):
    rng = random.Random(7)
    rows = [(d, [rng.choice(["a", "b", "é", "aa", "\U0001f600", "", None]) for _ in range(rng.randrange(30))]) for d in range(50)] + [(60, []), (61, None), (None, ["a", "a"])]
    rows += [(3, ["a", "zz"]), (None, ["b", "a"])] if repeated else []
    df = spark.createDataFrame(rows, "id long, w array<string>").repartition(4)
    want = Counter((d, w) for d, ws in rows for w in ws or [] if w is not None)
    got = [((r.id, r.token), r.n) for r in J.token_counts(df, "id", "w", df).collect()]
    assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("repeated", [False, True])
def test_tokens_of_a_table_are_grouped_only_for_repeated_ids(spark, tmp_path, repeated):
    rows = [(1, "en", "s", "b a b2 b2 A_ a_", 15), (2, "en", "s", "b2 x", 4), (3, None, None, None, 4), (1 if repeated else 4, "en", "s", "b2", 2)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    q = load().QUERIES["x04_count_vectors"](spark, str(tmp_path))
    same = [(1, "a_", 2, 1), (2, "b2", 1, 1)]
    assert sorted(map(tuple, q.collect())) == sorted(same + ([(1, "b2", 3, 1)] if repeated else [(1, "b2", 2, 1), (4, "b2", 1, 1)]))
    assert ("Aggregate" in q._jdf.queryExecution().optimizedPlan().toString()) == repeated
