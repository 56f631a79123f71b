import hashlib
import struct
from collections import Counter

import duckdb
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from parlance.llm import byte_bpe, toxicity
from parlance.llm.queries import TAKEN_SQL
from tests.llm.cases import frame, texts
from tests.llm.test_duplicates import linked, squeezed

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Exact dedup, near-dedup, mixing and encoding of (doc_id, text, source) by definition."""
    best = {}
    for i, t, s in rows:
        best[squeezed(t)] = min(best.get(squeezed(t), (1, 0, None, None)), (-len(t or ""), i, t, s), key=lambda r: r[:2])
    rows = sorted((i, t, s) for _, i, t, s in best.values())
    sets, label = linked([r[:2] for r in rows])
    first = {}
    for r, x in zip(rows, label):
        first.setdefault(x, r)
    rows = list(first.values())
    rest = _arrow(rows)  # noqa: F841  read by DuckDB
    copies = {r[0]: r[5] for r in duckdb.sql(TAKEN_SQL.format(docs="rest")).fetchall()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, special_tokens={})
    out = Counter()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        row = (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        out[row] += copies[i]
    return +out


def _arrow(rows):
    import pyarrow as pa
    return pa.table({n: [r[k] for r in rows] for k, n in enumerate(("doc_id", "text", "source"))}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]))


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_run_equals_plain_definitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fine = {r.doc_id for r in toxicity.toxicity(docs, labels, threshold=0.7).where("predicted = 0").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect() if r.doc_id in fine]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == plain(rows)


def test_stages_keep_columns_and_take_empty_tables(spark):
    rows = frame(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns and out.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty and long texts, and extra columns whose names clash with inner
    ones, through every stage and the whole run."""
    docs = frame(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 0, 0), (20, 0, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}, name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r.doc_id for r in rows} <= {i for i, _ in texts()}
