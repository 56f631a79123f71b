import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from parlance.llm import byte_bpe, token_counts, token_files
from parlance.llm.units import UnitIds, Units
from tests.llm.cases import frame, texts

RANKS = P.path("byte_bpe_50k.tiktoken")


def odd_texts(n=300):
    r = random.Random(4)
    some = [" \x1c\x1d\x85   \t\n\n  x", "a  b \n c ", " lead", "tail ", "ab" * 400, "ΑΣ ΣΑΣ. İ ́a ẞ", "x<|startoftext|>y <|ENDOFTEXT|> <|endoftext|"]
    some += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3000), r.randrange(0, 32)])) for _ in range(50)) for _ in range(n)]
    return some + ["".join(r.choice("etaoin shrdlu'.,") for _ in range(r.randrange(300))) for _ in range(n)] + ["".join(r.choice("abcd") for _ in range(700))]


def test_byte_bpe_equals_library():
    bpe = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rows = odd_texts() + [t or "" for _, t in texts()]
    for t, ids in zip(rows, bpe.encode(rows)):
        want = library.encode_ordinary(t)
        assert ids == struct.pack(f"<{len(want)}I", *want)
        assert bpe.decode(ids) == t.encode()


def test_counts_equal_library():
    path = P.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), token_counts.MergeCounter(path)
    rows = odd_texts() + [t or "" for _, t in texts()]
    assert mine.texts(rows) == [len(library.encode(t, add_special_tokens=False)) for t in rows]


def test_units_forget_without_harm():
    units = Units(lambda us: us, memory=1000)
    rows = [" ".join(f"w{i} v{j}" for i in range(9)) for j in range(5)] + ["", "  two  spaces ", "x" * 100]
    for _ in range(2):
        assert ["".join(v) for v in units.values(rows)] == rows


@pytest.mark.parametrize("memory,most", [(1 << 20, 1 << 20), (2000, 100), (0, 1)])
def test_unit_ids_equal_library(memory, most):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = token_files._ids(P.path("byte_bpe_50k.json"))
    units = UnitIds(ids._learn, memory)
    rows = odd_texts() + [t for _, t in texts()] + ["<|endoftext|> a <|endoftext|>b", "a\u00a0 b \u2003c", "", " ", "x"]
    column = pa.array(["skipped", *rows]).slice(1)
    got = [x for _, part in units.texts(column, most) for x in part]
    assert got == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in rows]
    assert list(units.texts(column.slice(0, 0))) == []


@pytest.mark.parametrize("empty", [False, True])
def test_queries_on_odd_rows(spark, empty):
    docs = frame(spark)
    if empty:
        docs = docs.limit(0)
    n = docs.count()
    counts = token_counts.count_tokens(docs, P.path("word_bpe_49k.json"), limit=3)
    assert counts.count() == n and counts.where("n_tokens < 0 OR over_limit != (n_tokens > 3)").count() == 0
    trip = byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in trip) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts()[:n])
    ids = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    assert sorted(bytes(r.data) for r in byte_bpe.decode_documents(ids, RANKS, P.PATTERN).collect()) == sorted((t or "").encode() for _, t in texts()[:n])


def test_files_round_trip(spark):
    path = P.path("byte_bpe_50k.json")
    library, docs = Tokenizer.from_file(path), frame(spark)
    got = token_files.encode_to_files(docs, path).collect()
    want = {}
    for i, t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    have, at = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at  # no gap between documents
        at += r.n_tokens
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert token_files.encode_to_files(docs.limit(0), path).count() == 0


def test_many_one_word_documents(spark):
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(60)], "doc_id long, text string")
    library = Tokenizer.from_file(path)
    got = token_files.encode_to_files(docs, path).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for i in range(60) for x in [library.encode(f"w{i}", add_special_tokens=False).ids + [2]]}


def test_short_document_access(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    token_files.write_ids(frame(spark), str(tmp_path / "ids"), path, partitions=3)
    got = token_files.read_documents(spark, str(tmp_path / "ids"), [12, 16]).collect()
    library = Tokenizer.from_file(path)
    want = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in texts() if i in (12, 16)}
    assert {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))) for r in got} == want
