"""Token ids in files with a shared zstandard dictionary.

The ids of a document are little-endian unsigned 32-bit integers.  One dictionary is
trained on pieces of such arrays, and every document is compressed on its own with it,
so a short document costs little and is read without its neighbours.

A written folder holds two Parquet tables, which any store that Spark writes to can keep:

``dictionary``  one row: the dictionary, its SHA-256, the end id
``shards``      one row per shard of consecutive documents: number of the range it lies in,
                number within the range, dictionary hash, doc_ids, ids before each document
                counted from the range's start, token counts, offsets of the frames, frames
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm.units import UnitIds, gathered
from parlance.session import scratch

PIECE = 2048  # characters, then bytes, of a training piece
SAMPLE, DICTIONARY = 2000, 64 << 10  # training pieces and bytes of the dictionary: both bounded
SHARD = 4 << 20  # bytes of frames after which a shard ends
LEVEL = 3
SPACE = "\u0120"  # how byte-level vocabularies write a space


class _Ids:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.units = UnitIds(self._learn, memory=96 << 20)
        # tokens that begin with a space, which stands at the start of a unit only
        self.spaced = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(SPACE)]] = True

    def _learn(self, units: list[str]) -> list[bytes]:
        """Units with a leading space are encoded as one text and cut before the tokens
        that begin with it; the library sees them as it does in a text."""
        out: list[bytes] = [b""] * len(units)
        joined = [i for i, u in enumerate(units) if u[:1] == " " and " " not in u[1:]]
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([units[i] for i in joined])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(joined) and cuts[0] == 0:
                data, ends = ids.tobytes(), [*(cuts[1:] * 4).tolist(), len(ids) * 4]
                for i, a, b in zip(joined, [0, *ends], ends):
                    out[i] = data[a:b]
            else:  # a tokenizer that joins or drops spaces
                joined = []
        rest = sorted(set(range(len(units))).difference(joined))
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array, end: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """(place of the first, ids with the end id) of slices of the texts."""
        for at, part in self.units.texts(texts):
            yield at, [x + end for x in part]


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    """One per Python worker."""
    return _Ids(path)


@lru_cache(maxsize=2)
def _codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def _sha(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """A dictionary from at most SAMPLE texts of at most PIECE characters each, those of the
    least hash: a bounded sample spread over the whole corpus.  It decides the size of the
    files only, never their content.  Too little text gives the empty dictionary."""
    h = F.xxhash64("doc_id", "text")
    # a piece starts anywhere in its text; the rows are counted from the files' metadata
    part = F.substring("text", F.pmod(F.xxhash64(F.lit(1), "text"), F.greatest(F.length("text") - PIECE + 1, F.lit(1))).cast("int") + 1, F.lit(PIECE))
    some = docs.where(F.length("text") > 0).where(F.pmod(h, F.lit(max(1, docs.count()))) < 2 * SAMPLE)  # about 2 x SAMPLE rows, however many there are
    sample = some.select(h.alias("h"), part.alias("t")).orderBy("h", "t").limit(SAMPLE)
    texts = pa.array([r.t for r in sample.collect()], pa.string())
    pieces = [x[:PIECE] for _, part in _ids(tokenizer_path).encode(texts, np.array([end_id], "<u4").tobytes()) for x in part]
    size = min(DICTIONARY, sum(map(len, pieces)) // 8)
    if len(pieces) < 50 or size < 256:  # the least size of a dictionary
        return b""
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # pieces without anything in common
        return b""


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode whole texts (null: empty) with the tokenizers library, append the end id and
    write the documents in ascending id order, null ids first.  Rows of one id follow each
    other in the order of their compressed ids.  An empty table writes no shards.
    ``tokenizer_path`` must be readable on the executors.

    Texts never move: each task compresses its documents, and only frames are ordered.
    The library sees each space-bounded unit once while a task remembers it, which gives
    the ids it gives for the whole text."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(rows, tokenizer_path, end_id)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        press = _codec(dictionary)[0]
        for b in gathered(batches, "text"):
            for at, part in _ids(tokenizer_path).encode(b.column("text"), end):
                for doc_id, x in zip(b.column("doc_id").slice(at, len(part)).to_pylist(), part):
                    yield doc_id, len(x) // 4, press.compress(x)

    sha, names = _sha(dictionary), ["range", "shard", "dict_sha256", "doc_ids", "before", "counts", "offsets", "frames"]

    def shards(batches):
        from pyspark import TaskContext
        number, count, total, part, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def row():
            nonlocal count, total
            n = np.array([x[1] for x in part], np.int64)
            offsets = np.cumsum([0] + [len(x[2]) for x in part])
            before = total + np.cumsum(n) - n
            values = [number, count, sha, [x[0] for x in part], before.tolist(), n.tolist(), offsets.tolist(), b"".join(x[2] for x in part)]
            count, total = count + 1, total + int(n.sum())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        types = [pa.int32(), pa.int32(), pa.string(), pa.list_(id_type), *[pa.list_(pa.int64())] * 3, pa.binary()]
        for x in encode(batches):
            part.append(x)
            size += len(x[2])
            if size >= SHARD:
                yield row()
                part, size = [], 0
        if part:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    # the bounds are sampled through the driver: short keys only
    rows = rows.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys, "text").select("doc_id", "text")
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(records)
    spark.conf.set(records, 500)  # whole texts: batches of some megabytes, put together above
    try:
        (ranged.mapInArrow(shards, f"range int, shard int, dict_sha256 string, doc_ids array<{kind}>, before array<long>, counts array<long>, offsets array<long>, frames binary")
         .write.parquet(f"{path}/shards"))
    finally:
        spark.conf.set(records, usual)
    spark.createDataFrame([(bytearray(dictionary), sha, end_id)], "data binary, sha256 string, end_id long").write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").head()
    data = bytes(row.data)
    if _sha(data) != row.sha256:
        raise ValueError("the dictionary does not match its hash")
    return data


def _open(frames: DataFrame, kind: str, dictionary: bytes, digest: bool) -> DataFrame:
    """Documents of shards: ids, or only their checksum."""
    sha = _sha(dictionary)

    def run(batches) -> Iterator[pa.RecordBatch]:
        unpack = _codec(dictionary)[1]
        for b in batches:
            for i in range(b.num_rows):
                if b.column("dict_sha256")[i].as_py() != sha:
                    raise ValueError("a shard was written with another dictionary")
                data, offsets = b.column("frames")[i].as_buffer(), b.column("offsets")[i].as_py()
                view = memoryview(data)
                out, n, picked, before = [], [], b.column("pick")[i].as_py(), b.column("before")[i].as_py()
                for k in picked:
                    ids = unpack.decompress(view[offsets[k] : offsets[k + 1]])
                    n.append(len(ids) // 4)
                    out.append(zlib.crc32(ids) if digest else ids)
                pick = pa.array(picked, pa.int64())
                start = b.column("base")[i].as_py() or 0
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[i].values.take(pick), pa.array([start + before[k] for k in picked], pa.int64()),
                     pa.array(n, pa.int64()), pa.array(out, pa.int64() if digest else pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    return frames.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def _with_base(spark: SparkSession, path: str) -> DataFrame:
    """Shards with ``base``, the ids in all ranges before theirs: one row per range, whose
    number does not follow the documents but the partitions of the write."""
    shards = spark.read.parquet(f"{path}/shards")
    totals = shards.groupBy("range").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("range").collect()
    base, at = {}, 0
    for r in totals:
        base[r["range"]], at = at, at + r["n"]
    table = spark.createDataFrame(list(base.items()) or [(0, 0)], "range int, base long")
    return shards.join(table, "range", "left")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """All documents of a written folder: ``doc_id, start, n_tokens, ids`` (or ``ids_crc32``
    in place of the ids).  ``start`` counts the ids of all documents before."""
    shards = _with_base(spark, path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    every = shards.withColumn("pick", F.transform(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: (i - 1).cast("long")))
    return _open(every, kind, _dictionary(spark, path), digest)


def read_documents(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """The named documents only: shards without them are skipped, and of the others only
    the frames that the offset index points to are opened."""
    shards = _with_base(spark, path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    wanted = F.array(*[F.lit(x).cast(kind) for x in doc_ids])
    at = F.filter(F.transform("doc_ids", lambda x, i: F.when(F.array_contains(wanted, x), i.cast("long"))), lambda i: i.isNotNull())
    some = shards.where(F.arrays_overlap("doc_ids", wanted)).withColumn("pick", at)
    return _open(some, kind, _dictionary(spark, path), False)


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to a new folder in the shared scratch space and read the checksums back."""
    path = scratch(docs.sparkSession)
    write_ids(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_ids(docs.sparkSession, path, digest=True)
