"""File sources and sinks.  Every schema is declared; nothing passes the driver."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import pair_lines, split_words
from parlance.session import scratch
from parlance.sources.schemas import QA


# --- delimited and columnar tables ----------------------------------------------

_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"  # times keep their microseconds
_DELIMITED = {"header": "true", "quote": '"', "escape": '"', "timestampFormat": _TIME, "timestampNTZFormat": _TIME}


def read_events(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited file with header; quote and escape are both ``"``."""
    return spark.read.schema(schema).options(**_DELIMITED, sep=sep).csv(path)


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Result table as delimited text, one file per task."""
    df.write.mode("overwrite").options(**_DELIMITED, sep=sep).csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a stored table by the result, also when the result reads that table: the
    result is written beside it, once, and takes its place when it is whole."""
    path = path.rstrip("/")
    stage = f"{path}_{uuid.uuid4().hex}"
    df.write.parquet(stage)
    sc = df.sparkSession.sparkContext
    old, new = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (path, stage))
    fs = old.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{stage} could not take the place of {path}")


def write_groups(df: DataFrame, keys: list[str], path: str) -> None:
    """One folder per group.  The rebalance hint gathers a group's rows into few
    files and still splits a group too large for one task."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


# --- text files -------------------------------------------------------------------

def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines numbered from 0 over the files in path order.

    Lines of one file block have consecutive ids, so a line's number is its block's
    offset plus its place in the block.  Only the block table (one row per block) is
    aggregated and joined; lines are neither sorted nor shuffled."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return lines.join(offsets, ["_file", "_at"]).select((F.col("_off") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def _line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each file block: the blank lines before every line, and its number among the
    other lines since the last of them.  Rows of a block come in file order."""
    block, breaks, since = None, 0, 0
    for b in batches:
        text = pc.ascii_trim_whitespace(b.column("value"))
        blank = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        keys = list(zip(b.column("file").to_pylist(), b.column("at").to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        before, number = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if keys[lo] != block:
                block, breaks, since = keys[lo], 0, 0
            gaps = np.cumsum(blank[lo:hi])
            lines = np.cumsum(~blank[lo:hi]) + since
            # lines counted up to the last blank line
            start = np.maximum.accumulate(np.where(blank[lo:hi], lines, 0))
            before[lo:hi], number[lo:hi] = breaks + gaps, lines - start - 1
            breaks, since = breaks + int(gaps[-1]), int(lines[-1] - start[-1])
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("at"), text, pa.array(blank), pa.array(before), pa.array(number)], names=["file", "at", "text", "blank", "breaks", "number"])


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, sent_no, text) of files with a sentence per line and a blank line between
    documents; lines end with \\n, \\r\\n or \\r, and a line of white space is blank.

    Files stay splittable and lines are not shuffled: a task counts blank lines and
    sentences in its file blocks, and what a block takes over from the blocks before it
    comes from a table with one row for each block.  ``doc_key`` names the file and the
    place in it, so equal documents differ.  Text without a blank line is one document; an
    empty file has none."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.mapInArrow(_line_blocks, "file string, at long, text string, blank boolean, breaks long, number long")
    told = lines.groupBy("file", "at").agg(F.max("breaks").alias("n_breaks"), F.count_if(~F.col("blank")).alias("n_lines"),
                                           F.max(F.when(~F.col("blank"), F.struct("breaks", "number"))).alias("last"))
    # sentences at the end of a block that a next block goes on with
    tail = F.when(F.col("last.breaks") == F.col("n_breaks"), F.col("last.number") + 1).otherwise(0)
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumns({"base": F.coalesce(F.sum("n_breaks").over(w), F.lit(0)), "seen": F.coalesce(F.sum("n_lines").over(w), F.lit(0))})
    closed = F.when(F.col("n_breaks") > 0, F.col("seen") + F.col("n_lines") - tail)
    told = told.withColumn("carry", F.col("seen") - F.coalesce(F.last(closed, ignorenulls=True).over(w), F.lit(0))).select("file", "at", "base", "carry")
    # one row for each block of the input
    d = lines.where(~F.col("blank")).join(told, ["file", "at"])
    return d.select(F.concat_ws("#", "file", F.col("base") + F.col("breaks")).alias("doc_key"),
                    (F.col("number") + F.when(F.col("breaks") == 0, F.col("carry")).otherwise(0)).cast("int").alias("sent_no"), "text")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(*[c.alias(n) for n, c in pair_lines("value").items()])


# fixed values: column positions of the pair corpora (text a, text b, label, id,
# language; -1 is the last column), whether a header line is skipped, test label
LAYOUTS = {
    "xnli_train": {"a": 0, "b": 1, "label": 2, "header": True},
    "xnli_dev": {"a": 6, "b": 7, "label": 1, "language": 0, "header": True},
    "mnli": {"a": 8, "b": 9, "label": -1, "id": 0, "header": True, "test_label": "contradiction"},
    "mrpc": {"a": 3, "b": 4, "label": 0, "header": True, "test_label": "0"},
    "cola": {"a": 3, "label": 1, "header": False, "test_label": "0"},
    "cola_test": {"a": 1, "label": None, "header": True, "test_label": "0"},
}


def read_corpus(spark: SparkSession, path: str, layout: str, part: str, language: str | None = None) -> DataFrame:
    """(guid, text_a, text_b, label) of a tab-separated corpus, by column position."""
    at = LAYOUTS[layout]
    d = numbered_lines(spark, path).withColumn("f", F.split("value", "\t"))
    if at["header"]:
        d = d.where("line_no > 0")
    if language and "language" in at:
        d = d.where(F.get("f", F.lit(at["language"])) == language)

    def field(name: str) -> Column:
        i = at.get(name)
        if i is None:
            return F.lit(None).cast("string")
        return F.element_at("f", -1) if i == -1 else F.get("f", F.lit(i))

    label = F.lit(at["test_label"]) if part == "test" and "test_label" in at else field("label")
    label = F.when(label == "contradictory", "contradiction").otherwise(label)
    number = field("id") if "id" in at else F.col("line_no").cast("string")
    return d.select(F.concat(F.lit(part + "-"), number).alias("guid"), field("a").alias("text_a"), field("b").alias("text_b"), label.alias("label"))


def read_parallel(spark: SparkSession, first: str, second: str, labels: str, ids: dict[str, int]) -> DataFrame:
    """Three files zipped by line number; label names to ids."""
    a = numbered_lines(spark, first).withColumnRenamed("value", "s1")
    b = numbered_lines(spark, second).withColumnRenamed("value", "s2")
    c = numbered_lines(spark, labels).withColumnRenamed("value", "name")
    number = F.coalesce(*[F.when(F.trim("name") == n, i) for n, i in ids.items()])
    return a.join(b, "line_no").join(c, "line_no").select("line_no", "s1", "s2", number.alias("label"))


def read_word_vectors(spark: SparkSession, path: str, vocab: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """(word, vector) of ``word v1 v2 ..`` lines: words of a vocabulary, or lines
    0 .. ``first`` plus the sentence marks wherever they stand."""
    from parlance.operators.textjobs import SPECIALS
    if vocab is None and first is not None:
        lines = numbered_lines(spark, path)
    else:
        lines = spark.read.text(path).withColumn("line_no", F.lit(0))
    parts = F.split(F.trim("value"), " ")
    d = lines.select("line_no", F.get(parts, F.lit(0)).alias("word"), F.slice(parts, F.lit(2), F.size(parts)).cast("array<double>").alias("vector"))
    if vocab is not None:
        d = d.join(vocab.select("word").distinct(), "word", "left_semi")
    elif first is not None:
        d = d.where((F.col("line_no") <= first) | F.col("word").isin(SPECIALS))
    return d.select("word", "vector")


def read_qa(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """One row per question of a nested QA corpus: words of the context, first answer
    and its word positions; -1 and empty for impossible questions.  Answers that the
    words cannot spell are dropped.  A corpus is one JSON file or one JSON per line."""
    d = spark.read.schema(QA).option("multiLine", multiline).json(path)
    p = d.select(F.explode("data").alias("e")).select(F.explode("e.paragraphs").alias("p"))
    q = p.select("p.context", F.explode("p.qas").alias("q")).select(
        "context", "q.id", "q.question", F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"), F.get("q.answers", F.lit(0)).alias("a"))
    words = split_words("context")
    word_at = lambda offset: F.size(split_words(F.substring("context", F.lit(1), offset + 1))) - 1
    q = q.withColumn("words", words)
    start = word_at(F.col("a.answer_start"))
    end = word_at(F.col("a.answer_start") + F.length("a.text") - 1)
    bad = F.col("is_impossible")
    q = q.withColumns({"start_position": F.when(bad, -1).otherwise(start), "end_position": F.when(bad, -1).otherwise(end),
                       "answer": F.when(bad, "").otherwise(F.col("a.text"))})
    said = F.array_join(F.slice("words", F.col("start_position") + 1, F.col("end_position") - F.col("start_position") + 1), " ")
    spelt = F.contains(F.when(~bad, said), F.array_join(split_words("answer"), " "))
    return q.where(bad | spelt).select("id", "question", "words", "answer", "start_position", "end_position", "is_impossible")


# --- stores -----------------------------------------------------------------------

def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: a new row replaces a stored one, whatever their versions; of several
    new rows the highest version stays."""
    from parlance.functions.scan import top_per_key
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return top_per_key(both, keys, [F.desc("_new"), F.desc(version)], 1, "_r").drop("_r", "_new")


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def copy_referenced(tags: DataFrame, messages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Messages that a tag names, and one row with the number of tags whose message is missing."""
    kept = messages.join(tags.select(key), key, "left_semi")
    missing = tags.select(key).distinct().join(messages.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return kept, missing


def token_layers(df: DataFrame, key: str, tokens: str, layers: dict[int, str], digits: int = 6) -> DataFrame:
    """(key, features): tokens with the rounded values of the chosen layers."""
    def one(t: Column, i: Column) -> Column:
        values = [F.struct(F.lit(n).alias("index"), F.transform(F.get(F.col(c), i), lambda v: F.round(v.cast("double"), digits)).alias("values"))
                  for n, c in layers.items()]
        return F.struct(t.alias("token"), F.array(*values).alias("layers"))
    return df.select(key, F.transform(tokens, one).alias("features"))
