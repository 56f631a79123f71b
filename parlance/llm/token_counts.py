"""Token counts by byte-pair merging on a heap and a linked list.

A piece starts as one symbol per byte, the last with the word-end mark.  Its adjacent
pairs that a merge exists for stand in a heap by (rank, place); the lowest is popped,
its symbols are joined in the linked list and the pairs beside it are pushed.  The count
is the number of initial symbols minus the merges; no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm.units import Units, groups


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: bytes that
    print as themselves stay, the others follow from U+0100 on."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in stay else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts by the merges of a tokenizers file whose pre-tokenizer is one pattern of
    pieces with byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.first = [vocab[c] for c in byte_characters()]
        self.last = [vocab[c + end] for c in byte_characters()]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        special = [regex.escape(t["content"]) for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.units = Units(lambda units: list(map(self.unit, units)))

    def piece(self, data: bytes) -> int:
        """Symbols left when no pair can be merged."""
        n = len(data)
        if n == 1:
            return 1
        merges, ids = self.merges, [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], k = joined, -1, after[j]
            after[i] = k
            left -= 1
            if k < n:
                before[k] = i
                if m := merges.get((joined, ids[k])):
                    heapq.heappush(heap, (m[0], i, joined, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], joined))):
                heapq.heappush(heap, (m[0], h, ids[h], joined, m[1]))
        return left

    def unit(self, text: str) -> int:
        """Tokens of a text; a special token's string in it counts as one."""
        count, parts = 0, [text]
        if self.special and "<" in text:
            parts = self.special.split(text)
            count = len(parts) - 1
        for part in parts:
            plain = part.lower() if part.isascii() else self.normalizer.normalize_str(part)
            for p in self.pieces.findall(plain):
                count += self.piece(p.encode("utf-8"))
        return count

    def texts(self, texts: list[str]) -> list[int]:
        return list(map(sum, self.units.values(texts)))


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    """One per Python worker."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than
    ``limit`` tokens), as the tokenizers library counts without begin and end tokens,
    truncation or padding.  A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows
    and null ids are kept, other columns are not read, an empty table gives no rows.
    ``tokenizer_path`` must be readable on the executors."""
    def run(batches):
        merge = counter(tokenizer_path)
        for b in batches:
            for at, part in groups(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), b.column("n_bytes").slice(at, len(part)),
                                                  pa.array(merge.texts(part), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit))
