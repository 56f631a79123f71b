"""Similarity search and retrieval evaluation.

Scores of a set of query vectors against many candidates are matrix products on
Arrow batches.  A query set of checked size travels with the tasks and the
candidates are not shuffled; a larger one is cut into blocks that meet slices of
the candidates by a grouped join.  Searches keep k rows per batch and query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import metrics as M
from parlance.functions.scan import top_per_key
from parlance.operators.sampling import sample_n
from parlance.session import pinned

QUERY_ROWS = 1024     # queries a task may hold
SLICE_ROWS = 50_000   # candidate rows of one block pair
DIGITS = 9            # scores are rounded so that equal vectors tie exactly


def block_product(cands: DataFrame, queries: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                  query_rows: int = QUERY_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Apply fn(queries, candidates) so that every query meets every candidate once."""
    head = queries.limit(query_rows + 1).toPandas()
    if len(head) <= query_rows:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for c in batches:
                if len(c) and len(head):
                    yield fn(head, c)
        return cands.mapInPandas(scan, schema)
    nq = queries.count() // query_rows + 1
    nc = cands.count() // slice_rows + 1
    spread = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_qb", spread(queries, nq)).withColumn("_cb", every(nc))
    c = cands.withColumn("_cb", spread(cands, nc)).withColumn("_qb", every(nq))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fn(left.drop(columns=["_qb", "_cb"]), right.drop(columns=["_qb", "_cb"]))

    return q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb")).applyInPandas(meet, schema)


def _matrix(col: pd.Series) -> np.ndarray:
    m = np.asarray(col.tolist(), dtype=np.float64)
    if m.size == 0:
        return m.reshape(0, 1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _cosines(q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)))
    return np.round(_matrix(q["vector"]) @ _matrix(c["vector"]).T, DIGITS)


def _angular(cos: np.ndarray) -> np.ndarray:
    return 1.0 - np.arccos(np.clip(cos, -1.0, 1.0))


def score_pairs(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_id, id, cos, angular) of every query with every candidate.
    Both sides: (id, vector).  The output is queries x candidates by definition."""
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        cos = _cosines(q, c).ravel()
        return pd.DataFrame({"q_id": np.repeat(q["id"].to_numpy(), len(c)), "id": np.tile(c["id"].to_numpy(), len(q)),
                             "cos": cos, "angular": _angular(cos)})
    return block_product(cands.select("id", "vector"), queries.select("id", "vector"), fn, "q_id long, id long, cos double, angular double")


def top_k_similar(cands: DataFrame, queries: DataFrame, k: int, drop_self: bool = False, query_rows: int = QUERY_ROWS,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """k best candidates per query: (q_id, id, score, rank)."""
    keep = k + 1 if drop_self else k

    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        s, ids = _cosines(q, c), c["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :keep]]
        rows = np.repeat(np.arange(len(q)), best.shape[1])
        return pd.DataFrame({"q_id": q["id"].to_numpy()[rows], "id": ids[best.ravel()], "score": s[rows, best.ravel()]})

    hits = block_product(cands.select("id", "vector"), queries.select("id", "vector"), fn, "q_id long, id long, score double",
                         query_rows, slice_rows)
    if drop_self:
        hits = hits.where(F.col("q_id") != F.col("id"))
    return top_per_key(hits, ["q_id"], [F.desc("score"), F.col("id")], k)


_PRIME = 2_147_483_647


def _draws(q: np.ndarray, c: np.ndarray, seed: int) -> np.ndarray:
    """A number below 2^31 - 1 for every (query, candidate) pair of ids."""
    h = ((q % _PRIME)[:, None] * 48_271 + (c % _PRIME)[None, :] * 69_621 + seed) % _PRIME
    return (h * 16_807 + h * h % _PRIME) % _PRIME


def candidate_set(cands: DataFrame, queries: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Per query the k best distinct texts and k candidates drawn for that query, in hash
    order: (q_id, text, score, is_random).  cands and queries: (id, vector, text).

    The draw takes the k least hashes of (query, candidate); a batch lets out its k best
    texts and k least hashes of every query, so the draw needs no pass of its own."""
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        s, ids = _cosines(q, c), c["id"].to_numpy()
        texts, code = np.unique(c["text"].to_numpy().astype(str), return_inverse=True)
        order = np.argsort(code, kind="stable")
        best = np.maximum.reduceat(s[:, order], np.searchsorted(code[order], np.arange(len(texts))), axis=1)
        best[q["text"].to_numpy().astype(str)[:, None] == texts[None, :]] = -np.inf
        top = np.argsort(-best, axis=1, kind="stable")[:, :k]  # ties in text order
        h = _draws(q["id"].to_numpy(), ids, seed)
        low = np.lexsort((np.broadcast_to(ids, h.shape), h), axis=1)[:, :k]
        rows = lambda at: np.repeat(np.arange(len(q)), at.shape[1])
        i, j = rows(top), rows(low)
        out = pd.DataFrame({"q_id": q["id"].to_numpy()[np.concatenate((i, j))], "text": np.concatenate((texts[top.ravel()], c["text"].to_numpy()[low.ravel()])),
                            "score": np.concatenate((best[i, top.ravel()], s[j, low.ravel()])), "draw": np.concatenate((np.full(len(i), -1), h[j, low.ravel()])),
                            "id": np.concatenate((np.full(len(i), -1), ids[low.ravel()]))})
        return out[np.isfinite(out["score"])]

    cols = ["id", "vector", "text"]
    # texts of rows that have one, so that every row of the result shows a text
    found = pinned(block_product(cands.select(cols).where(F.col("text").isNotNull()), queries.select(cols), fn, "q_id long, text string, score double, draw long, id long"))
    best = found.where("draw < 0").groupBy("q_id", "text").agg(F.max("score").alias("score"))
    top = top_per_key(best, ["q_id"], [F.desc("score"), F.col("text")], k)
    rnd = top_per_key(found.where("draw >= 0"), ["q_id"], ["draw", "id"], k)
    out = top.withColumn("is_random", F.lit(False)).drop("rank").unionByName(rnd.select("q_id", "text", "score", F.lit(True).alias("is_random")))
    return out.orderBy("q_id", F.md5(F.concat_ws(":", F.lit(seed), "q_id", "text", "is_random")))


# --- tags, messages, caches -------------------------------------------------------

def tag_documents(tags: DataFrame) -> DataFrame:
    """(message_id, intents array<struct<name, category, tag>>), sorted and distinct."""
    return tags.groupBy("message_id").agg(F.array_sort(F.collect_set(F.struct(
        F.col("intent").alias("name"), "category", "tag"))).alias("intents"))


def tag_messages(tagged: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per message and true intent."""
    flat = tagged.select("message_id", F.explode("intents").alias("i")).select("message_id", "i.*")
    return flat.where(F.col("tag") == "true").join(messages, "message_id")


def cache_lookup(texts: DataFrame, cache: DataFrame, encoder: str) -> DataFrame:
    """Stored vector by text and encoder; null where the cache misses."""
    return texts.join(cache.where(F.col("encoder") == encoder).drop("encoder"), "text", "left")


Encoder = Callable[[list[str]], np.ndarray]


def trigram_encoder(dims: int = 64, chars: int = 1_000_000) -> Encoder:
    """Default encoder: character trigrams hashed to ``dims`` signed buckets.  Texts are
    taken together up to ``chars`` characters, and each of their distinct trigrams is hashed
    once."""
    import zlib

    def add(out: np.ndarray, texts: list[str], first: int) -> None:
        points = np.frombuffer("".join(f"#{t}#" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) + 2 for t in texts])
        row = np.repeat(np.arange(len(texts)), size)
        codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
        inside = row[:-2] == row[2:]
        grams, which = np.unique(codes[inside], return_inverse=True)
        mask = (1 << 21) - 1
        h = np.array([zlib.crc32((chr(g >> 42) + chr(g >> 21 & mask) + chr(g & mask)).encode()) for g in grams.tolist()], np.int64)
        sign = np.where(h & 0x80000000, 1.0, -1.0)
        cells = row[:-2][inside] * dims + (h % dims)[which]
        out[first: first + len(texts)] = np.bincount(cells, sign[which], len(texts) * dims).reshape(len(texts), dims)

    def encode(texts: list[str]) -> np.ndarray:
        out, first, held = np.zeros((len(texts), dims)), 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= chars:
                add(out, texts[first: i + 1], first)
                first, held = i + 1, 0
        if first < len(texts):
            add(out, texts[first:], first)
        return out
    return encode


def encode_missing(texts: DataFrame, cache: DataFrame, name: str, encoder: Encoder) -> DataFrame:
    """(text, encoder, vector) for the distinct texts the cache does not hold."""
    known = cache.where(F.col("encoder") == name).select("text")
    todo = texts.select("text").where(F.length("text") > 1).distinct().join(known, "text", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text": b["text"], "encoder": name, "vector": list(encoder(b["text"].tolist()))})
    return todo.mapInPandas(run, "text string, encoder string, vector array<double>")


# --- message vectors --------------------------------------------------------------

@dataclass(frozen=True)
class VectorSpec:
    """Which parts enter a message vector.  fields: (name, fixed length); a field's
    names are padded with ``*`` and each contributes its vector.  mean: use the mean
    of all entity vectors instead.  counts: add the field sizes as dimensions."""
    fields: tuple[tuple[str, int], ...] = ()
    mean: bool = False
    counts: bool = False
    text_length: bool = False
    filler: str = "*"
    scale: float = field(default=1.0)


def vector_aggregates(df: DataFrame, keys: list[str], vector: str, **how: str) -> DataFrame:
    """Element-wise aggregates of the vectors of a key (mean, max, min, sum; by output name).
    Each task keeps one buffer of the vector's length for a key, and only buffers are
    shuffled.  Null vectors are left out; the vectors of a key have one length."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    aggs = [vector_to_array(getattr(Summarizer, fn)(v)).alias(out) for out, fn in how.items()]
    return df.where(F.col(vector).isNotNull()).groupBy(*keys).agg(*aggs)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """Mean vector per key."""
    return vector_aggregates(df, keys, vector, **{out: "mean"})


def message_vectors(messages: DataFrame, key: str, vectors: DataFrame, spec: VectorSpec) -> DataFrame:
    """(key, vector) by a spec.  messages: key, vector, text and one array column per
    field; vectors: (name, vector) with an entry for the filler."""
    from parlance.functions.expr import count_values, pad_array
    parts = messages.select(key, F.col("vector").alias("_text"), *[f for f, _ in spec.fields], *(["text"] if spec.text_length else []))
    cols = ["_text"]
    look = vectors.select(F.col("name").alias("_name"), F.col("vector").alias("_v"))
    one = vectors.where(F.col("name") == spec.filler).select(F.col("vector").alias("_f"), F.lit(1).alias("_k")).limit(1)

    def looked_up(names: DataFrame) -> DataFrame:
        """The vector of each name; a name without one counts as the filler."""
        d = names.join(look, "_name", "left").withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k", "left")  # one row
        return d.withColumn("_v", F.coalesce("_v", "_f"))

    if spec.fields and spec.mean:
        every = F.concat(*[F.coalesce(F.col(f), F.array().cast("array<string>")) for f, _ in spec.fields])
        names = messages.select(key, F.explode(F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(spec.filler)))).alias("_name"))
        mean = mean_vectors(looked_up(names), [key], "_v", "_mean")
        parts, cols = parts.join(mean, key, "left"), [*cols, "_mean"]
    elif spec.fields:
        empty = F.array().cast("array<string>")
        padded = F.concat(*[pad_array(F.coalesce(F.col(f), empty), n, spec.filler) for f, n in spec.fields])
        names = messages.select(key, F.posexplode(padded).alias("_i", "_name"))
        side = looked_up(names).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l")).select(key, F.flatten(F.col("_l._v")).alias("_fields"))
        parts, cols = parts.join(side, key, "left"), [*cols, "_fields"]
    extra = [count_values(F.coalesce(F.col(f), F.array().cast("array<string>"))).cast("double") for f, _ in spec.fields] if spec.counts else []
    if spec.text_length:
        extra.append(F.size(F.split("text", " ")).cast("double"))
    doubles = [F.col(c).cast("array<double>") for c in cols] + ([F.array(*extra)] if extra else [])
    return parts.select(key, F.concat(*doubles).alias("vector"))


def pooled(tokens: DataFrame, text: str, order: str, vector: str, mask: str, how: str) -> DataFrame:
    """Token vectors to one per text: mean, max, mean+max, first, last, or none (all
    token values in a row).  Masked tokens count for mean and max only if set."""
    kept = tokens.where(F.col(mask) == 1)
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        return kept.groupBy(text).agg(pick(F.col(vector), F.col(order)).alias("vector"))
    if how == "none":
        g = kept.groupBy(text).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).alias("v")))).alias("_l"))
        return g.select(text, F.flatten(F.col("_l.v")).alias("vector"))
    v = vector_aggregates(kept, [text], vector, **{f"_{h}": h for h in how.split("+")})
    return v.select(text, F.concat(*[F.col(f"_{h}") for h in how.split("+")]).alias("vector"))


# --- evaluation -------------------------------------------------------------------

def _flagged_pairs(cands: DataFrame, queries: DataFrame, cut: float | None, counts: bool) -> DataFrame:
    """Pairs (or their counts per score) with a same-intent flag.  Counting happens
    inside each batch, so all pairs are never written anywhere."""
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        s = np.round(_angular(_cosines(q, c)), DIGITS)
        same = q["intent"].to_numpy()[:, None] == c["intent"].to_numpy()[None, :]
        qi, ci = np.nonzero(s >= cut) if cut is not None else np.nonzero(np.ones_like(same))
        d = pd.DataFrame({"intent": q["intent"].to_numpy()[qi], "score": s[qi, ci], "same": same[qi, ci].astype(np.int64)})
        if counts:
            return d.groupby(["intent", "score"], as_index=False).agg(n=("same", "size"), tp=("same", "sum"))
        return d.assign(q_id=q["id"].to_numpy()[qi], id=c["id"].to_numpy()[ci])[["q_id", "id", "intent", "score", "same"]]

    cols = ["id", "intent", "vector"]
    schema = "intent long, score double, n long, tp long" if counts else "q_id long, id long, intent long, score double, same long"
    return block_product(cands.select(cols), queries.select(cols), fn, schema)


def split_stats(data: DataFrame, queries: DataFrame) -> DataFrame:
    """Per intent: candidates, queries, true pairs (product) and their shares."""
    d = data.groupBy("intent").agg(F.count(F.lit(1)).alias("n_data"))
    q = queries.groupBy("intent").agg(F.count(F.lit(1)).alias("n_queries"))
    j = d.join(q, "intent", "full").na.fill(0).withColumn("true_pairs", F.col("n_data") * F.col("n_queries"))
    from parlance.operators.rates import share_of
    return share_of(share_of(j, "n_data", [], "data_share"), "true_pairs", [], "pair_share")


def retrieval_eval(vectors: DataFrame, n_queries: int, seed: int = 1) -> DataFrame:
    """AP and AUC of same-intent retrieval: over all pairs, over the N best pairs
    (N = number of true pairs) and as mean over query intents."""
    queries = sample_n(vectors, "id", n_queries, seed)
    rest = vectors.join(queries.select("id"), "id", "left_anti")
    counts = _flagged_pairs(rest, queries, None, True).groupBy("intent", "score").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    counts = pinned(counts)  # read by four jobs below
    per = M.from_counts(counts, "score", ["intent"]).agg(F.avg("ap").alias("ap"), F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("score").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    every = M.from_counts(whole, "score", [])
    cut = M.score_of_rank(whole, "score")
    best = M.top_n_of(_flagged_pairs(rest, queries, cut, False), "score", "same", ["q_id", "id"], every)
    top = M.ap_auc(best, "score", "same")
    part = lambda df, name: df.select(F.lit(name).alias("rows_used"), "ap", "auc", F.col("n").cast("long").alias("n"))
    return part(every, "all").unionByName(part(top, "top_n")).unionByName(part(per, "per_intent"))


def eval_summary(results: DataFrame, keys: list[str], metric: str, value: str, metrics: list[str]) -> DataFrame:
    """Results pivoted to one column per metric."""
    return results.groupBy(*keys).pivot(metric, metrics).agg(F.max(value))
