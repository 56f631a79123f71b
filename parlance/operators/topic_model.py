"""Topics by online variational Bayes (Hoffman, Blei, Bach), the weights of the words in tables.

A model has one number per word and topic.  Words and their weights stay on the executors;
the driver sees sums per topic only.  Documents are coded in blocks of one Arrow batch, so a
word's weights go to a block once, however many of its documents hold the word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import pinned, release

CHANGE = 1e-3  # mean change of a document's topic counts at which its inference ends


def digamma(x: np.ndarray) -> np.ndarray:
    y, low = np.array(x, float), 0.0
    for _ in range(8):
        low, y = low + 1 / y, y + 1
    i = 1 / (y * y)
    return np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240))) - low


def trigamma(x: np.ndarray) -> np.ndarray:
    y, low = np.array(x, float), 0.0
    for _ in range(8):
        low, y = low + 1 / (y * y), y + 1
    i = 1 / (y * y)
    return 1 / y + i / 2 + i / y * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30))) + low


def unit(seed: int, *parts: Column) -> Column:
    """A repeatable number in (0, 1) from the parts."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def first_weights(k: int, seed: int) -> list[Column]:
    """A word's weights before the first step, about gamma(100, 1/100): the cube of a normal
    number (Wilson and Hilferty), drawn from the word itself."""
    def one(j: int) -> Column:
        z = F.sqrt(-2 * F.ln(unit(seed, F.lit(2 * j), F.col("word")))) * F.cos(2 * F.pi() * unit(seed, F.lit(2 * j + 1), F.col("word")))
        return F.pow(F.lit(1 - 1 / 900) + z / 30, F.lit(3.0))

    return [one(j) for j in range(k)]


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of each batch: its documents as (code, n) of their distinct words, and its words."""
    task = TaskContext.get().partitionId() << 32
    for number, b in enumerate(batches):
        lists = b.column("tokens")
        doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy())
        flat = lists.flatten()
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        coded = flat.drop_null().dictionary_encode()
        size = max(len(coded.dictionary), 1)
        pairs, n = np.unique(doc[there] * size + coded.indices.to_numpy(), return_counts=True)
        cuts = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) * size).astype(np.int32))
        block = task + number
        docs = [pa.array(np.full(b.num_rows, block)), b.column("key"), pa.ListArray.from_arrays(cuts, pa.array((pairs % size).astype(np.int32))),
                pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int32))), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.string())]
        names = ["block", "key", "codes", "n", "place", "word"]
        yield pa.RecordBatch.from_arrays(docs, names=names)
        m = len(coded.dictionary)
        words = [pa.array(np.full(m, block)), *[pa.nulls(m, x.type) for x in docs[1:4]], pa.array(np.arange(m, dtype=np.int32)), coded.dictionary]
        yield pa.RecordBatch.from_arrays(words, names=names)


def blocks(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(block, key, codes, n) of each document and (block, place, word) of each distinct word
    of a block, written once."""
    kind = df.schema[key].dataType.simpleString()
    d = df.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    return pinned(d.mapInArrow(_code, f"block long, key {kind}, codes array<int>, n array<int>, place int, word string"))


def infer(at: np.ndarray, n: np.ndarray, beta: np.ndarray, alpha: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topic counts (topics x documents) of documents whose words, in document order, have the
    weights ``beta`` (topics x words) and stand n times in document ``at``; the exp of their
    expected log shares, and each word's share of the topics.  A document ends on its own."""
    gamma = np.ones((len(alpha), docs))
    left = np.unique(at)  # documents that still change
    a, w, b = np.searchsorted(left, at), n, beta
    shares = lambda g: np.exp(digamma(g) - digamma(g.sum(0)))
    while len(left):
        theta = shares(gamma[:, left])
        norm = np.einsum("kp,kp->p", theta[:, a], b) + 1e-100
        new = alpha[:, None] + theta * np.add.reduceat(b * (w / norm), np.searchsorted(a, np.arange(len(left))), axis=1)
        more = np.abs(new - gamma[:, left]).mean(0) > CHANGE
        gamma[:, left] = new
        stay = more[a]
        left, a, w, b = left[more], (np.cumsum(more) - 1)[a[stay]], w[stay], b[:, stay]
    theta = shares(gamma)
    phi = theta[:, at] * beta
    return gamma, theta, phi / (phi.sum(0) + 1e-100)


def _by_block(coded: DataFrame, weights: DataFrame, run: Callable, k: int, total: np.ndarray, alpha: np.ndarray, schema: str) -> DataFrame:
    """``run`` over the documents of each block beside the weights of its words."""
    def both(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words["place"].to_numpy())
        lam = np.array([words[f"l{j}"].to_numpy()[order] for j in range(k)], float).reshape(k, -1)
        codes, n = (docs[c].combine_chunks() for c in ("codes", "n"))
        at = np.repeat(np.arange(docs.num_rows), pc.list_value_length(codes).to_numpy())
        code = codes.flatten().to_numpy()
        found = infer(at, n.flatten().to_numpy().astype(float), np.exp(digamma(lam) - digamma(total)[:, None])[:, code], alpha, docs.num_rows)
        return run(docs, words, order, at, code, n.flatten().to_numpy(), *found)

    docs = coded.where(F.col("word").isNull()).select("block", "key", "codes", "n")
    return docs.groupBy("block").cogroup(weights.groupBy("_block")).applyInArrow(both, schema)


def _word_counts(k: int) -> Callable:
    """Expected counts of each word per topic; in a row without a word the documents' expected
    log shares and their number."""
    def run(docs, words, order, at, code, n, gamma, theta, phi):
        full = np.unique(at)
        sums = [np.bincount(code, n * p, len(order)) for p in phi]
        logs = np.log(theta[:, full]).sum(1)
        word = pa.concat_arrays([words["word"].combine_chunks().take(pa.array(order)), pa.nulls(1, pa.string())])
        docs_of = pa.array(np.concatenate([np.zeros(len(order), np.int64), [len(full)]]))
        return pa.Table.from_arrays([word, *[pa.array(np.append(s, x)) for s, x in zip(sums, logs)], docs_of], names=["word", *[f"s{j}" for j in range(k)], "docs"])
    return run


def _main_topic(docs, words, order, at, code, n, gamma, theta, phi):
    share = gamma / gamma.sum(0)
    share[:, np.setdiff1d(np.arange(docs.num_rows), at)] = 0  # no words, no topic
    return pa.Table.from_arrays([docs["key"], pa.array(share.argmax(0).astype(np.int32)), pa.array(share.max(0))], names=["key", "topic", "weight"])


def _prior_step(alpha: np.ndarray, logs: np.ndarray, docs: int, rate: float) -> np.ndarray:
    """A Newton step for the documents' prior; none where it would leave the positive numbers."""
    grad = docs * (logs / docs - digamma(alpha) + digamma(alpha.sum()))
    c, q = docs * trigamma(alpha.sum()), -docs * trigamma(alpha)
    step = -(grad - (grad / q).sum() / (1 / c + (1 / q).sum())) / q
    new = alpha + rate * step
    return new if (new > 0).all() else alpha


def topics(df: DataFrame, key: str, tokens: str, k: int = 4, passes: int = 10, least: float = 0.35, seed: int = 100,
           share: float = 0.05, offset: float = 1024, decay: float = 0.51) -> DataFrame:
    """(key, topic, weight): the dominant topic of each document where it is clear.

    Online variational Bayes: each of ``passes`` steps reads another draw of ``share`` of the
    documents; then every document is given its topics.  A word's weight is its first one and
    the same prior for all, both scaled, plus what the draws have counted for it, so only
    counted words are in the table that the steps hand on."""
    docs = pinned(df.select(key, tokens))
    every = blocks(docs, key, tokens)
    start = first_weights(k, seed)
    words = every.where(F.col("word").isNotNull()).select("word").distinct()
    size, *first = words.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0.0)) for c in start]).first()
    corpus, first, eta = docs.count(), np.array(first), 1 / k
    alpha, own, prior, steps = np.full(k, 1 / k), 1.0, 0.0, 0
    names = [f"s{j}" for j in range(k)]
    state, seen = None, np.zeros(k)

    def weights(coded: DataFrame, *more: str) -> DataFrame:
        w = coded.where(F.col("word").isNotNull()).select("block", "place", "word")
        w = w.join(state.hint("merge"), "word", "left") if state is not None else w.select("*", *[F.lit(None).cast("double").alias(s) for s in names])
        return w.select(F.col("block").alias("_block"), "place", *more, *[(own * c + F.lit(prior) + F.coalesce(s, F.lit(0.0))).cast("float").alias(f"l{j}") for j, (c, s) in enumerate(zip(start, names))])

    for i in range(passes):
        coded = blocks(docs.where(unit(seed, F.lit("draw"), F.lit(i), F.col(key)) < share), key, tokens)
        counts = _by_block(coded, weights(coded, "word"), _word_counts(k), k, own * first + prior * size + seen, alpha,
                           f"word string, {', '.join(f'{s} double' for s in names)}, docs long")
        found = pinned(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in [*names, "docs"]]))
        drawn = found.where(F.col("word").isNull()).first()
        if drawn is not None and drawn["docs"]:
            steps += 1
            rate = (offset + steps) ** -decay
            gain = rate * corpus / np.ceil(share * corpus)
            new = found.where(F.col("word").isNotNull()).select("word", *[(F.col(s) * gain).alias(s) for s in names])
            if state is not None:
                old = state.select("word", *[(F.col(s) * (1 - rate)).alias(s) for s in names])
                new = new.unionByName(old).groupBy("word").agg(*[F.sum(s).alias(s) for s in names])
            last, state = state, pinned(new)
            if last is not None:
                release(last)
            seen = np.array(state.agg(*[F.sum(s) for s in names]).first(), float)
            own, prior = (1 - rate) * own, (1 - rate) * prior + rate * eta
            alpha = _prior_step(alpha, np.array([drawn[s] for s in names]), drawn["docs"], rate)
        release(coded)
        release(found)
    release(docs)
    kind = df.schema[key].dataType.simpleString()
    d = _by_block(every, weights(every), _main_topic, k, own * first + prior * size + seen, alpha, f"key {kind}, topic int, weight double")
    return d.where(F.col("weight") > least).select(F.col("key").alias(key), "topic", "weight")
