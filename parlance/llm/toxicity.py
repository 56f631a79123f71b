"""Toxicity by a learned lexicon, misspellings of its terms and the words around them.

From labelled rows come the terms that stand in toxic texts more often than chance
allows.  A word that is no term is run as a Levenshtein automaton over the trie of all
terms, which finds terms one edit away.  Each hit is weighed by its context window: a
term between quotation marks, or close to a word of reporting, speaks of abuse rather
than abuses.  A logistic model turns the sums of a text into its score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parlance.llm.text_hash import mix, shingles, word_hashes
from parlance.session import pinned

WORD = re.compile(r"[^\W\d_]+")
#: quotation marks and words of reporting in the four languages of the corpus
QUOTES = frozenset("\"“”„«»‹›‘’")
REPORTING = frozenset("said says called quote quoted wrote sagte schrieb nannte zitat dit appelé écrit cité dijo llamó escribió cita".split())
WINDOW = 6  # words on each side
FUZZY = 5  # letters from which a term is also found with one edit
KNOWN = 150_000  # words remembered by a task, about 24 MB
FEATURES = ("exact", "fuzzy", "quoted", "share")
ROWS = 50_000  # labelled rows that the model sees at most, which bounds the lexicon too


class Trie:
    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        for k, t in enumerate(terms):
            at = 0
            for c in t:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(-1)
                at = self.next[at][c]
            self.end[at] = k

    def within_one(self, word: str) -> list[int]:
        """Terms one edit from the word: the automaton's states are the places of the
        word reached with no and with one edit, kept as bit masks, and the walk through the
        trie goes on while any state is alive."""
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        last, found = 1 << len(word), []
        stack = [(0, 1, 2)]  # node, states without edit, states with one (a deleted letter)
        while stack:
            node, none, one = stack.pop()
            if self.end[node] >= 0 and one & last:
                found.append(self.end[node])
            for c, child in self.next[node].items():
                hit = places.get(c, 0)
                n = (none & hit) << 1
                # one edit: match on, insert the term's letter, replace a letter, then delete one
                o = ((one & hit) << 1) | none | (none << 1) | (n << 1)
                o &= (last << 1) - 1
                if n or o:
                    stack.append((child, n, o))
        return found


@dataclass
class Model:
    terms: dict[str, float]  # term: log odds
    weights: list[float]
    bias: float


class Scorer:
    def __init__(self, model: Model):
        self.names, self.model = list(model.terms), model
        self.trie = Trie([t for t in self.names if len(t) >= FUZZY])
        self.fuzzy = [t for t in self.names if len(t) >= FUZZY]
        half = lambda t: len(t) // 2  # noqa: E731  one edit leaves a half whole
        self.heads = {t[: half(t)] for t in self.fuzzy}
        self.tails = {t[half(t):] for t in self.fuzzy}
        self.sizes = sorted({len(h) for h in self.heads}), sorted({len(t) for t in self.tails})
        self.known: dict[str, tuple[str, float] | None] = {}

    def word(self, w: str) -> tuple[str, float] | None:
        """('exact' or 'fuzzy', log odds of the term), or None."""
        if w in self.model.terms:
            return "exact", self.model.terms[w]
        n = len(w)
        if n < FUZZY - 1 or not self.fuzzy:
            return None
        if not (any(w[:k] in self.heads for k in self.sizes[0]) or any(w[n - k:] in self.tails for k in self.sizes[1] if k <= n)):
            return None
        near = self.trie.within_one(w)
        return ("fuzzy", max(self.model.terms[self.fuzzy[k]] for k in near)) if near else None

    def token(self, t: str):
        hits = [h for w in WORD.findall(t) if (h := self.word(w))]
        return hits or None

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        known = self.known
        hits = []
        for i, t in enumerate(tokens):
            try:
                h = known[t]
            except KeyError:
                if len(known) > KNOWN:
                    known.clear()
                h = self.token(t)
                if len(t) <= 64:
                    known[t] = h
            if h:
                hits.append((i, h))
        sums = dict.fromkeys(FEATURES, 0.0)
        for i, found in hits:
            quoted = self.quoted(tokens, i)
            for kind, odds in found:
                sums["quoted" if quoted else kind] += odds
        out = [math.log1p(sums[k]) for k in FEATURES[:3]]
        return [*out, math.log1p(100 * sum(len(h) for _, h in hits) / max(len(tokens), 1))]

    @staticmethod
    def quoted(tokens: list[str], i: int) -> bool:
        """Does the window around a hit quote it: a mark before and behind, or a word of reporting?"""
        before, behind = tokens[max(0, i - WINDOW): i], tokens[i + 1: i + 1 + WINDOW]
        own = tokens[i]
        opened = own[0] in QUOTES or any(b[0] in QUOTES for b in before)
        closed = not QUOTES.isdisjoint(own[1:]) or any(not QUOTES.isdisjoint(b[1:]) for b in behind)
        return (opened and closed) or any(WORD.sub(lambda m: m[0], b).strip(",.:;") in REPORTING for b in (*before, *behind))

    def score(self, text: str) -> float:
        z = self.model.bias + sum(w * x for w, x in zip(self.model.weights, self.features(text)))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _word_rows(batches):
    """Document counts of words by label, summed over a batch."""
    for b in batches:
        toxic, clean = {}, {}
        for t, y in zip(b.column("text"), b.column("toxic").to_pylist()):
            into = toxic if y else clean
            for w in {w for p in (t.as_py() or "").lower().split() for w in WORD.findall(p)}:
                into[w] = into.get(w, 0) + 1
        words = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic.get(w, 0) for w in words], pa.int64()), pa.array([clean.get(w, 0) for w in words], pa.int64())],
                                         names=["word", "t", "c"])


def _keys(batches):
    """Two minima of each text's shingles, in which near copies mostly agree."""
    for b in batches:
        texts = [t.as_py() or b"" for t in b.column("text").cast(pa.binary())]
        keys: list[tuple[int, int]] = []
        for first, last, counts, h in word_hashes(texts, lower=True):
            at = np.concatenate(([0], np.cumsum(counts)))
            for i in range(last - first):
                x = shingles(h[at[i]: at[i + 1]])
                keys.append((int(x.min()) >> 1, int(mix(x).min()) >> 1) if len(x) else (-1, -1))
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)]], names=[*b.schema.names, "k0", "k1"])


def one_of_copies(sample: DataFrame) -> DataFrame:
    """(text, toxic): of texts with one label and both minima equal, that of the least id hash."""
    keyed = sample.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("id"), "text", "toxic").mapInArrow(_keys, "h long, id string, text string, toxic int, k0 long, k1 long")
    return keyed.groupBy("toxic", "k0", "k1").agg(F.min(F.struct("h", "id", "text")).alias("x")).select("x.text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Learn from at most ``rows`` labelled rows, those of the least hash of the id, never
    held-out ones: two thirds give the lexicon, a third the weights.

    Of near copies with one label (both minima equal) one is used for the lexicon, else the words of a text that stands there
    many times would seem to be what makes it toxic.  A word is a term if its share of toxic
    texts exceeds the overall share by more than chance explains over all words (the
    exponential bound of the binomial, half a false term expected) and nine of ten texts
    with it are toxic.  Rows without a label or an id are
    not used.  With too few labels the lexicon is empty and every text has the same score."""
    y = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
         .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    few = F.broadcast(y.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(3)).cast("int")))  # rows x 20 bytes at most
    sample = pinned(docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "text", "toxic", "part"))
    first = pinned(one_of_copies(sample.where("part < 2")))
    n = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, [0.0] * len(FEATURES), -2.0)
    p0 = n_toxic / (n_toxic + n_clean)
    counts = first.select("text", "toxic").mapInArrow(_word_rows, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total, p = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    gain = total * (p * F.log(p / p0) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - p0))).otherwise(F.lit(0.0)))
    scored = counts.where(F.col("t") > 0).withColumn("gain", F.when(p > p0, gain).otherwise(F.lit(0.0)))
    # every word that a toxic text holds was tried
    tried = scored.count()
    odds = F.log((F.col("t") + 0.5) / (n_toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n_clean - F.col("c") + 0.5))
    best = scored.where(F.col("gain") >= math.log(2 * max(tried, 1))).withColumn("odds", odds).where("t >= 9 * c").orderBy(F.col("gain").desc(), "word").collect()  # words of the sample's toxic texts
    lexicon = {r["word"]: float(r["odds"]) for r in best}
    if not lexicon:
        return Model({}, [0.0] * len(FEATURES), math.log(p0 / (1 - p0)))
    blank = Model(lexicon, [0.0] * len(FEATURES), 0.0)

    def measure(batches):
        scorer = Scorer(blank)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([scorer.features(t.as_py() or "") for t in b.column("text")], pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = sample.where("part = 2").select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").toPandas()  # rows / 3 short vectors
    weights, bias = _logistic(np.array(seen.x.tolist()).reshape(-1, len(FEATURES)), seen.toxic.to_numpy(float))
    return Model(lexicon, weights, bias)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> tuple[list[float], float]:
    """Newton steps with a small ridge; weights below zero are set to zero, since no hit
    speaks against toxicity."""
    if not len(y):
        return [1.0] * len(FEATURES), -2.0
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    on = np.ones(a.shape[1], bool)
    for _ in range(4):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) + ridge * w
            h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
            step = np.zeros(len(w))
            step[on] = np.linalg.solve(h[np.ix_(on, on)], g[on])
            w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        low = (w[:-1] < 0) & on[:-1]
        if not low.any():
            break
        on[:-1] &= ~low
        w[:-1][low] = 0.0
    return [float(v) for v in w[:-1]], float(w[-1])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to the rows.

    Whole texts are read; a null or empty text has the score of a text without hits.
    Repeated rows and nulls in other columns are kept as they are."""
    out = docs.drop("score", "predicted")
    names, fields = out.columns, out.schema

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            scores = [scorer.score(t.as_py() or "") for t in b.column(names.index(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*names, "score"])
    return (out.mapInArrow(run, StructType([*fields.fields, StructField("score", DoubleType())]))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.  Rows whose crc32 of the
    id as text is 1 modulo 3 are held out from learning; a null id is not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = learn(rows, labels)
    return score_documents(rows, model, threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows below the threshold, with all their columns; nulls and repeats as in
    ``score_documents``, an empty table gives no rows."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # a column may be called score
    model = learn(docs.select("doc_id", F.col(text_col).alias("text")), labels)
    plain = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    kept = score_documents(plain, model, threshold, names[text_col]).where("predicted = 0")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
