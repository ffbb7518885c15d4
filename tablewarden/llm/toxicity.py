"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model gives each sentence a score
p_s; the document's score is the noisy-or 1 - prod(1 - p_s), so that one toxic
sentence is enough. Weights are never negative and what a sentence without any
weight would have is taken off its log(1 - p_s), so neutral sentences do not
lower a bag's clean probability however many they are. In scoring a sentence up to
NEUTRAL is neutral too: chance words of a long text do not add up. Only document
labels are known: the model is fitted by gradient descent on the document
likelihood, which learns by itself which sentences carry the label.
``offending`` then names those sentences.

Sentences end at a line break or at [.!?] before white space. Features are the
hashed distinct words of a sentence (lower case, punctuation stripped) and their
first 4 and 5 characters; a bias is shared by all sentences. Nothing but the text is an input of a score.

Fitting uses at most ``max_rows`` labelled documents, those first by a hash of
their id, whole and of every length (a documented bound: the fit is one bounded
job). Features are counted and chosen in Spark; the driver gets each document's
distinct sets of chosen features only. Scoring covers every whole text. Null and empty texts have no
sentence and score 0. Rows are scored one by one: ties and repeated rows get
equal scores. With no labelled row, or one class only, every sentence scores the
base rate (about 0 without labels). Labels of null ids or null
values are not used; a document with contradicting labels counts as toxic.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import map_texts, scratch, table

BUCKETS = 1 << 18
THRESHOLD = 0.3
NEUTRAL = 0.1
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\n\r]+")
_STRIP = ".,;:!?\"'()[]{}<>|*#&$-_~`"


@dataclass(frozen=True)
class Model:
    """Weights by hashed word (those not zero), the sentence bias, and the
    -log(1 - p) up to which a sentence is neutral."""

    weights: dict[int, float]
    bias: float
    neutral: float = 0.0

    def log_clean(self, score: float) -> float:
        """log(1 - sigmoid(bias + score)) less that of a neutral sentence, at most 0."""
        return min(0.0, self.neutral - float(np.logaddexp(0.0, self.bias + score)))


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()]


def buckets(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its first 4 and 5 characters,
    which stand for the stem of inflected and compound words."""
    word = word.strip(_STRIP)
    return [zlib.crc32(f.encode()) % BUCKETS for f in {word, word[:4] + "*", word[:5] + "*"}] if word else []


def _features(text: str | None) -> list[list[int]]:
    return [sorted({b for w in set(s.lower().split()) for b in buckets(w)}) for s in sentences(text)]


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents as (y, text), whatever their length."""
    known = (labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & use)
             .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y")))
    h = F.xxhash64("doc_id")
    last = known.select(h.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    return (docs.select("doc_id", "text").where(h <= F.lit(last))
            .join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("y", "text"))


def _telling(n, toxic, n_docs: int, p: float, min_docs: int = 3, min_z: float = 4.0):
    """Whether features in ``n`` documents, ``toxic`` of them toxic, get a weight: not those
    in fewer than ``min_docs``, or whose share of toxic documents lies within ``min_z``
    standard errors of the base rate ``p``. For arrays or columns."""
    off = toxic - n * p
    return (n >= min_docs) & (off * off >= min_z * min_z * n * p * (1 - p))


def _bag(sents: list[list[int]], chosen) -> list[tuple[tuple[int, ...], int]]:
    """The distinct sets of chosen features of a document's sentences, and how often each
    stands there. Sentences with none are neutral and need not be kept."""
    sets = Counter(tuple(w for w in s if w in chosen) for s in sents)
    return [(k, n) for k, n in sets.items() if k]


def _constant(p: float) -> Model:
    return Model({}, float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))


def fit(rows: Iterable[tuple[float, list[list[int]]]]) -> Model:
    """The model of documents held in memory as (label, hashed words by sentence)."""
    rows = [(y, sents) for y, sents in rows if sents]
    p = float(np.mean([y for y, _ in rows])) if rows else 0.0
    if not 0 < p < 1:
        return _constant(p)
    seen = np.zeros((2, BUCKETS))
    for y, sents in rows:
        seen[int(y > 0), list({w for s in sents for w in s})] += 1
    chosen = set(np.flatnonzero(_telling(seen.sum(0), seen[1], len(rows), p)).tolist())
    return descend((y, _bag(sents, chosen)) for y, sents in rows)


def descend(rows: Iterable[tuple[float, list[tuple[Iterable[int], int]]]], steps: int = 100, rate: float = 0.3,
            l2: float = 1e-4, leak: float = 1e-3) -> Model:
    """Noisy-or likelihood by Adam over bags of (features, count), both labels among
    them. ``leak`` is each document's chance to be toxic by none of its sentences."""
    ys, doc_of, counts, words = [], [], [], []
    for label, bag in rows:
        for features, n in bag:
            doc_of.append(len(ys))
            counts.append(n)
            words.append(np.array(features, np.int32))
        ys.append(label)
    y, doc_of, counts, n_docs, n_sets = np.array(ys), np.array(doc_of, int), np.array(counts, float), len(ys), len(words)
    sent_of = np.repeat(np.arange(n_sets), [len(w) for w in words])
    ids, flat = np.unique(np.concatenate([*words, np.array([], np.int32)]), return_inverse=True)
    w, b = np.zeros(len(ids)), -4.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    weight = np.where(y > 0, min(5.0, (1 - y.mean()) / y.mean()) ** 0.5, 1.0)
    for t in range(1, steps + 1):
        z = b + np.bincount(sent_of, w[flat], n_sets)
        p, base = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-b))
        # log of prod(1 - p), without the share of a sentence that has no weight
        clean = -leak - np.bincount(doc_of, counts * (np.logaddexp(0, z) - np.logaddexp(0, b)), n_docs)
        prob = np.clip(-np.expm1(clean), 1e-12, 1)
        # d(-log lik)/dz_s: clean documents p_s; toxic ones -p_s (1 - P) / P
        by_doc = weight * np.where(y > 0, -np.exp(clean) / prob, 1.0)
        g_s = by_doc[doc_of] * counts / n_docs
        g = np.append(np.bincount(flat, (g_s * p)[sent_of], len(ids)) + l2 * w, (g_s * (p - base)).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    used = w > 1e-3
    return Model(dict(zip(ids[used].tolist(), w[used].tolist())), float(b),
                 float(np.logaddexp(0, b) - np.log1p(-NEUTRAL)))


def _sentence_scores(model: Model):
    """A function from a text to [(sentence, log(1 - p))]; word weights are kept by word."""
    cache: dict[str, dict[int, float]] = {}

    def weigh(word: str) -> dict[int, float]:
        if len(cache) > 500_000:
            cache.clear()
        cache[word] = got = {k: model.weights[k] for k in buckets(word) if k in model.weights}
        return got

    def run(text: str | None) -> list[tuple[str, float]]:
        out = []
        for s in sentences(text):
            found: dict[int, float] = {}
            for w in s.lower().split():
                if got := (cache[w] if w in cache else weigh(w)):
                    found |= got
            out.append((s, model.log_clean(sum(found.values()))))
        return out

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, worst (its first worst sentence's number, -1 if none)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def setup():
        run = _sentence_scores(model)

        def one(i, text):
            logs = [x for _, x in run(text)]
            worst = min(range(len(logs)), key=logs.__getitem__) if logs else -1
            return i, float(-np.expm1(sum(logs))), len(logs), worst

        return one

    return map_texts(docs, f"doc_id {id_type}, score double, n_sentences int, worst int", None,
                     id_col, text_col, setup=setup)


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence_no, sentence, score of each sentence at or above ``threshold``."""
    def setup():
        run = _sentence_scores(model)
        return lambda i, t: (i, [{"sentence_no": n, "sentence": s, "score": p} for n, (s, x) in enumerate(run(t))
                                 if (p := float(-np.expm1(x))) >= threshold])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = map_texts(docs, f"doc_id {id_type}, hits array<struct<sentence_no:int,sentence:string,score:double>>",
                      None, "doc_id", "text", setup=setup)
    return found.select("doc_id", F.inline("hits"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they are."""
    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = _sentence_scores(model)
        for texts in batches:
            yield texts.map(lambda t: -np.expm1(sum(x for _, x in run(t)))).astype(float)

    return docs.where(rate(F.coalesce(F.col(text_col), F.lit(""))) < threshold)


def held_out() -> Column:
    """Rows never used for fitting: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, max_rows: int = 12_000) -> Model:
    """Fit on the bounded sample described above; ``use`` selects the rows allowed."""
    rows = scratch(training_rows(docs, labels, F.lit(True) if use is None else use, max_rows), "labelled")
    held = scratch(map_texts(rows, "y double, found array<int>",
                             lambda y, t: (y, sorted({w for s in _features(t) for w in s})), "y", "text"), "found")
    n_docs, p = held.where(F.size("found") > 0).agg(F.count("*"), F.avg("y")).first()
    if not p or p == 1:
        return _constant(p or 0.0)
    seen = held.select("y", F.explode("found").alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), F.sum(F.signum("y")).alias("toxic"))
    chosen = {r["word"] for r in seen.where(_telling(F.col("n"), F.col("toxic"), n_docs, p)).select("word").toLocalIterator()}

    def bag(y, text):
        sents = _features(text)
        return y, len(sents), [{"words": list(k), "n": n} for k, n in _bag(sents, chosen)]

    bags = map_texts(rows, "y double, n int, bag array<struct<words:array<int>,n:int>>", bag, "y", "text")
    return descend((r["y"], [(x["words"], x["n"]) for x in r["bag"]]) for r in bags.where("n > 0").toLocalIterator())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst")
