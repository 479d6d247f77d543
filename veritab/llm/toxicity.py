"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only documents have labels.

A sentence's probability is logistic in its words and their beginnings, hashed to 2 ** BITS features; a document's is the noisy-or of its sentences':
1 - prod(1 - p). The weights are trained through the noisy-or, on a bounded sample of labelled documents (`MAX_DOCS` of either label); the
model has a fixed size. The same weights then locate the offending sentences.

Sentences end at . ! ? and line ends. Words are those of decontaminate: ASCII letters and digits and all that is not ASCII, lower case.

Defined results: null and empty texts have no sentence and get the probability of an empty sentence; null labels are not learned
from; of several labels of a document the highest counts; repeated rows are scored each by itself; without labels all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .bytehash import ALNUM, Words, chunks, utf8
from .common import small_batches, table, written

BITS = 18
#: Bytes of the beginnings of words that are features beside whole words: compounds share them.
PREFIXES = (6, 7, 8, 9)
#: Labelled documents of either label that are trained on, at most.
MAX_DOCS = 3000
#: Documents of the sample that a word must occur in to get a weight, and their share of the toxic ones: words of a few copies are no cues.
LEAST_DOCS, LEAST_SHARE = 4, 0.02
#: And standard errors by which its shares of toxic and of other documents must differ.
LEAST_Z = 4.5
ROUNDS = 400
_ENDS = np.zeros(256, np.int64)
_ENDS[[ord(c) for c in ".!?\n"]] = 1


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(features, the sentence of each, text of each sentence, the words); sentences without words don't count."""
    w = Words(texts, ALNUM)
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    key = np.cumsum(_ENDS[w.buf])[w.start] + text if len(w.start) else np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    features, of = [w.hash], [sentence]
    for k in PREFIXES:
        long, h = w.prefixes(k)
        features.append(h)
        of.append(sentence[long])
    w.sentence = sentence
    return (np.concatenate(features) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(of), text[new], w


class Model:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    def of_sentences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
        """(log odds of each sentence, its text, the sentence of each word, the words)."""
        feature, sentence, text, w = sentences(texts)
        return self.bias + np.bincount(sentence, self.weights[feature], len(text)), text, w.sentence, w

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(probability, number of sentences of probability 0.5 and more) of each text."""
        p, n = [], []
        for lo, hi in chunks(texts):
            z, text, _, _ = self.of_sentences(texts[lo:hi])
            s = np.bincount(text, np.logaddexp(0, z), hi - lo)
            s[np.bincount(text, minlength=hi - lo) == 0] = np.logaddexp(0, self.bias)
            p.append(-np.expm1(-s))
            n.append(np.bincount(text, z >= 0, hi - lo).astype(np.int64))
        return (np.concatenate(p), np.concatenate(n)) if p else (np.zeros(0), np.zeros(0, np.int64))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """toxic, words, sentence: features of at most max_docs labelled documents of either label, those of the lowest hashes."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for y in (0, 1)]
    # at most 2 * max_docs rows of two numbers: safe to broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in utf8(b["text"]):
                f, s, _, _ = sentences([t])
                pairs = np.unique((s.astype(np.int64) << BITS) | f)
                rows.append(((pairs & ((1 << BITS) - 1)).astype(np.int32), (pairs >> BITS).astype(np.int32)))
            yield pd.DataFrame({"toxic": b["toxic"].astype("int32"), "words": [r[0] for r in rows], "sentence": [r[1] for r in rows]})

    return joined.mapInPandas(run, "toxic int, words array<int>, sentence array<int>")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, rounds: int = ROUNDS) -> Model | None:
    drawn = written(sample(docs, labels, max_docs).where("size(words) > 0"), "toxicity-sample")
    n = {bool(r["toxic"]): r["k"] for r in drawn.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("k")).collect()}
    if not n:
        return None
    # words whose shares of toxic and other documents differ by chance are left out: there are far more words than documents
    n1, n0 = max(n.get(True, 0), 1), max(n.get(False, 0), 1)
    k = drawn.select(F.col("toxic"), F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("k1"), F.count_if(F.col("toxic") <= 0).alias("k0"))
    share = F.expr(f"(k1 + k0) / {n1 + n0}D")
    z = F.expr(f"k1 / {n1}D - k0 / {n0}D") / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    telling = np.sort(k.where((F.col("k1") + F.col("k0") >= max(LEAST_DOCS, LEAST_SHARE * n1)) & (F.abs(z) >= LEAST_Z)).select("word").toPandas()["word"].to_numpy(np.int32))

    def only_telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [np.isin(w, telling) for w in b["words"]]
            yield pd.DataFrame({"toxic": b["toxic"], "n": [int(s[-1]) + 1 for s in b["sentence"]], "words": [np.asarray(w)[x] for w, x in zip(b["words"], keep)], "sentence": [np.asarray(s)[x] for s, x in zip(b["sentence"], keep)]})

    rows = drawn.mapInPandas(only_telling, "toxic int, n int, words array<int>, sentence array<int>").toPandas()
    y = rows["toxic"].to_numpy() > 0
    per_doc = rows["n"].tolist()
    shift = np.concatenate([[0], np.cumsum(per_doc)])
    feature = np.concatenate([np.asarray(w, np.int32) for w in rows["words"]])
    sentence = np.concatenate([np.asarray(s, np.int64) + k for s, k in zip(rows["sentence"], shift)])
    names, feature = np.unique(feature, return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), per_doc)
    w, b = descend(feature, sentence, doc, y, len(names), rounds)
    weights = np.zeros(1 << BITS)
    weights[names] = w
    return Model(weights, float(b))


def gradient(feature: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """(mean loss, its gradient by the weights, by the bias) of the noisy-or of the documents' sentences.

    feature, sentence: pairs of a feature and its sentence; doc: the document of each sentence; y: whether each document is toxic.
    """
    z = b + np.bincount(sentence, w[feature], len(doc))
    s = np.bincount(doc, np.logaddexp(0, z), len(y))
    e = np.exp(-s)  # the probability that no sentence is toxic
    loss = np.where(y, -np.log(np.maximum(1 - e, 1e-300)), s).mean() if len(y) else 0.0
    of_doc = np.where(y, -e / np.maximum(1 - e, 1e-9), 1.0) / len(y)
    gz = of_doc[doc] / (1 + np.exp(-z))
    return float(loss), np.bincount(feature, gz[sentence], len(w)), float(gz.sum())


def descend(feature: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray, n_features: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the mean loss, with a weak pull of the weights to 0."""
    w, b = np.zeros(n_features), -4.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, g, gb = gradient(feature, sentence, doc, y, w, b)
        g = g + 1e-6 * w
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate, c1, c2 = 0.15, 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return w, b


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted, n_offending for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            p, n = m.score(utf8(b["text"])) if m else (np.zeros(len(b)), np.zeros(len(b), np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": p, "predicted": (p >= 0.5).astype("int32"), "n_offending": n})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, score double, predicted int, n_offending bigint")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, start and end in bytes of UTF-8, probability, the sentence's words."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            for i, t in zip(b["doc_id"], utf8(b["text"])):
                z, _, sentence, w = m.of_sentences([t])
                p = 1 / (1 + np.exp(-z))
                rows = []
                for k in np.flatnonzero(p >= least):
                    at = np.flatnonzero(sentence == k)
                    x, y = int(w.start[at[0]]), int(w.end[at[-1]])
                    rows.append((i, x, y, float(p[k]), t[x:y].decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "probability", "sentence"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, start int, end int, probability double, sentence string")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_offending")
