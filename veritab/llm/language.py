"""Language identification by interpolated Kneser-Ney character models, one for each language.

Letters are classes of 6 bits: a to z have one each, other letters share 37 by a hash, and any run of other characters
is one boundary. So a model has at most 64 ** order entries a language, whatever it is trained on, and can be broadcast. The order is the same
at every size: many or rich languages are dealt to several models, collected one at a time, which gives the same entropies. Counts come from all
training documents, summed in each task before they are shuffled. A model is a sorted array of packed n-grams for each
order, with log probabilities and back-off weights beside it. A document gets the language of the lowest cross-entropy per letter; the margin to
the second one, through a logistic function fitted on a bounded sample of the training documents, is its score.

Defined results: a null text and one without letters is `und` with score 0; rows without lang are never learned from; ties go to the
language that comes first by name; repeated rows count as often as they occur; without training rows everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches, table

ORDER = 4
#: n-grams times languages of a model that several languages share, at most; further languages get models of their own.
MAX_GRAMS = 2_000_000
#: Documents that the score's logistic function is fitted on, at most: those of the lowest hashes.
CALIBRATION_ROWS = 4000
#: A score below it means that the language is uncertain: `rejected`.
REJECT = 0.5


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = ord(s.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 37
    return out


def codes(text: str | None) -> np.ndarray:
    """Classes of text's letters, with a 0 before, after and for each run between words; empty without letters."""
    if not text:
        return np.zeros(0, np.uint8)
    c = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([np.zeros(1, np.uint8), c, np.zeros(1, np.uint8)])
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    keep[0] = True
    c = c[keep]
    return c if len(c) > 1 else c[:0]


def grams(c: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at each class but the first, with boundaries before the text."""
    x = np.concatenate([np.zeros(order - 2, np.uint32), c.astype(np.uint32)])
    n = len(x) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out = x[:n].copy()
    for i in range(1, order):
        out = (out << np.uint32(6)) | x[i : i + n]
    return out


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over all rows of docs (text, lang)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for b in batches:
            for lang, rows in b.groupby("lang"):
                got = [grams(codes(t), order) for t in rows["text"]]
                g, n = np.unique(np.concatenate(got), return_counts=True)
                have.setdefault(lang, []).append((g, n))
                if len(have[lang]) >= 16:
                    have[lang] = [merged(have[lang])]
        for lang, parts in have.items():
            g, n = merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int64), "n": n})

    return docs.where("text is not null and lang is not null").select("lang", "text").mapInPandas(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Kneser-Ney models of some languages.

    orders[k]: for order k + 1, (sorted n-grams, log probabilities [n-gram, language] or NaN where a language lacks it,
    sorted contexts, log back-off weights [context, language]).
    """

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.langs, self.order = langs, order
        per = [self._one(g, n) for g, n in tables]
        self.orders = []
        for k in range(order):
            all_g = np.unique(np.concatenate([p[k][0] for p in per]))
            all_c = np.unique(np.concatenate([p[k][2] for p in per]))
            lp, bo = np.full((len(all_g), len(langs)), np.nan, np.float32), np.zeros((len(all_c), len(langs)), np.float32)
            for i, p in enumerate(per):
                lp[np.searchsorted(all_g, p[k][0]), i] = p[k][1]
                bo[np.searchsorted(all_c, p[k][2]), i] = p[k][3]
            self.orders.append([all_g, lp, all_c, bo])
        self.calibration = (1.0, 0.0)
        # the lower orders fill what a language lacks, so that one search serves all languages; below the lowest all classes are alike
        floor = self.orders[0][3][0] + np.float32(np.log(1 / 64))
        self.floor = floor
        lp = self.orders[0][1]
        lp[:] = np.where(np.isnan(lp), floor, lp)
        for k in range(1, order):
            g, lp, c, bo = self.orders[k]
            low, miss = self._lookup(g & np.uint32((1 << 6 * k) - 1), k - 1), np.isnan(lp)
            lp[miss] = (low + self._backoff(g >> np.uint32(6), k))[miss]

    def _one(self, g: np.ndarray, n: np.ndarray) -> list[tuple]:
        """(n-grams, log probabilities, contexts, log back-off weights) by order."""
        levels = [(g.astype(np.uint32), n.astype(np.float64))]
        for k in range(self.order - 1, 0, -1):
            short, c = np.unique(levels[0][0] & np.uint32((1 << 6 * k) - 1), return_counts=True)
            levels.insert(0, (short, c.astype(np.float64)))
        out, before = [], None
        for k, (gk, nk) in enumerate(levels):
            once, twice = int((nk == 1).sum()), int((nk == 2).sum())
            d = once / (once + 2 * twice) if once and twice else 0.5
            ctx, at = np.unique(gk >> np.uint32(6), return_inverse=True)
            total, kinds = np.bincount(at, nk), np.bincount(at)
            weight = d * kinds / total
            if before is None:
                lower = np.full(len(gk), 1 / 64)
            else:
                lower = before[1][np.searchsorted(before[0], gk & np.uint32((1 << 6 * k) - 1))]
            p = (nk - d) / total[at] + weight[at] * lower
            out.append((gk, np.log(p), ctx, np.log(weight)))
            before = (gk, p)
        return out

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        return at, keys[at] == x if len(keys) else np.zeros(len(x), bool)

    def _backoff(self, ctx: np.ndarray, k: int) -> np.ndarray:
        at, ok = self._find(self.orders[k][2], ctx)
        return np.where(ok[:, None], self.orders[k][3][at], np.float32(0))

    def _lookup(self, g: np.ndarray, k: int) -> np.ndarray:
        """Log probabilities [n-gram, language] of n-grams of order k + 1."""
        keys, lp, _, _ = self.orders[k]
        at, ok = self._find(keys, g)
        out = lp[at]
        if not ok.all():
            miss = np.flatnonzero(~ok)
            out[miss] = self.floor if k == 0 else self._lookup(g[miss] & np.uint32((1 << 6 * k) - 1), k - 1) + self._backoff(g[miss] >> np.uint32(6), k)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy [text, language] per class, number of classes of each text)."""
        n_langs = len(self.langs)
        out, size = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64)
        lo = 0
        while lo < len(texts):
            got, total, hi = [], 0, lo
            while hi < len(texts) and total < 400_000:
                got.append(grams(codes(texts[hi]), self.order))
                total += len(got[-1])
                hi += 1
            lens = np.array([len(x) for x in got])
            size[lo:hi] = lens
            g = np.concatenate(got)
            if len(g):
                keys, at, n = np.unique(g, return_inverse=True, return_counts=True)
                lp = self._lookup(keys, self.order - 1)
                text = np.repeat(np.arange(len(lens)), lens)
                for j in range(n_langs):
                    out[lo:hi, j] = np.bincount(text, lp[:, j][at], len(lens))
            lo = hi
        return -out / np.maximum(size, 1)[:, None], size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        e, n = self.entropies(texts)
        best = e.argmin(1)
        score = self.score(self.margin(e, n))
        return [self.langs[i] if k else "und" for i, k in zip(best, n)], np.where(n > 0, score, 0.0)

    @staticmethod
    def margin(e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far the second best is behind, times the root of the text's length."""
        two = np.sort(e, 1)[:, :2] if e.shape[1] > 1 else np.repeat(e, 2, 1) + [0.0, 1.0]
        return (two[:, 1] - two[:, 0]) * np.sqrt(n)

    def score(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))

    def calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Fits the logistic function on margins and whether the language was right."""
        w = np.array([1.0, 0.0])
        x = np.stack([m, np.ones(len(m))], 1)
        for _ in range(30):  # Newton's steps with a weak prior
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + 1e-2 * (w - [1.0, 0.0])
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        self.calibration = (float(max(w[0], 0.0)), float(w[1]))


class Shards(Model):
    """Models of different languages as one: a language's entropies do not depend on the other ones."""

    def __init__(self, parts: list[Model]) -> None:
        self.parts, self.order, self.calibration = parts, parts[0].order, (1.0, 0.0)
        self.langs = [x for p in parts for x in p.langs]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        got = [p.entropies(texts) for p in self.parts]
        return np.concatenate([e for e, _ in got], 1), got[0][1]


def _dealt(size: dict[str, int]) -> list[list[str]]:
    """Languages by name, in groups of at most MAX_GRAMS n-grams times languages or of one language."""
    out, total = [], 0
    for lang in sorted(size):
        if not out or (total + size[lang]) * (len(out[-1]) + 1) > MAX_GRAMS:
            out.append([])
            total = 0
        out[-1].append(lang)
        total += size[lang]
    return out


def train(docs: DataFrame, order: int = ORDER, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """The models of all languages of docs (doc_id, text, lang)."""
    found = counts(docs, order).persist()
    try:
        size = {r["lang"]: r["k"] for r in found.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}
        if not size:
            return None
        parts = []
        for langs in _dealt(size):
            rows = found.where(F.col("lang").isin(langs)).toPandas().sort_values(["lang", "gram"])
            by = {lang: x for lang, x in rows.groupby("lang")}
            parts.append(Model(langs, [(by[k]["gram"].to_numpy(), by[k]["n"].to_numpy()) for k in langs], order))
    finally:
        found.unpersist()
    model = parts[0] if len(parts) == 1 else Shards(parts)
    # the documents of the lowest hashes: the same ones however the rows are dealt; only two numbers of each come to the driver
    usable = docs.where("text is not null and lang is not null")
    sample = usable.select("text", "lang", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "lang").limit(calibration_rows).select("text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            e, n = m.entropies(list(b["text"]))
            y = [m.langs[i] == x for i, x in zip(e.argmin(1), b["lang"])]
            yield pd.DataFrame({"m": m.margin(e, n), "y": np.array(y, float)})[n > 0]

    got = sample.mapInPandas(margins, "m double, y double").toPandas().sort_values(["m", "y"])
    if len(got):
        model.calibrate(got["m"].to_numpy(), got["y"].to_numpy())
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            lang, score = m.predict(list(b["text"])) if m else (["und"] * len(b), np.zeros(len(b)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": lang, "score": score, "rejected": score < REJECT})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
