"""Toxicity from class-conditional Kneser-Ney bigram models.

Toxic and ordinary training texts give one interpolated model each, by absolute discounting of bigrams
and of continuation counts. Both rest on one distribution of continuation counts over all training
texts, so an expression that is rare in both classes says nothing; words seen fewer than min_count
times form one class of rare words, and such pairs have their words' probabilities. The score is the
logistic of the difference of two length-normalised log-likelihoods. Toxic text is ordinary text with
a few toxic expressions, so the likelihood of the toxic class is a mixture of both models at a fixed
rate; against the toxic model alone, the ordinary words' noise outweighs the expressions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.llm.common import durable, quoted, tidied

START = "\n"
EDGE = ".,;:!?\"'()[]{}"
MEMO = 300_000
#: Share of a toxic text's words that its own model gives.
RATE = 0.02


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Ids(dict):
    """Word (with any punctuation around it) to id; -1 for words that the model doesn't list."""

    def __init__(self, known: dict[str, int]):
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        found = self[word] = self.known.get(word.strip(EDGE), -1)
        return found


def counts(sample: DataFrame) -> DataFrame:
    """sample: toxic, text. Columns toxic, v, w, n: how often w follows v in texts of the class."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: Counter = Counter()
            for toxic, text in zip(part["toxic"], part["text"], strict=True):
                words = [START] + [w.strip(EDGE) for w in tokens(text)]
                found.update((toxic, v, w) for v, w in zip(words, words[1:], strict=False))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["toxic", "v", "w", "n"])

    return sample.mapInPandas(tidied(run), "toxic int, v string, w string, n long").groupBy("toxic", "v", "w").agg(F.sum("n").alias("n"))


class Model:
    """Ratios of toxic to ordinary probability: by word, by context, by listed pair."""

    def __init__(self, words: list[tuple], pairs: list[tuple], totals: list[float], discount: float = 0.75):
        """words: (w, continuations in ordinary, in toxic, uses as context in ordinary, in toxic);
        pairs: (v, w, count in ordinary, in toxic); totals: continuations of all words by class."""
        self.known = {w[0]: i for i, w in enumerate(words)}
        n = len(words)
        cont = np.array([w[1:3] for w in words], float).reshape(n, 2)
        uses = np.array([w[3:5] for w in words], float).reshape(n, 2)
        all_ = np.maximum(np.array(totals, float), 1)
        # The last entry stands for all rare words together.
        cont = np.vstack([cont, np.maximum(all_ - cont.sum(axis=0), 0)])
        own = np.maximum(cont - discount, 0) / all_
        rest = np.maximum(1 - own.sum(axis=0), 1e-9)
        shared = (cont.sum(axis=1) + 0.5) / (all_.sum() + 0.5 * (n + 1))
        p = own + rest * shared[:, None]
        self.p, self.word = p, p[:, 1] / p[:, 0]
        pv = np.array([self.known[v] for v, *_ in pairs], np.int64)
        pw = np.array([self.known[w] for _, w, *_ in pairs], np.int64)
        c = np.maximum(np.array([x[2:4] for x in pairs], float).reshape(len(pairs), 2) - discount, 0)
        taken = np.zeros((n, 2))
        np.add.at(taken, pv, c)
        base = np.maximum(uses, 1)
        self.left = left = 1 - taken / base
        self.context = np.append(left[:, 1] / left[:, 0], 1.0)
        q = c / base[pv] + left[pv] * p[pw]
        keys = pv * (n + 1) + pw
        order = np.argsort(keys)
        self.keys, self.q, self.pair = keys[order], q[order], (q[:, 1] / q[:, 0])[order]
        self.a, self.b = 1.0, 0.0

    def after(self, v: int) -> np.ndarray:
        """The distributions of ordinary and toxic words after a listed word."""
        out = self.left[v] * self.p
        own = self.keys // len(self.p) == v
        out[self.keys[own] % len(self.p)] = self.q[own]
        return out

    def ratio(self, text: str | None, ids: Ids) -> float:
        """Difference of the log-likelihoods per word."""
        words = tokens(text)
        if not words:
            return 0.0
        w = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        v = np.concatenate([[ids[START]], w[:-1]])
        out = self.word[w] * self.context[v]
        if len(self.keys):
            key = np.where((v >= 0) & (w >= 0), v * len(self.word) + w, -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.pair[at], out)
        return float(np.log(1 - RATE + RATE * out).mean())

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic fit of label on ratio, both classes with equal weight, by Newton steps."""
        if len(set(y.tolist())) < 2:
            return
        # Ratios far beyond the middle of the toxic rows say no more than those there.
        top = float(np.median(x[y == 1]))
        scale = max(float(np.abs(x[y == 0]).mean()), 1e-9)
        z = np.stack([np.minimum(x, top) / scale, np.ones(len(x))], axis=1)
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        beta = np.zeros(2)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-4 * beta)
            beta = beta + step / max(1.0, float(np.abs(step).max()))
        self.a, self.b = beta[0] / scale, beta[1]

    def score(self, ratio: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * ratio + self.b, -30, 30)))


def held_out(key: Column) -> Column:
    """A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 5_000, min_count: int = 5) -> Model:
    """Fits the models on the labelled rows that are not held out, of each class on its own max_rows at
    most, chosen by a hash of the key; every fourth of them serves to calibrate. Words seen fewer than
    min_count times form the class of rare words, and pairs seen so few times have no count of their own.

    A key with several labels counts as toxic if one says so; labels that are null or neither 0 nor 1,
    and null keys, are ignored; of a key with several texts the first in order is learnt from; null
    texts count as empty. Without labelled rows of both classes all scores are equal.
    """
    marks = labels.select(quoted(key).alias("key"), quoted("toxic").cast("int").alias("toxic")).filter("key is not null and toxic in (0, 1)")
    marks = marks.groupBy("key").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("key")))
    marks = durable(marks)
    parts = [marks.filter(F.col("toxic") == c).orderBy(F.xxhash64("key"), "key").limit(max_rows) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # At most 2 * max_rows small rows, and as many texts.
    texts = df.select(quoted(key).alias("key"), quoted(text).alias("text")).join(F.broadcast(chosen), "key")
    texts = texts.groupBy("key", "toxic").agg(F.min("text").alias("text"))
    texts = durable(texts.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(4))))
    pairs = durable(counts(texts.filter("part > 0").select("toxic", "text")))
    side = lambda c, x: F.sum(F.when(F.col("toxic") == c, F.col(x)).otherwise(0))
    one = pairs.withColumn("one", F.lit(1))
    ahead = one.groupBy("w").agg(side(0, "one").alias("c0"), side(1, "one").alias("c1"), F.sum("n").alias("n"))
    uses = one.groupBy(F.col("v").alias("w")).agg(side(0, "n").alias("u0"), side(1, "n").alias("u1"))
    kept = ahead.filter(F.col("n") >= min_count).join(uses, "w", "left").select("w", "c0", "c1", F.coalesce("u0", F.lit(0)).alias("u0"), F.coalesce("u1", F.lit(0)).alias("u1"))
    totals = ahead.agg(F.sum("c0"), F.sum("c1")).first()
    words = [tuple(r) for r in kept.collect()]
    start = uses.filter(F.col("w") == START).first()
    words.append((START, 0, 0, start["u0"] if start else 0, start["u1"] if start else 0))
    two = pairs.groupBy("v", "w").agg(side(0, "n").alias("n0"), side(1, "n").alias("n1")).filter(F.col("n0") + F.col("n1") >= min_count)
    known = {w[0] for w in words}
    listed = [tuple(r) for r in two.collect() if r["v"] in known and r["w"] in known]
    model = Model(words, listed, [totals[0] or 0, totals[1] or 0])

    def ratios(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids(model.known)
        for part in parts:
            yield pd.DataFrame({"toxic": part["toxic"], "ratio": [model.ratio(t, ids) for t in part["text"]]})

    held = texts.filter("part = 0").select("toxic", "text").mapInPandas(tidied(ratios), "toxic int, ratio double").toPandas()
    model.calibrate(held["ratio"].to_numpy(), held["toxic"].to_numpy())
    return model


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """df with a column `to` (0 to 1); a column of that name is replaced.

    Null and empty texts get the score of no evidence; very long texts are read whole; repeated rows
    get equal scores; an empty table stays empty. Without labelled rows of both classes every row has
    the same score.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c != to]
    schema = df.select(*[quoted(c) for c in names]).schema.add(to, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ids = Ids(own.known)
        for batch in batches:
            found = np.array([own.ratio(t, ids) for t in batch.column(len(names)).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(own.score(found))], [*names, to])

    return df.select(*[quoted(c) for c in names], quoted(text).alias("__text")).mapInArrow(tidied(run), schema)
