"""Toxicity by non-negative positive-unlabelled learning.

Only some toxic documents are known, and nothing is known about the rest. A linear
classifier is trained from the known ones and from unlabelled text: the risk of calling
unlabelled text clean, less the share of it that toxic text accounts for by the class
prior, estimates the risk on clean text. Where that estimate falls below zero the model
fits single unlabelled documents, and its steps go the other way.

Features are the lower-case words of a whole text and their beginnings, each again when
it occurs repeatedly. Spark
counts them over bounded samples (``samples`` of each kind, by the hash of the id) and the
``n_features`` that speak most for known toxic text are kept. A feature counts as much as
it tells beside the one that tells most, so that the many words which a few toxic
documents share by chance hardly move the score, however many labels there are. Training
on these small sets is numpy on the driver. Scoring covers all documents.

Labels are learned only from rows outside the held-out fold, the crc32 of the id in
``FOLDS``; ids, labels, languages and sources are never features. Empty and NULL texts
have no feature and get the score of the bias. Without known toxic documents every score
is zero. Rows without an id are scored, but not learned from. Texts are read whole, whatever
their length; repeated texts score alike and are learned from once. An empty table gives an
empty one. Other columns pass through; one with the name of the score is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.llm.common import lowest, with_columns, written

FOLDS = 5
SAMPLES, N_FEATURES, LEAST_DOCUMENTS = 8000, 2048, 3
# Lengths of the beginnings of words that are features beside the words.
STARTS = (4, 5, 6)
# A word or beginning is a feature once more when it occurs so many times.
OFTEN = (1, 2, 3)
STEPS, RATE, DECAY = 400, 0.05, 1e-4
WORD = re.compile(r"\w+")


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _counted(text: str | None) -> list[tuple[str, Counter]]:
    """Occurrences of words, and of each length of beginnings, with the mark of their names."""
    words = WORD.findall((text or "").lower())
    return [("", Counter(words)), *(("*", Counter([w[:n] for w in words if len(w) > n])) for n in STARTS)]


def features(text: str | None) -> set[str]:
    """Words of a text, their beginnings marked by a star, and which of them occur often."""
    return {
        f"{name}{mark}{f'#{k}' if k > 1 else ''}"
        for mark, counts in _counted(text)
        for name, n in counts.items()
        for k in OFTEN
        if n >= k
    }


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self._bases = frozenset(f.partition("#")[0].removesuffix("*") for f in self.weights)

    def score(self, text: str | None) -> float:
        hits = []
        for mark, counts in _counted(text):
            for name in self._bases & counts.keys():
                n = counts[name]
                hits += [f"{name}{mark}{f'#{k}' if k > 1 else ''}" for k in OFTEN if n >= k]
        # Sorted, so that the sum does not depend on the order of a set.
        z = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(hits))
        return 1 / (1 + math.exp(-min(z, 700.0))) if z > -700 else 0.0


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


class _Rows:
    """Sparse rows of zeros and the values of their features."""

    def __init__(self, rows: list[list[int]], values: np.ndarray):
        self.n, self.values = len(rows), values
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=(w * self.values)[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=len(self.values)) * self.values


def train(
    positive: list[list[int]],
    unlabelled: list[list[int]],
    width: int,
    prior: float,
    steps: int = STEPS,
    values: np.ndarray | None = None,
) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the risk after each step, by the non-negative risk estimator.

    A feature that a row has is ``values`` of it there, one if not given; the weights are
    those of features that are one.
    """
    values = np.ones(width) if values is None else values
    p, u = _Rows(positive, values), _Rows(unlabelled, values)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    risks = []
    for step in range(1, steps + 1):
        zp, zu = p.times(w) + b, u.times(w) + b
        clean = _softplus(zu).mean() - prior * _softplus(zp).mean()
        risks.append(prior * _softplus(-zp).mean() + max(0.0, clean))
        # Gradients by the margins of the risk on clean text, and of that on toxic text.
        gu, gp = _sigmoid(zu) / u.n, -prior * _sigmoid(zp) / p.n
        if clean >= 0:
            gp = gp - prior * _sigmoid(-zp) / p.n
        else:
            gu, gp = -gu, -gp
        gradient = np.append(p.back(gp) + u.back(gu) + 2 * DECAY * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w * values, b, risks


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    samples: int = SAMPLES,
    n_features: int = N_FEATURES,
) -> Model:
    """A model from the labels (doc_id, toxic 0 or 1) outside the held-out fold."""
    learnable = F.col("doc_id").isNotNull() & ~held_out("doc_id")
    known = labels.select("doc_id", "toxic").where(learnable & F.col("toxic").isNotNull())
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    if not counts["p"]:
        return Model({}, -np.inf)
    prior = min(0.9, counts["p"] / counts["n"])
    spot = F.xxhash64("doc_id", F.lit("toxic"))
    # No more ids than samples, so this side is small whatever the input.
    chosen = known.where("toxic = 1").select("doc_id").distinct().orderBy(spot).limit(samples)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(learnable)
    drawn = narrow.where(lowest(spot, samples / max(1, docs.count())))
    both = narrow.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("known", F.lit(True)).union(
        drawn.withColumn("known", F.lit(False))
    )

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"features": pa.array([sorted(features(x.as_py())) for x in batch.column(0)], pa.list_(pa.string()))}

    listed = with_columns(both, make, ["text"], {"features": T.ArrayType(T.StringType())}, ["doc_id", "known"])
    # Copies of one document would make all its words look telling.
    listed = written(listed.dropDuplicates(["known", "features"]), "toxic-samples")
    sizes = {r["known"]: r["n"] for r in listed.groupBy("known").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True):
        return Model({}, -np.inf)
    if not sizes.get(False):
        raise ValueError("no unlabelled document was drawn")
    seen = (
        listed.select("known", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count_if("known").alias("p"), F.count_if(~F.col("known")).alias("u"))
        .where(F.col("p") >= LEAST_DOCUMENTS)
    )
    # Twice the log likelihood ratio of the count against the one expected from unlabelled text.
    seen = seen.withColumn("e", F.expr(f"(u + 0.5D) * {sizes[True]}D / {sizes[False]}D"))
    tells = seen.withColumn("tells", F.expr("2 * (p * log(p / e) - (p - e))")).where("p > e")
    best = tells.select("feature", "tells").orderBy(F.desc("tells"), "feature").limit(n_features)
    told = {r["feature"]: r["tells"] for r in best.collect()}
    names = sorted(told)
    values = np.array([told[f] for f in names]) / max(told.values(), default=1.0)
    place = {f: i for i, f in enumerate(names)}
    kept = F.array_intersect("features", F.array(*map(F.lit, names))) if names else F.array().cast("array<string>")
    # As many rows as samples, with the kept features only.
    found = listed.select("doc_id", "known", kept.alias("f")).collect()
    rows = sorted((r["doc_id"], r["known"], sorted(place[f] for f in r["f"])) for r in found)
    positive, unlabelled = [f for _, k, f in rows if k], [f for _, k, f in rows if not k]
    w, b, _ = train(positive, unlabelled, len(names), prior, values=values)
    return Model({f: float(w[i]) for f, i in place.items() if w[i]}, float(b))


def scored(
    docs: DataFrame, model: Model, text: str = "text", output: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """Adds the score of every whole text; an existing column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        score = sent.value.score
        return {output: pa.array([score(x.as_py()) for x in batch.column(0)], pa.float64())}

    return with_columns(docs, make, [text], {output: T.DoubleType()}, keep)
