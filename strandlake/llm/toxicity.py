"""Operator 1, toxicity: non-negative positive-unlabelled learning in numpy.

A linear classifier over the distinct words of a text is trained from texts confirmed as toxic and from
texts whose label is not used at all.  With p the share of toxic texts among all (the class prior), the
risk on the negatives is estimated as the unlabelled risk less p times the positives' risk as negatives;
where that estimate falls below zero, the step goes the other way (non-negative correction), which keeps
the classifier from fitting the unlabelled texts by heart.  The prior is the input's own: the share of
toxic texts among all labelled rows that are not held out (`prior`).

Training uses a bounded sample of the labelled rows (`most_positive`, `most_unlabelled`, chosen by a hash
of doc_id): what reaches the driver doesn't grow with the input.  Nor does the vocabulary, the `most_features`
words that most of the sample's texts have; rarer ones carry no weight.  Scoring is one narrow pass over
whole texts.  A null or empty text has no words and gets the score of the bias alone.  Without any toxic
row in the training part every score is that of a bias of -30 (below 1e-12).  Extra columns are ignored;
rows that repeat a doc_id are scored one by one, and a row without a doc_id is scored and not held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, text_bytes

STRIP = b".,;:!?()[]{}\"'#*$%&|<>_-"


def words_of(text: bytes | None) -> set[bytes]:
    return {w.strip(STRIP) for w in (text or b"").lower().split()} - {b""}


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: bytes | None) -> float:
        known = self.weights
        z = self.bias + sum(map(known.__getitem__, known.keys() & words_of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def gradient(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By margin, the direction of one step of the non-negative PU risk of the sigmoid loss.

    The risk is prior * R(positive as positive) + [R(unlabelled as negative) - prior * R(positive as negative)];
    where the bracket is below zero, the step raises the bracket instead.
    """
    p, u = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (positive, unlabelled))
    dp, du = p * (1 - p) / len(p), u * (1 - u) / len(u)
    if u.mean() - prior * p.mean() >= 0:
        return -2 * prior * dp, du
    return prior * dp, -du


def train(positive: list[Collection[bytes]], unlabelled: list[Collection[bytes]], prior: float = 0.13, least_df: int = 5, most_features: int = 1 << 18, epochs: int = 60, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Model:
    """Minimise the non-negative PU risk of the sigmoid loss by Adam, in mini-batches."""
    if not positive or not unlabelled:
        return Model({}, -30.0)
    df = Counter(w for x in (*positive, *unlabelled) for w in x)
    vocabulary = [w for w, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:most_features] if n >= least_df]
    index = {w: i for i, w in enumerate(vocabulary)}

    def rows(texts):
        found = [np.fromiter(sorted(index[w] for w in x if w in index), np.int64) for x in texts]
        return np.concatenate(found) if found else np.zeros(0, np.int64), np.array([len(x) for x in found])

    (pw, pn), (uw, un) = rows(positive), rows(unlabelled)
    # Only words that are clearly more frequent among the positives are evidence, scaled by how much: the few
    # that tell learn fast, and the many words of a long text can't outweigh them.
    pd = np.bincount(pw, minlength=len(vocabulary)) + 0.5
    ud = np.bincount(uw, minlength=len(vocabulary)) + 0.5
    lift = np.log(pd / (len(positive) + 1)) - np.log(ud / (len(unlabelled) + 1))
    deviation = np.abs(pd / len(positive) - ud / len(unlabelled)) / np.sqrt(ud / len(unlabelled) / len(positive) + 1e-12)
    scale = np.where((deviation >= 4) & (lift > 0), np.minimum(np.abs(lift), 4), 0.0)
    rng = np.random.default_rng(seed)
    theta, bias = np.zeros(len(vocabulary)), -1.0
    m = v = np.zeros(len(vocabulary) + 1)
    pat, uat = np.concatenate(([0], np.cumsum(pn))), np.concatenate(([0], np.cumsum(un)))
    batches = max(1, len(unlabelled) // 1024)
    step = 0

    def margin(w, n, at, pick):
        take = np.concatenate([w[at[i] : at[i + 1]] for i in pick]) if len(pick) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(pick)), n[pick])
        return take, row, np.bincount(row, theta[take] * scale[take], len(pick)) + bias

    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)
        for p, u in zip(ps, us, strict=True):
            if not len(p) or not len(u):
                continue
            (pt, pr, pz), (ut, ur, uz) = margin(pw, pn, pat, p), margin(uw, un, uat, u)
            dp, du = gradient(pz, uz, prior)
            grad = np.zeros(len(vocabulary) + 1)
            grad[:-1] = (np.bincount(pt, dp[pr] * scale[pt], len(vocabulary)) + np.bincount(ut, du[ur] * scale[ut], len(vocabulary))) + decay * theta / len(vocabulary)
            grad[-1] = dp.sum() + du.sum()
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            theta, bias = theta - move[:-1], bias - move[-1]
    weights = theta * scale
    keep = np.flatnonzero(np.abs(weights) > 1e-4)
    return Model({vocabulary[i]: float(weights[i]) for i in keep}, float(bias))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def prior(labels: DataFrame) -> float:
    """The share of toxic texts among all labelled rows that are not held out.

    An id counts once, as toxic if any of its rows is; ids of which no row says either are left out.  Without
    any other id the share is 0.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id")))
    each = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return each.agg(F.avg("toxic")).first()[0] or 0.0


def sample(docs: DataFrame, labels: DataFrame, most_positive: int = 6000, most_unlabelled: int = 12_000, most_words: int = 1 << 12):
    """Distinct words of the training rows: confirmed toxic ones, and labelled rows of which the label isn't read.

    The chosen ids are bounded by the two parameters, so they may be broadcast.  Word sets longer than
    `most_words` (one text in many thousands) are left out of training; they are scored like all others.
    """
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    positive = hashed_sample(known.where("toxic = 1").select("doc_id").distinct(), "doc_id", most_positive)
    drawn = hashed_sample(known.select("doc_id").distinct(), "doc_id", most_unlabelled)
    picked = positive.withColumn("positive", F.lit(1)).unionByName(drawn.withColumn("positive", F.lit(0)))

    def run(batches):
        for b in batches:
            found = [b"\n".join(sorted(words_of(t))) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x if x.count(b"\n") < most_words else None for x in found], pa.binary())], names=["positive", "words"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("positive", "text").mapInArrow(run, "positive int, words binary")
    positives, others, known_words = [], [], {}  # a word is one object, however many texts hold it
    for r in rows.where("words is not null").orderBy("positive", F.xxhash64("words")).toLocalIterator():
        (positives if r.positive else others).append([known_words.setdefault(w, w) for w in bytes(r.words).split(b"\n") if w])
    return positives, others


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of docs(doc_id, text)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in text_bytes(b.column(1))], pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
