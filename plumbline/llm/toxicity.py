"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained from two bounded samples: texts
confirmed as toxic, and texts whose labels are not looked at. With the class
prior p, the risk on unlabelled text minus p times the positives' risk of being
called negative estimates the negatives' risk; it cannot be negative, so where
the estimate falls below zero the step goes the other way instead of fitting the
unlabelled sample ever closer. Training is numpy on the driver; its data are at
most ``POSITIVE`` + ``UNLABELLED`` rows of hashed words. Scoring reads every whole
text once, without a shuffle.

Edge cases: a null or empty text has no words and gets the model's bias alone;
repeated rows are scored each; rows with a null id belong to no fold and are
held out; without positive labels every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import fold, labelled_sample, read
from .words import LOOSE, words_of

BITS, FEATURES, POSITIVE, UNLABELLED, FOLDS = 22, 512, 1500, 4000, 5
HEADS = (3, 4, 5, 6, 7)


def word_sets(column, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of each row's words and word beginnings, one row after the other, and where each row's begin.

    ``among``: a mask of the bins that count; the others are passed over before anything is sorted.
    """
    bins, ends = [], [np.zeros(1, np.int64)]
    at = 0
    for w in words_of(column, LOOSE):
        row, found = w.row_of().astype(np.uint64), []
        for hashes, which in ((w.hashes, None), *map(w.heads, HEADS)):
            binned, own = hashes >> np.uint64(64 - BITS), row if which is None else row[which]
            if among is not None:
                hit = among[binned]
                binned, own = binned[hit], own[hit]
            found.append(own << np.uint64(BITS) | binned)
        pair = np.unique(np.concatenate(found))
        bins.append((pair & np.uint64((1 << BITS) - 1)).astype(np.int32))
        ends.append(np.searchsorted(pair >> np.uint64(BITS), np.arange(1, len(w) + 1, dtype=np.uint64)) + at)
        at += len(pair)
    return np.concatenate(bins) if bins else np.zeros(0, np.int32), np.concatenate(ends)


@dataclass
class Linear:
    weights: np.ndarray  # by bin
    bias: float

    def of(self, column) -> np.ndarray:
        """The margins of a column of texts."""
        return self.margins(*word_sets(column, self.weights != 0))

    def margins(self, bins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[bins])])
        return sums[ends[1:]] - sums[ends[:-1]] + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def screened(positive, unlabelled, most: int = FEATURES, least: float = 4.0) -> np.ndarray:
    """The bins whose shares in the two samples differ most, in standard errors."""
    shares = [np.bincount(bins, minlength=1 << BITS) / (len(ends) - 1) for bins, ends in (positive, unlabelled)]
    spread = sum((x * (1 - x) + 1 / (len(ends) - 1)) / (len(ends) - 1) for x, (_, ends) in zip(shares, (positive, unlabelled)))
    differ = np.abs(shares[0] - shares[1]) / np.sqrt(spread)
    top = np.argsort(-differ, kind="stable")[:most]
    return np.sort(top[differ[top] >= least])


def _dense(sample, features: np.ndarray) -> np.ndarray:
    """Which of the chosen bins each row of a sample has, and a constant."""
    bins, ends = sample
    at = np.searchsorted(features, bins)
    hit = (at < len(features)) & (features[np.minimum(at, len(features) - 1)] == bins) if len(features) else np.zeros(len(bins), bool)
    out = np.zeros((len(ends) - 1, len(features) + 1), np.float32)
    out[np.repeat(np.arange(len(ends) - 1), np.diff(ends))[hit], at[hit]] = 1
    out[:, -1] = 1
    return out


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float) -> tuple[float, np.ndarray]:
    """What a step goes down on, and its gradient: prior * E_p[l(f)] + E_u[l(-f)] - prior * E_p[l(-f)] with the logistic loss l,
    or, where the last two terms (the negatives' risk) have gone below zero, these alone and turned round, so that the step goes back from there.
    The last weight is the constant's, which ``ridge`` leaves alone."""
    fp, fu = positive @ w, unlabelled @ w
    n_p, n_u = len(fp), len(fu)
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    held = np.append(w[:-1], 0)
    small, pull = ridge / n_p / 2 * float(held @ held), ridge / n_p * held
    if negative >= 0:
        return prior * np.logaddexp(0, -fp).mean() + negative + small, sigmoid(fu) / n_u @ unlabelled - np.full(n_p, prior / n_p, fp.dtype) @ positive + pull
    return small - negative, prior * sigmoid(fp) / n_p @ positive - sigmoid(fu) / n_u @ unlabelled + pull


def nnpu(positive, unlabelled, prior: float, rounds: int = 250, rate: float = 0.05, ridge: float = 0.3) -> Linear:
    """Minimises the non-negative risk prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]), with ``ridge`` over the number of positives times half the squared weights, by Adam."""
    weights = np.zeros(1 << BITS)
    n_p, n_u = len(positive[1]) - 1, len(unlabelled[1]) - 1
    if not n_p or not n_u:
        return Linear(weights, -30.0)
    features = screened(positive, unlabelled)
    xp, xu = _dense(positive, features), _dense(unlabelled, features)
    w = np.zeros(len(features) + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = risk(w, xp, xu, prior, ridge)[1].astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = w.astype(np.float32)
    weights[features] = w[:-1]
    return Linear(weights, float(w[-1]))


def _collected(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ends = word_sets(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bins))], ["bins"])

    got = [np.asarray(r[0], np.int32) for r in sample.select("text").mapInArrow(run, "bins array<int>").collect()]
    return np.concatenate([*got, np.zeros(0, np.int32)]), np.cumsum([0, *map(len, got)])


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> Linear:
    """Learns from rows outside fold 0; of the labels only the positive ones, and their share as the class prior."""
    known = labels.where(fold("doc_id", FOLDS) != 0)
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    confirmed = labelled_sample(docs, known, "toxic", F.col("toxic") == 1, positive)
    texts = labelled_sample(docs, docs.select("doc_id", F.lit(0).alias("unused")), "unused", fold("doc_id", FOLDS) != 0, unlabelled)
    return nnpu(_collected(confirmed), _collected(texts), prior)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Linear) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sigmoid(held.value.of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, SCORED)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model trained on the given labels."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
