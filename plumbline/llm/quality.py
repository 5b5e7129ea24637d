"""Document quality from a linear-chain conditional random field over lines.

Every line has shares of character classes, word statistics and repetition
measures, and the same of the lines before and after it. The field's states are
bad and good; it is trained by the weighted likelihood (``loss``) of label
sequences in which each line carries its document's label. Forward-backward gives every line's
probability of being good; their mean, weighted by the lines' lengths, is
calibrated on the training documents and is the document's score.

Training is numpy on the driver over at most ``SAMPLE`` labelled documents of at
most ``LINES`` lines each. Scoring reads every whole text once, all its lines,
without a shuffle.

Edge cases: null and empty texts have no lines and score 0; repeated rows are
scored each; rows with a null id belong to no fold and are held out; labels of
one class alone give that class everywhere; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import fold, labelled_sample, read
from .toxicity import sigmoid
from .words import Words, words_of

SAMPLE, LINES, FOLDS, HELD = 6000, 400, 3, 1
LAGS = 12
_CLASSES = np.zeros((256, 6), np.float32)  # letters, capitals, digits, bars, marks, other symbols
_CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)], 0] = 1
_CLASSES[range(65, 91), 1] = 1
_CLASSES[range(48, 58), 2] = 1
_CLASSES[ord("|"), 3] = 1
_CLASSES[[ord(c) for c in ".,;:?!'\"()-"], 4] = 1
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[]^_`{}~\\"], 5] = 1
WIDTH = 6 + 6


def lines_of(w: Words, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the non-empty lines of a chunk, their lengths in bytes, and where each row's lines begin."""
    text = w.text
    breaks = np.flatnonzero(text == 10)
    starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.append(starts[1:], len(text))
    solid = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)  # lines with a word
    starts, ends = starts[solid], ends[solid]
    size = (ends - starts).astype(np.float32)
    n = len(starts)
    out = np.zeros((n, WIDTH), np.float32)
    if n:
        for c in range(6):
            total = np.concatenate([[0], np.cumsum(_CLASSES[text, c], dtype=np.float64)])
            out[:, c] = (total[ends] - total[starts]) / size
        first, last = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
        words = np.maximum(last - first, 1)
        line = np.repeat(np.arange(n), last - first)
        own = w.hashes[first[0] : last[-1]] if n else w.hashes
        repeat = np.zeros(len(own), bool)
        for lag in range(1, LAGS + 1):
            if len(own) > lag:
                again = (own[lag:] == own[:-lag]) & (line[lag:] == line[:-lag])
                repeat[lag:] |= again
                if lag == 1:
                    out[:, 6] = np.bincount(line[1:], again, n) / words
        out[:, 7] = np.bincount(line, repeat, n) / words
        out[:, 8] = np.log1p(words) / 5
        out[:, 9] = np.minimum(np.bincount(line, (w.ends - w.starts)[first[0] : last[-1]], n) / words, 40) / 10
        tail = _CLASSES[text[np.minimum(w.ends[first[0] : last[-1]] - 1, len(text) - 1)], 5]
        out[:, 10] = np.bincount(line, tail, n) / words
        bang = text[np.minimum(w.ends[first[0] : last[-1]] - 1, len(text) - 1)] == 33
        out[:, 11] = np.bincount(line, bang, n) / words
    return out, size, np.searchsorted(starts, bounds)


def neighboured(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it in its document (0 at the ends) and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        before[1:], after[:-1] = own[:-1], own[1:]
        inner = rows[(rows > 0) & (rows < len(own))]
        before[inner] = 0
        after[inner - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], 1)


@dataclass
class Chain:
    weights: np.ndarray  # of the good state, over WIDTH * 3 + 1 features; the bad state has none
    move: np.ndarray  # 2 x 2, from state to state
    slope: float = 1.0
    shift: float = 0.0

    def run(self, unary: np.ndarray, rows: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums of all lines; the log sum of each row, and its expected moves summed over all rows, each with its weight."""
        n = np.diff(rows)
        order = np.argsort(-n, kind="stable")
        live = [int(np.searchsorted(-n[order], -t, "left")) for t in range(int(n.max(initial=0)))]  # rows longer than t
        emit = np.stack([np.zeros_like(unary), unary], 1)
        fore, back = np.zeros_like(emit), np.zeros_like(emit)
        first = rows[:-1][order]
        for t, k in enumerate(live):
            at = first[:k] + t
            if t:
                p = fore[at - 1]
                fore[at] = emit[at] + np.stack([np.logaddexp(p[:, 0] + self.move[0, s], p[:, 1] + self.move[1, s]) for s in (0, 1)], 1)
            else:
                fore[at] = emit[at]
        for t in range(len(live) - 2, -1, -1):
            at = first[: live[t + 1]] + t
            q = emit[at + 1] + back[at + 1]
            back[at] = np.stack([np.logaddexp(self.move[s, 0] + q[:, 0], self.move[s, 1] + q[:, 1]) for s in (0, 1)], 1)
        ends = rows[1:][n > 0] - 1
        whole = np.zeros(len(n))
        whole[n > 0] = np.logaddexp(fore[ends, 0], fore[ends, 1])
        row = np.repeat(np.arange(len(n)), n)
        pairs = np.flatnonzero(row[1:] == row[:-1])
        share = np.ones(len(pairs)) if weight is None else weight[row[pairs]]
        moves = np.array([[np.exp(fore[pairs, a] + self.move[a, b] + emit[pairs + 1, b] + back[pairs + 1, b] - whole[row[pairs]]) @ share for b in (0, 1)] for a in (0, 1)])
        return fore, back, whole, moves

    def marginals(self, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        fore, back, whole, _ = self.run((features @ self.weights).astype(np.float64), rows)
        return np.exp(fore[:, 1] + back[:, 1] - np.repeat(whole, np.diff(rows)))

    def quality(self, features: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the marginals of each row; NaN for rows without lines."""
        sums = lambda x: np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        top, low = sums(self.marginals(features, rows) * sizes), sums(sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (top[rows[1:]] - top[rows[:-1]]) / (low[rows[1:]] - low[rows[:-1]])

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(mean), 0.0, sigmoid(self.slope * _logit(mean) + self.shift))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(np.nan_to_num(p, nan=0.5), 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def loss(chain: Chain, features: np.ndarray, rows: np.ndarray, good: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The weighted negative log-likelihood of the label sequences with a ridge on all parameters, and its gradient (weights, then moves).

    A row's sequence has its label on every line. ``weight``: of each row's log-likelihood.
    """
    n = np.diff(rows)
    line = np.repeat(np.arange(len(n)), n)
    unary = (features @ chain.weights).astype(np.float64)
    fore, back, whole, moves = chain.run(unary, rows, weight)
    own = np.zeros(len(n))
    np.add.at(own, line, unary * good[line])
    steps = np.maximum(n - 1, 0)
    told = own + np.where(good, chain.move[1, 1], chain.move[0, 0]) * steps
    p = np.exp(fore[:, 1] + back[:, 1] - whole[line])
    stay = np.diag([weight[~good] @ steps[~good], weight[good] @ steps[good]])
    value = weight @ (whole - told) + ridge / 2 * (chain.weights @ chain.weights + (chain.move**2).sum())
    return float(value), np.concatenate([features.T @ ((p - good[line]) * weight[line]) + ridge * chain.weights, (moves - stay + ridge * chain.move).ravel()])


def fit(own: np.ndarray, sizes: np.ndarray, rows: np.ndarray, good: np.ndarray, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """Minimises ``loss`` by Adam, then calibrates. Both classes weigh alike, and a row's log-likelihood counts by its line."""
    chain = Chain(np.zeros(WIDTH * 3 + 1), np.zeros((2, 2)))
    if not len(rows) - 1 or good.all() or not good.any():
        return Chain(chain.weights, chain.move, 0.0, 30.0 if len(good) and good.all() else -30.0)
    features, n = neighboured(own, rows), np.diff(rows)
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean())) / len(good)
    m = v = np.zeros(WIDTH * 3 + 1 + 4)
    for step in range(1, rounds + 1):
        _, grad = loss(chain, features, rows, good, weight / np.maximum(n, 1), ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        delta = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        chain = Chain(chain.weights - delta[:-4], chain.move - delta[-4:].reshape(2, 2))
    x = _logit(chain.quality(features, sizes, rows))
    slope, shift = 1.0, 0.0
    for _ in range(500):
        p = sigmoid(slope * x + shift)
        slope -= 0.3 * float(((p - good) * x * weight).sum())
        shift -= 0.3 * float(((p - good) * weight).sum())
    return Chain(chain.weights, chain.move, slope, shift)


def _chunks(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    from .words import binary

    texts = binary(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    for w in words_of(column):
        bounds = offsets[w.first : w.first + len(w) + 1]
        yield lines_of(w, bounds - bounds[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Chain:
    """Learns from at most ``sample`` labelled rows outside the held-out fold."""
    picked = labelled_sample(docs, labels, "quality", fold("doc_id", FOLDS) != HELD, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for own, sizes, rows in _chunks(batch.column(0)):
                for r in range(len(rows) - 1):
                    a, b = rows[r], rows[r + 1]
                    if a < b <= a + lines:
                        yield pa.RecordBatch.from_arrays([pa.array([own[a:b].tobytes()]), pa.array([sizes[a:b].tobytes()]), batch.column(1).slice(at + r, 1)], ["own", "sizes", "label"])
                at += len(rows) - 1

    got = picked.mapInArrow(run, "own binary, sizes binary, label int").collect()
    own = [np.frombuffer(r[0], np.float32).reshape(-1, WIDTH) for r in got]
    sizes = np.concatenate([np.frombuffer(r[1], np.float32) for r in got]) if got else np.zeros(0, np.float32)
    return fit(np.concatenate(own) if own else np.zeros((0, WIDTH), np.float32), sizes, np.cumsum([0, *map(len, own)]), np.array([r[2] == 1 for r in got], bool))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scores(column, chain: Chain) -> np.ndarray:
    out = [chain.calibrated(chain.quality(neighboured(own, rows), sizes, rows)) for own, sizes, rows in _chunks(column)]
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column(2), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, chain: Chain, least: float = 0.5) -> DataFrame:
    """docs without those that score below ``least``; each row is judged where it stands, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place), held.value) >= least))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a field trained on the given labels."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
