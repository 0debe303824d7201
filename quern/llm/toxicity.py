"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word features is trained in numpy from confirmed toxic texts (positive) and from all
texts that are not held out (unlabelled: whether they have a label is not looked at). The risk is the class-prior-corrected one,
`p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive))`; where the bracket turns negative its gradient is
reversed, as the non-negative estimator asks. With the squared loss both risks and their gradients follow exactly from the
means and second moments of the features, which are distributed sums over the whole corpus; so the training
steps cost the same at every size, and no unlabelled row is sampled.

The prior is the least ratio of a feature's share among the unlabelled texts to its share among the toxic ones, over
features that many toxic texts have: no prior above it agrees with the unlabelled texts. The score is the sigmoid of the
margin, moved so that 0.7 is the threshold with the best F1, estimated from the toxic texts that were left out of
training in turn and from a histogram of all unlabelled margins. No negative label is used anywhere.

Training takes at most MAX_LABELLED toxic rows, the first in the order of a hash of doc_id: a documented bound, and the
only place where rows are sampled. What reaches the driver is bounded by it, by the number of hashed features, of
used ones squared, and of the histogram's bins.

Defined results: null and empty texts have no features and score the calibrated bias; a null doc_id is never a
training row and is not held out; repeated rows score alike; without a toxic training row every score is 0; labels
that are null are no labels; a doc_id with several labels is toxic if one says so; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import LOWER, U, docs_only, range_hashes, slices, text_of, tuned, written

#: Hashed features; those used at most.
WIDTH, USED = 1 << 18, 512
MAX_LABELLED = 6000
THRESHOLD = 0.7
#: A feature is used if so many toxic texts have it, LIFT times the unlabelled ones' share.
MIN_TEXTS, LIFT = 4, 3.0
#: The share of toxic texts that a feature must have to bound the prior; parts in which toxic texts are left out; bins of margins.
COMMON, FOLDS, BINS = 0.05, 5, 4096
#: Letters, digits and everything beyond ASCII make a word.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word features of each row in turn, and the rows' offsets among them."""
    low = LOWER[data]
    inside = IN_WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(at, starts, "right") - 1
    keys = (row.astype(np.uint64) << U(18)) | (range_hashes(low, starts, ends) >> U(46))
    keys = np.unique(keys)
    row = (keys >> U(18)).astype(np.int64)
    row_at = np.searchsorted(row, np.arange(len(at)))
    return (keys & U(WIDTH - 1)).astype(np.int32), row_at


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def margins(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return added(self.weights[ids], at) + self.bias

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.margins(*features(data, at)) + self.shift)


def added(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each row's values, the same for equal rows wherever they stand."""
    return np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), values, len(at) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Moments:
    """Means of the features and of their products, the constant feature last."""

    n: float
    sums: np.ndarray

    @property
    def second(self) -> np.ndarray:
        return self.sums / max(1.0, self.n)

    @property
    def mean(self) -> np.ndarray:
        return self.sums[-1] / max(1.0, self.n)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums)

    def loss(self, w: np.ndarray, sign: int) -> float:
        """The mean of (1 - sign * margin)^2 / 4."""
        return float(w @ self.second @ w - 2 * sign * (w @ self.mean) + 1) / 4

    def slope(self, w: np.ndarray, sign: int) -> np.ndarray:
        return (self.second @ w - sign * self.mean) / 2


def train(positive: Moments, unlabelled: Moments, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-2) -> np.ndarray:
    """Adam on the non-negative risk with the squared loss; the constant feature's weight does not decay."""
    w = np.zeros(len(positive.mean))
    first, second = np.zeros((2, len(w)))
    shrink = np.full(len(w), decay)
    shrink[-1] = 0
    for step in range(1, steps + 1):
        bracket = unlabelled.loss(w, -1) - prior * positive.loss(w, -1)
        down = unlabelled.slope(w, -1) - prior * positive.slope(w, -1)
        grad = (prior * positive.slope(w, 1) + down if bracket >= 0 else -down) + shrink * w
        first += 0.1 * (grad - first)
        second += 0.001 * (grad**2 - second)
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def chosen_features(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> tuple[np.ndarray, float]:
    """The features used, those furthest above what the unlabelled texts let expect, and the class prior."""
    share_p, share_u = in_p / max(1, n_p), in_u / max(1, n_u)
    able = np.flatnonzero((in_p >= min(MIN_TEXTS, n_p)) & (in_p > 0) & (share_p >= LIFT * share_u))
    expected = share_u[able] * n_p
    best = able[np.argsort(-(in_p[able] - expected) / np.sqrt(expected + 1), kind="stable")[:USED]]
    common = np.flatnonzero((in_p >= COMMON * n_p) & (in_p > 0))
    prior = float(np.min(share_u[common] / share_p[common])) if len(common) else n_p / max(1, n_u)
    return np.sort(best), min(0.5, max(prior, n_p / max(1, n_u), 1e-6))


def threshold(left_out: np.ndarray, edges: np.ndarray, counts: np.ndarray, prior: float) -> float:
    """The margin with the best F1: recall from toxic texts not trained on, what is predicted from the histogram of all."""
    recall = 1 - np.searchsorted(np.sort(left_out), edges) / max(1, len(left_out))
    predicted = np.cumsum(counts[::-1])[::-1] / max(1, counts.sum())
    return float(edges[np.argmax(2 * prior * recall / (predicted + prior))])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def feature_rows(batches: Iterator[pa.RecordBatch], used: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with its rows' features that are in `used`, numbered, and the rows' offsets among them."""
    number = np.full(WIDTH, -1, np.int32)
    number[used] = np.arange(len(used))
    for batch in slices(batches):
        ids, at = features(*text_of(batch.column("text")))
        own = number[ids]
        yield batch, own[own >= 0], np.concatenate([[0], np.cumsum(own >= 0)])[at]


def counted(texts: DataFrame, used: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts each of the features is, and the number of texts. Tasks add up their own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(used), np.int64), 0
        for batch, ids, _ in feature_rows(batches, used):
            total += np.bincount(ids, minlength=len(used))
            n += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["k", "n"])

    rows = texts.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out, k, n = np.zeros(len(used), np.int64), rows["k"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    out[k[k >= 0]] = n[k >= 0]
    return out, int(n[k < 0].sum())


def moments(rows: DataFrame, n_used: int) -> dict[int, Moments]:
    """The moments of the rows (part, ids) of each part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            data, at = text_of(batch.column("ids"))
            ids, row = np.frombuffer(data, "<u2"), np.repeat(np.arange(len(part)), np.diff(at) // 2)
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                for a in range(0, len(mine), 1024):
                    some = mine[a : a + 1024]
                    place = np.full(len(part), -1)
                    place[some] = np.arange(len(some))
                    x = np.zeros((len(some), n_used + 1))
                    x[:, -1] = 1
                    inside = place[row] >= 0
                    x[place[row[inside]], ids[inside]] = 1
                    sums[p] = sums.get(p, 0) + x.T @ x
        for p, total in sums.items():
            i, j = np.nonzero(np.triu(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p, np.int32)), pa.array(i), pa.array(j), pa.array(total[i, j])], ["part", "i", "j", "n"])

    got = rows.mapInArrow(add, "part int, i long, j long, n double").groupBy("part", "i", "j").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for p, own in got.groupby("part"):
        total = np.zeros((n_used + 1, n_used + 1))
        total[own["i"], own["j"]] = total[own["j"], own["i"]] = own["n"]
        out[int(p)] = Moments(total[-1, -1], total)
    return out


def binned(rows: DataFrame, w: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many rows have their margin from each edge to the next; what is below the first counts to the first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges), np.int64)
        for batch in batches:
            z = margins(batch.column("ids"), w)
            total += np.bincount(np.maximum(np.searchsorted(edges, z, "right") - 1, 0), minlength=len(edges))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    got = rows.select("ids").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(edges), np.int64)
    out[got["k"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def margins(column: pa.Array, w: np.ndarray) -> np.ndarray:
    """The margins of rows of packed feature numbers."""
    data, at = text_of(column)
    return added(w[np.frombuffer(data, "<u2")], at // 2) + w[-1]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """The classifier of the rows that are not held out; None without a toxic one among them."""
    toxic = docs_only(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & (F.col("toxic") == 1) & ~held_out()).select("doc_id").distinct()
    texts = docs_only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out())
    chosen = toxic.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(max_labelled)
    marked = texts.join(chosen.withColumn("positive", F.lit(1)), "doc_id", "left")

    every = np.arange(WIDTH)
    in_p, n_p = counted(marked.where("positive = 1"), every)
    if not n_p:
        return None
    candidates = np.flatnonzero(in_p >= min(MIN_TEXTS, n_p))
    in_u, n_u = counted(texts, candidates)
    used, prior = chosen_features(in_p[candidates], n_p, in_u, n_u)
    used = candidates[used]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, at in feature_rows(batches, used):
            packed = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column("part"), packed], ["part", "ids"])

    # Part -1: unlabelled only; others: the toxic texts' parts.
    part = F.when(F.col("positive") == 1, F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(FOLDS))).otherwise(-1).cast("int")
    rows = written(marked.select(part.alias("part"), "text").mapInArrow(narrow, "part int, ids binary"))
    of = moments(rows, len(used))
    unlabelled = Moments(sum(m.n for m in of.values()), sum(m.sums for m in of.values()))
    positive = Moments(n_p, sum(m.sums for p, m in of.items() if p >= 0))
    w = train(positive, unlabelled, prior)
    shown = rows.where("part >= 0").toPandas()
    left_out = [margins(pa.array(own["ids"], pa.binary()), train(positive - of[p], unlabelled, prior) if positive.n > of[p].n else w) for p, own in shown.groupby("part")]
    left_out = np.concatenate(left_out)
    edges = np.linspace(left_out.min(), left_out.max() + 1e-9, BINS)
    cut = threshold(left_out, edges, binned(rows, w, edges), prior)
    weights = np.zeros(WIDTH)
    weights[used] = w[:-1]
    spread = np.sqrt(max(1e-12, w @ unlabelled.second @ w - (w @ unlabelled.mean) ** 2))
    return Model(weights, float(w[-1]), 1 / spread, float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut / spread))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = tuned(docs.sparkSession)
    model = fit(docs, labels, **options)
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = sent.value.scores(*text_of(batch.column("text"))) if sent.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs_only(docs, "doc_id", "text").withColumn("held_out", held_out()).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
