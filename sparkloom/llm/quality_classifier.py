"""Quality classifier: a factorisation machine.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise part is computed in
linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Inputs are hashed words, structure
statistics of the whole text and its metadata (length); labels, language, source and doc_id are not inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import STATS, WordHashes, slices, statistics, texts_of

#: Bound of the labelled sample that the machine is fitted on.
SAMPLE_ROWS = 12_000
#: Buckets of hashed words; the statistics follow them in the feature space.
WORD_BUCKETS = 1 << 16
RANK = 8
#: The statistics that are inputs: ratios and logarithms, no raw counts.
INPUTS = [i for i, n in enumerate(STATS) if n.endswith("_ratio") or n in ("mean_word", "log_words", "lines_per_word")]


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def features(self, ids, values, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return rows_of(ids, values, np.clip((stats - self.mean) / self.scale, -4, 4))

    def raw(self, idx: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Margins of documents whose features lie at idx[start[k]:start[k+1]], by the sum-of-squares identity."""
        vx = self.v[idx] * x[:, None]
        total = np.add.reduceat(vx, start, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), start)
        return self.bias + np.add.reduceat(self.w[idx] * x, start) + 0.5 * ((total * total).sum(1) - squares)


def words_to_features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values (logarithmic counts, of Euclidean length 1) of hashed words."""
    ids, n = np.unique((words >> np.uint64(64 - 16)).astype(np.int64), return_counts=True)
    x = 1 + np.log(n)
    return ids, x / max(float(np.sqrt((x * x).sum())), 1e-9)


def inputs_of(text: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, x = words_to_features(hashes.array((text or b"").split()))
    stats, points = statistics(text, hashes), len((text or b"").decode("utf-8", "replace"))
    return ids, x, np.array([stats[i] for i in INPUTS] + [np.log1p(points)])


def rows_of(ids, values, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One flat feature list of many documents, and where each begins."""
    own = WORD_BUCKETS + np.arange(stats.shape[1])
    idx = np.concatenate([np.concatenate([i, own]) for i in ids])
    x = np.concatenate([np.concatenate([v, s]) for v, s in zip(values, stats, strict=True)])
    sizes = np.array([len(i) + len(own) for i in ids])
    return idx, x, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def fit(ids, values, stats: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, l2: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss. With no rows or one class the score is the smoothed share of ones."""
    size = WORD_BUCKETS + stats.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(seed)
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if len(y) else (np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, RANK)), mean, scale)
    if not len(y) or y.sum() in (0, len(y)):
        return m
    m.v = rng.normal(0, 0.01, (size, RANK))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            part = order[at : at + batch]
            idx, x, start = m.features([ids[i] for i in part], [values[i] for i in part], stats[part])
            d = (1 / (1 + np.exp(-np.clip(m.raw(idx, x, start), -30, 30))) - y[part]) / len(part)
            of = np.repeat(np.arange(len(part)), np.diff(np.append(start, len(idx))))
            total = np.add.reduceat(m.v[idx] * x[:, None], start, axis=0)
            u, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, d[of] * x) + l2 * m.w[u]
            step = (d[of] * x)[:, None] * (total[of] - m.v[idx] * x[:, None])
            dv = np.stack([np.bincount(inverse, step[:, f]) for f in range(RANK)], 1) + l2 * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            gb += d.sum() ** 2
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            m.v[u] -= rate * dv / np.sqrt(gv[u])
            m.bias -= rate * d.sum() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most `sample_rows` labelled documents outside the held-out fold, in the order of doc_id. Only features reach the driver."""

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            ids, values, stats = zip(*(inputs_of(t, hashes) for t in texts_of(batch)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for v in values], pa.list_(pa.float32())), pa.array(list(stats), pa.list_(pa.float64()))],
                names=["doc_id", "label", "ids", "x", "stats"],
            )

    sample = common.labelled_sample(docs, labels, "quality", sample_rows)
    schema = T.StructType(sample.select("doc_id", "label").schema.fields).add("ids", T.ArrayType(T.IntegerType())).add("x", T.ArrayType(T.FloatType())).add("stats", T.ArrayType(T.DoubleType()))
    table = sample.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    ids, values = ([v.values.to_numpy(zero_copy_only=False) for v in table[c]] for c in ("ids", "x"))
    stats = np.array(table["stats"].to_pylist(), float).reshape(-1, len(INPUTS) + 1)
    return fit(ids, values, stats, np.array(table["label"].to_pylist(), float))


def scorer(machine: Machine):
    """A function that scores a list of texts in UTF-8."""
    hashes = WordHashes()

    def score(texts: list[bytes | None]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 64):
            ids, values, stats = zip(*(inputs_of(t, hashes) for t in texts[at : at + 64]), strict=True)
            out.append(machine.raw(*machine.features(ids, values, np.array(stats))))
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *out]), -30, 30)))

    return score


def quality_classifier(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`.

    A null or empty text is scored by its statistics, all zero. A text of any length is scored whole, in memory in
    proportion to it. held_out is null for a null doc_id. Repeated rows are scored each; a score equal to the
    threshold is predicted 1; other columns are ignored whatever their names; an empty table gives no rows.
    """
    common.bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")

    def run(batches):
        score_of = scorer(held.value)
        for batch in slices(batches):
            score = score_of(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id"), (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("text")).mapInArrow(run, schema)


def reject_low_quality(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all their columns, whose score reaches the threshold; scored as `quality_classifier` does, without a shuffle."""
    common.bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        score_of = scorer(held.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(score_of(texts_of(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
