"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown on the driver from the statistics of a bounded sample of labelled documents and
flattened into numpy node arrays, so a block of documents is scored with `depth` gathers a tree.
Chosen features are monotonic: more of them never raises the score.
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

#: Direction in which the score may move with a feature.
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "bang_ratio": -1, "pipe_ratio": -1, "run_ratio": -1, "upper_ratio": -1}
#: Bound of the labelled sample that the trees are fitted on.
SAMPLE_ROWS = 20_000


@dataclass
class Trees:
    """All trees in one set of node arrays. A leaf points to itself, so a walk may go on past it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 64, l2: float = 1.0, least: int = 10) -> Trees:
    """Boost regression trees on the logistic loss. With no rows or one class the score is the share of ones (0.5 without rows)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        raw = np.full(len(y), base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            roots.append(_grow(nodes, binned, edges, g, h, np.arange(len(y)), raw, monotone, depth, -np.inf, np.inf, rate, l2, least))
    a = np.array(nodes, float).reshape(-1, 5)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), depth, base)


def _grow(nodes, binned, edges, g, h, rows, raw, monotone, depth, low, high, rate, l2, least) -> int:
    at = len(nodes)
    weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
    nodes.append([0, np.inf, at, at, rate * weight])
    best = None
    if depth and len(rows) >= 2 * least:
        sg, sh = g[rows].sum(), h[rows].sum()
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=len(edge) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(sg - gl) / (sh - hl + l2), low, high)
            gain = gl**2 / (hl + l2) + (sg - gl) ** 2 / (sh - hl + l2) - sg**2 / (sh + l2)
            gain[(nl < least) | (len(rows) - nl < least) | (monotone[f] * (wr - wl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, wl[k], wr[k])
    if best is None:
        raw[rows] += rate * weight
        return at
    _, f, k, wl, wr = best
    go = binned[rows, f] <= k
    mid = (wl + wr) / 2
    bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[f])]
    left = _grow(nodes, binned, edges, g, h, rows[go], raw, monotone, depth - 1, *bounds[0], rate, l2, least)
    right = _grow(nodes, binned, edges, g, h, rows[~go], raw, monotone, depth - 1, *bounds[1], rate, l2, least)
    nodes[at] = [f, edges[f][k], left, right, 0.0]
    return at


def document_statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns of `carry` and an array of the statistics named by STATS, for every whole text."""
    schema = T.StructType([*docs.select(*carry).schema, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            stats = [statistics(t, hashes) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carry))] + [pa.array(stats, pa.list_(pa.float64()))], names=[*carry, "stats"])

    return docs.select(*carry, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit the trees on the statistics of at most `sample_rows` labelled documents outside the held-out fold, in the order of doc_id."""
    table = document_statistics(common.labelled_sample(docs, labels, "quality", sample_rows), "doc_id", "label").toArrow().sort_by("doc_id")
    x = np.array(table["stats"].to_pylist(), float).reshape(-1, len(STATS))
    monotone = np.array([MONOTONE.get(n, 0) for n in STATS])
    return fit(x, np.array(table["label"].to_pylist(), float), monotone)


def quality_rules(docs: DataFrame, trees: Trees, threshold: float = 0.3, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Statistics, base rule and verdict of each row of `docs`: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null or empty text has no words, so the base rule fails. A text of any length is judged whole, by counts
    that take memory in proportion to it. Repeated rows are judged each; a score equal to the threshold is kept;
    columns other than doc_id and text are ignored whatever their names; an empty table gives no rows.
    """
    common.bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)
    schema = docs.select("doc_id").schema
    for name in STATS[:5]:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("score", "double")

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            x = np.array([statistics(t, hashes) for t in texts_of(batch)], float)
            counts = x[:, :5].astype(np.int64)
            failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=["doc_id", *STATS[:5], "base_failed", "kept", "score"],
            )

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, schema)
