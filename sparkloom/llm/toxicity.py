"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is an n-gram of code points inside a lower-cased word with its boundaries marked; its value, in the fit as
in the score, is `value_of` the number of the document's distinct words that hold it. Each feature is multiplied
by the log ratio of its smoothed document frequency in the two classes, and a logistic regression with L2 penalty
is fitted on the scaled features. Most n-grams of a word have no weight, so a worker remembers for a bounded number
of words which of their features have, and a document's counts add these up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import CACHE_ENTRIES, MULT, bounded_batches, mix, slices

#: Bound of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS = 12_000
#: Lengths of the n-grams in code points, boundaries included.
SIZES = (3, 4, 5, 6)
#: Bits of the hashed feature space.
BITS = 22
#: Code points that are worked on at once, so that memory stays bounded for words of any length; longer words aren't remembered.
CHUNK, REMEMBERED = 65_536, 64
_MARK = "\n"  # white space, so no word holds it


@dataclass
class Linear:
    chosen: np.ndarray  # hashed n-grams that have a weight, ascending
    weight: np.ndarray  # of each, the log-count ratio already multiplied in
    bias: float


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def grams_of(words: list[str], bits: int = BITS, sizes=SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and for each the index of its word. A word shorter than n has no n-grams of that length."""
    codes = np.frombuffer((_MARK + _MARK.join(words) + _MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.cumsum(codes == ord(_MARK))
    plus = codes.astype(np.uint64) + np.uint64(1)
    ids, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(sizes) + 1):
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * MULT + plus[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(marks[max(n - 2, 0) : len(codes) - 1] == marks[: len(h)]) if n > 1 else np.arange(len(h))
            ids.append((mix(h[at] + np.uint64(n - 1)) >> np.uint64(64 - bits)).astype(np.int64))
            owners.append(marks[at] - 1)
    return np.concatenate(ids), np.concatenate(owners)


def pieces_of(words: list[str]):
    """(first, part): runs of words of bounded size; a longer word comes in overlapping pieces that hold its n-grams and no others."""
    part, first, size = [], 0, 0
    for k, w in enumerate(words):
        if len(w) > CHUNK:
            if part:
                yield first, part, None
            marked, step = _MARK + w + _MARK, CHUNK
            for at in range(0, len(marked), step):
                yield k, [], marked[at : at + step + max(SIZES) - 1]
            part, first, size = [], k + 1, 0
            continue
        if part and size + len(w) > CHUNK:
            yield first, part, None
            part, first, size = [], k, 0
        part.append(w)
        size += len(w) + 1
    if part:
        yield first, part, None


def grams_of_words(words: list[str]):
    """(ids, owner) of the n-grams of all words, in blocks of bounded size; owner is the index of the word."""
    for first, part, piece in pieces_of(words):
        if piece is None:
            ids, owner = grams_of(part)
            yield ids, owner + first
        else:
            ids = _grams_of_piece(piece)
            yield ids, np.full(len(ids), first)


def _grams_of_piece(piece: str) -> np.ndarray:
    """N-grams of a piece of one word with its marks, those that begin in the first CHUNK code points; the rest is overlap."""
    plus = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h, ids = np.zeros(len(plus), np.uint64), []
    for n in range(1, min(max(SIZES), len(plus)) + 1):
        h = h[: len(plus) - n + 1] * MULT + plus[n - 1 :]
        if n in SIZES:
            ids.append((mix(h[:CHUNK] + np.uint64(n - 1)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate([np.zeros(0, np.int64), *ids])


def doc_grams(text: str | None) -> np.ndarray:
    """A document's distinct hashed n-grams, ascending."""
    found = np.zeros(0, np.int64)
    for ids, _ in grams_of_words(sorted(words_of(text))):
        found = np.union1d(found, ids)
    return found


class WordFeatures(dict):
    """word -> places of its features that have a weight, for a bounded number of short words."""

    def __init__(self, chosen: np.ndarray):
        super().__init__()
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen), dtype=np.int32)

    def known(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, owner) of those with a weight, each place once for an owner, by owner."""
        at = self.place[ids].astype(np.int64)
        found = np.flatnonzero(at >= 0)
        pair = np.unique(owner[found] * len(self.place) + at[found])
        return (pair % len(self.place)).astype(np.int32), pair // len(self.place)

    def learn(self, words) -> None:
        """Remember the words, CACHE_ENTRIES / 2 short ones at most."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_ENTRIES:
            self.clear()
            new = list(words)
        self.update(dict.fromkeys(new, np.zeros(0, np.int32)))
        for ids, owner in grams_of_words(new):
            at, owner = self.known(ids, owner)
            edges = np.flatnonzero(np.diff(owner)) + 1
            for k, found in zip(owner[np.concatenate([[0], edges])].tolist() if len(owner) else [], np.split(at, edges), strict=False):
                self[new[k]] = found

    def of(self, texts: list[str | None]):
        """For each text the places of all its features, ascending, and how many of its distinct words hold each."""
        most = CACHE_ENTRIES // 2
        for at in range(0, len(texts), 32):
            sets = [words_of(t) for t in texts[at : at + 32]]
            short = [[w for w in words if len(w) <= REMEMBERED] for words in sets]
            if sum(map(len, short)) <= most:
                self.learn(set().union(*short))
            for words, own in zip(sets, short, strict=True):
                found = [np.zeros(0, np.int32)]
                for k in range(0, len(own), most):
                    part = own[k : k + most]
                    self.learn(part)
                    found += [self[w] for w in part]
                for word in words if len(own) < len(words) else ():
                    if len(word) > REMEMBERED:
                        found.append(np.unique(np.concatenate([self.known(*block)[0] for block in grams_of_words([word])])))
                yield np.unique(np.concatenate(found), return_counts=True)


def value_of(counts: np.ndarray) -> np.ndarray:
    """1 for one word, growing with the logarithm, so that a very long document's common n-grams don't drown the others."""
    return 1 + np.log(counts)


def fit(rows: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, ratio: np.ndarray, l2: float = 1e-3, steps: int = 200) -> Linear:
    """rows: for each document the places in `chosen` of the features that it has, counts: in how many of its distinct
    words. With one class the score is constant, the smoothed share of ones."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.sum() in (0, len(y)) or not len(chosen):
        return Linear(np.zeros(0, np.int64), np.zeros(0), prior)
    col = np.concatenate(rows)
    doc = np.repeat(np.arange(len(y)), [len(r) for r in rows])
    x = value_of(np.concatenate(counts)) * ratio[col]
    w, b = np.zeros(len(chosen)), prior
    scale = np.bincount(col, x * x, len(chosen)) / len(y)
    gw, gb = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(steps):  # full-batch AdaGrad on the logistic loss
        margin = b + np.bincount(doc, x * w[col], len(y))
        d = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        g = np.bincount(col, x * d[doc], len(chosen)) + l2 * w * np.minimum(scale, 1)
        gw += g * g
        gb += d.sum() ** 2
        w -= 0.2 * g / np.sqrt(gw)
        b -= 0.2 * d.sum() / np.sqrt(gb)
    return Linear(chosen, w * ratio, float(b))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, alpha: float = 0.5, z: float = 4.0, least: int = 3) -> Linear:
    """Fit on at most `sample_rows` labelled documents outside the held-out fold.

    Spark counts in how many documents of each class an n-gram is. Features in fewer than `least` documents, and
    those whose class frequencies differ by at most z standard errors, get weight 0. Only the features that are
    left reach the driver: at most 2^BITS, whatever the input.
    """
    bounded_batches(docs.sparkSession)
    sample = common.shared_table(common.labelled_sample(docs, labels, "toxic", sample_rows).select("doc_id", "label", "text"), "toxicity-sample")

    def count(batches):
        for batch in slices(batches):
            grams = {0: [np.zeros(0, np.int64)], 1: [np.zeros(0, np.int64)]}
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                grams[label].append(doc_grams(text))
            for label, found in grams.items():
                u, n = np.unique(np.concatenate(found), return_counts=True)
                zero = np.zeros(len(u), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n if label else zero), pa.array(zero if label else n)], names=["gram", "pos", "neg"])

    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    p = (F.col("pos") + F.col("neg")) / (n1 + n0)
    error = F.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    table = (
        sample.mapInArrow(count, "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter((F.col("pos") + F.col("neg") >= least) & (F.abs(F.col("pos") / max(n1, 1) - F.col("neg") / max(n0, 1)) > z * error))
        .toArrow().sort_by("gram")
    )
    chosen, pos, neg = (table[c].to_numpy() for c in ("gram", "pos", "neg"))
    ratio = np.log(((pos + alpha) / (n1 + 2 * alpha)) / ((neg + alpha) / (n0 + 2 * alpha)))
    place = docs.sparkSession.sparkContext.broadcast(chosen)

    def select(batches):
        features = WordFeatures(place.value)
        for batch in slices(batches):
            ids, counts = zip(*features.of(batch.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array([n.astype(np.int32) for n in counts], pa.list_(pa.int32()))], names=["doc_id", "label", "ids", "counts"])

    schema = T.StructType(sample.select("doc_id", "label").schema.fields).add("ids", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType()))
    table = sample.mapInArrow(select, schema).toArrow().sort_by("doc_id")
    lists = [[v.values.to_numpy(zero_copy_only=False) for v in table[c]] for c in ("ids", "counts")]
    return fit(*lists, np.array(table["label"].to_pylist(), float), chosen, ratio)


def scorer(model: Linear):
    """A function that scores a list of texts, with a memory of words of its own."""
    features = WordFeatures(model.chosen)

    def score(texts: list[str | None]) -> np.ndarray:
        margin = np.array([model.weight[found] @ value_of(counts) for found, counts in features.of(texts)], float) + model.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    return score


def toxicity(docs: DataFrame, model: Linear, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`.

    A null or empty text has no features and gets the score of the bias alone. A text of any length is scored whole;
    its words are held once, its n-grams only in blocks of bounded size. held_out is null for a null doc_id. Repeated
    rows are scored each; a score equal to the threshold is predicted 1; other columns are ignored whatever their
    names; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")

    def run(batches):
        score_of = scorer(held.value)
        for batch in slices(batches):
            score = score_of(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id"), (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("text")).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: Linear, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all their columns, whose score is below the threshold; scored as `toxicity` does, without a shuffle."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        score_of = scorer(held.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(score_of(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
