"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker-local cache holds before it starts anew.
CACHE_ENTRIES = 300_000
#: Rows of one Arrow slice that a Python function works on at a time.
SLICE_ROWS = 256

MULT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (murmur3's constants)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; a shorter text is one run, no words are none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(k, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * MULT + mix(word_hashes[i : n - width + 1 + i] + np.uint64(i + 1))
    return mix(out + np.uint64(width))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches cut to at most `rows` rows, so that decoded texts stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 is the held-out fold. A null id is in no fold (null)."""
    return F.crc32(doc_id.cast("string")) % 5


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set on one machine (tests).

    On a cluster without that setting it raises: executors don't see a folder of one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(path or os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))
    return path or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def write_shared(df: DataFrame, name: str) -> str:
    """Write a table to the shared checkpoint folder; returns its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a table of `write_shared` that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing a table to the shared checkpoint folder and reading it back."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """A bounded sample of labelled documents outside the held-out fold: (doc_id, label, text), one row for each doc_id.

    At most `limit` labels are taken in the order of a hash of doc_id, so the choice depends on neither the
    partitioning nor the order of rows; only this bounded table is broadcast. Of the rows that repeat a doc_id
    the least text is taken, of its labels the greatest, so the sample is bounded however often an id is repeated.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & (fold_of(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))


#: Names of the statistics that `statistics` returns, in order.
STATS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio",
    "bang_ratio", "pipe_ratio", "mean_word", "distinct_ratio", "run_ratio", "log_words", "lines_per_word",
]

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_PUNCT = np.array([b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)])


def statistics(text: bytes | None, hashes: WordHashes, window: int = 5) -> list[float]:
    """Statistics of one whole text (null: no words). Words are runs of anything but \\x20 and \\x09-\\x0D."""
    text = text or b""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(counts[128:192].sum())
    word_chars = points - int(counts[_SPACES].sum())
    n_symbols = int(counts[_SYMBOLS].sum())
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    h = hashes.array(words)
    n_repeat = distinct = runs = 0
    if n:
        _, first = np.unique(h, return_index=True)
        distinct = len(first)
        runs = int((h[1:] == h[:-1]).sum())
    if n > window:
        grams = window_hashes(h, window)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        again = np.zeros(len(grams), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if again.any():
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            n_repeat = int((np.cumsum(edge)[:n] > 0).sum())
    c, w = max(word_chars, 1), max(n, 1)
    return [
        n, word_chars, n_symbols, n_dup, n_repeat,
        n_symbols / c, n_dup / max(n_lines, 1), n_repeat / w, int(counts[65:91].sum()) / c, int(counts[48:58].sum()) / c, int(counts[_PUNCT].sum()) / c,
        int(counts[33]) / w, int(counts[124]) / w, word_chars / w, distinct / w, runs / w, float(np.log1p(n)), n_lines / w,
    ]


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches hold at most `rows` rows, so that whole long texts fit a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
