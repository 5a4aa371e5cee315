"""Packing by minimum bin slack.

Each partition streams its documents: whole windows of 4096 ids of a long document are sequences of their
own, what remains of each document joins a bounded pool. When the pool is full, sequences are filled one by
one: the longest remaining length is placed, and a subset-sum dynamic programme over a bitset picks the
multiset of remaining lengths that fills the rest closest to capacity; the counts are read back from the
bitsets of its steps. What lies in sequences that are not full is cut to make full ones, and what is left
of it when the partition ends is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import bounded_batches, slices

CAPACITY = 4096
#: Remainders that wait in a partition's pool at most.
POOL = 2048

Piece = tuple[object, int, bytes, int]  # doc_id, start, ids, ids of the whole document


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to capacity as it can be, never above."""
    reach, steps, full = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & full
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return dict(chosen)


class Pool:
    """Remainders by length, and the sequences made of them."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.size = capacity, defaultdict(list), 0

    def add(self, piece: Piece) -> None:
        self.items[len(piece[2]) // 4].append(piece)
        self.size += 1

    def _pop(self, length: int) -> Piece:
        piece = self.items[length].pop()
        if not self.items[length]:
            del self.items[length]
        self.size -= 1
        return piece

    def sequence(self) -> list[Piece]:
        largest = max(self.items)
        out = [self._pop(largest)]
        rest = fill({k: len(v) for k, v in self.items.items() if k <= self.capacity - largest}, self.capacity - largest) if largest < self.capacity else {}
        for length, n in sorted(rest.items(), reverse=True):
            out += [self._pop(length) for _ in range(n)]
        return out


def binary_cut(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Sequences of exactly capacity or a power of two ids that hold the pieces in order, cut where needed."""
    total = sum(len(p[2]) // 4 for p in pieces)
    sizes = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> k & 1]
    out, queue = [], list(reversed(pieces))
    for size in sizes:
        row: list[Piece] = []
        while size:
            doc, start, ids, n = queue.pop()
            take = min(size, len(ids) // 4)
            row.append((doc, start, ids[: 4 * take], n))
            if take < len(ids) // 4:
                queue.append((doc, start + take, ids[4 * take :], n))
            size -= take
        out.append(row)
    return out


def pack_stream(documents, capacity: int = CAPACITY, pool_size: int = POOL):
    """documents: (doc_id, ids as bytes). Yields sequences: lists of pieces."""
    pool, loose = Pool(capacity), []

    def drain(least: int):
        """Fill sequences until the pool is down to `least`; what lies in those that aren't full waits, fewer than two sequences of it, to be cut."""
        while pool.size > least:
            row = pool.sequence()
            if sum(len(p[2]) for p in row) == 4 * capacity:
                yield row
                continue
            loose.extend(row)
            if sum(len(p[2]) for p in loose) >= 4 * capacity:
                full, *rest = binary_cut(loose, capacity)
                loose[:] = [p for r in rest for p in r]
                yield full

    for doc, ids in documents:
        n = len(ids) // 4
        whole = n - n % capacity
        for at in range(0, whole, capacity):
            yield [(doc, at, ids[4 * at : 4 * (at + capacity)], n)]
        if whole < n:
            pool.add((doc, whole, ids[4 * whole :], n))
        if pool.size >= pool_size:
            yield from drain(pool_size // 2)
    yield from drain(0)
    yield from binary_cut(loose, capacity)


def packing(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each. Sequence ids are unique over the
    table: the partition's number in the high bits, a count in the low ones; a task that runs again makes the
    same sequences. Other columns are ignored whatever their names; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([*docs.select("doc_id").schema, *(T.StructField(n, T.LongType()) for n in names[1:])])

    def run(batches):
        e = bpe.encoder(path, True)
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        kind = []

        def documents():
            for batch in slices(batches):
                kind[:] = [batch.column(0).type]
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield doc, e.encode(text or "") + end

        def flush(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        rows = []
        for k, sequence in enumerate(pack_stream(documents(), capacity)):
            offset = 0
            for doc, start, ids, n in sequence:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, first + k, offset))
                offset += len(ids) // 4
            if len(rows) >= 4096:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
