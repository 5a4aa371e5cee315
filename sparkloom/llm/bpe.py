"""BPE encoding and decoding with public vocabularies, exact for whole texts of any length.

A text is cut only where no token can cross: before a space or line feed that follows a character that is
not white space. Short chunks are encoded by the tokenizers library once and remembered. Long chunks are
split by the tokenizer's own pre-tokenizer, and a long piece that it leaves unsplit is encoded by tree
concatenation: blocks of it are encoded in parallel, neighbours are joined pairwise, and around each join a
growing window is encoded anew until its first and last token agree with what stands there. Every pair of
neighbouring tokens is then one that the merges leave alone, so the result is that of the whole piece.
"""

from __future__ import annotations

import os
import re
import struct
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_ENTRIES, bounded_batches, slices

# the library's own pool would take all cores of a machine for every small batch; long pieces go to the pool below
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of a chunk that is remembered, and of a block of tree concatenation.
SHORT, BLOCK = 64, 512
#: Threads that encode a long piece, and parts below which one does.
THREADS, FEW = 4, 16

#: Letters that are their own normal form, and marks that begin neither a contraction nor a special token.
LETTERS, MARKS = r"[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]"

_CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def byte_level_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte, inverted: printable Latin-1 bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def _threads() -> ThreadPoolExecutor:
    return ThreadPoolExecutor(THREADS)


def _in_parallel(run, items: list) -> list:
    """run on every item, in order; many items are dealt to threads in runs, as the library lets go of Python's lock while it encodes."""
    if len(items) < FEW:
        return [run(x) for x in items]
    size = -(-len(items) // THREADS)
    parts = [items[at : at + size] for at in range(0, len(items), size)]
    return [x for part in _threads().map(lambda own: [run(x) for x in own], parts) for x in part]


def tree_concat(piece: str, encode_all, token_length, block: int = BLOCK) -> list[int]:
    """Ids of an unsplit piece. encode_all: encodes a list of strings; token_length: characters of an id's token.

    The leaves of the tree, and the joins of a level, are encoded in parallel.
    """
    leaves = [piece[at : at + block] for at in range(0, len(piece), block)]
    runs = _in_parallel(encode_all, [leaves[at : at + 8] for at in range(0, len(leaves), 8)])
    parts = list(zip([ids for run in runs for ids in run], leaves, strict=True))
    while len(parts) > 1:
        pairs = list(zip(parts[::2], parts[1::2], strict=False))
        joined = _in_parallel(lambda pair: _join(*pair, encode_all, token_length), pairs)
        parts = joined + parts[len(parts) - len(parts) % 2 :]
    return parts[0][0] if parts else []


def _join(left, right, encode_all, token_length):
    (a, s), (b, t) = left, right
    k = 4
    while True:
        head, tail = a[-k:], b[:k]
        width = sum(map(token_length, head)), sum(map(token_length, tail))
        window = encode_all([s[len(s) - width[0] :] + t[: width[1]]])[0]
        if (k >= len(a) or window[0] == head[0]) and (k >= len(b) or window[-1] == tail[-1]):
            return a[: max(len(a) - k, 0)] + window + b[k:], s + t
        k *= 2


class Encoder(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers, remembered for a bounded number of short chunks."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare = Tokenizer(self.tokenizer.model)  # the merges alone
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.lengths: dict[int, int] = {}
        self.older: dict[str, bytes] = {}  # what was remembered before the last time the memory was full
        self.printable = {b: c for c, b in byte_level_alphabet().items()}

    def token_length(self, i: int) -> int:
        if i not in self.lengths:
            self.lengths[i] = len(self.tokenizer.id_to_token(i))
        return self.lengths[i]

    def encode_all(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch(pieces, add_special_tokens=False)]

    def long(self, chunk: str) -> list[int]:
        """A chunk of any length: special tokens, then the tokenizer's own normaliser and pieces."""
        out: list[int] = []
        at = 0
        for m in [*self.cut.finditer(chunk), None]:
            part = chunk[at : m.start() if m else len(chunk)]
            if self.tokenizer.normalizer is not None:
                part = self.tokenizer.normalizer.normalize_str(part)
            if part:
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    # a suffix that marks word ends belongs to the last character, so only plain merges are joined in a tree
                    if len(piece) > BLOCK and not getattr(self.tokenizer.model, "end_of_word_suffix", None):
                        out += tree_concat(piece, self.encode_all, self.token_length)
                    else:
                        out += self.encode_all([piece])[0]
            if m:
                out.append(self.special[m[0]])
                at = m.end()
        return out

    def __missing__(self, chunk: str) -> bytes:
        packed = self.older.get(chunk)
        if packed is None:
            plain = len(chunk) <= SHORT and self.plain.fullmatch(chunk)
            if plain and plain[2]:
                packed = self[plain[1]] + self[plain[2]]  # letters and the marks after them are pieces of their own
            elif plain:
                packed = pack([t.id for t in self.bare.model.tokenize(self.piece(chunk))])
            else:
                packed = pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids if len(chunk) <= SHORT else self.long(chunk))
        if len(chunk) <= SHORT:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[chunk] = packed
        return packed

    #: Chunks whose pieces need no pattern: letters that are their own normal form, then marks.
    plain = re.compile(rf"( ?{LETTERS}+)({MARKS}*)")

    def piece(self, chunk: str) -> str:
        return chunk if chunk.isascii() and chunk[0] != " " else "".join(map(self.printable.__getitem__, chunk.encode()))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


class WordEncoder(Encoder):
    """For vocabularies whose normaliser drops white space: chunks are what stands between spaces and line feeds."""

    plain = re.compile(rf"({LETTERS}+)({MARKS}*)")

    def piece(self, chunk: str) -> str:
        return super().piece(chunk.lower())

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class Decoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        alphabet = byte_level_alphabet()
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        size = max(tokenizer.get_vocab().values()) + 1
        self.table = [b""] * size
        for token, i in tokenizer.get_vocab().items():
            plain = token in special or any(c not in alphabet for c in token)
            self.table[i] = token.encode() if plain else bytes(map(alphabet.__getitem__, token))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, words: bool = False) -> Encoder:
    return (WordEncoder if words else Encoder)(path)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids) of each row: ids are little-endian unsigned 32-bit integers in one binary.

    A null text counts as empty; an empty text has no ids. A text of any length is encoded whole, exactly as the
    library does. Repeated rows are encoded each; other columns are ignored whatever their names; an empty table
    gives no rows.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.select("doc_id").schema, T.StructField("ids", T.BinaryType())])

    def run(batches):
        e = encoder(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.encode(t or "") for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row of what `encode` returns."""
    bounded_batches(encoded.sparkSession)
    schema = T.StructType([*encoded.select("doc_id", "ids").schema, T.StructField("decoded", T.StringType())])

    def run(batches):
        d = decoder(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
