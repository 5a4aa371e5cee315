import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, packing

BYTE, WORD = bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("word_bpe_49k.json")
LIB = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
PARTS = ["a", "th", "ing", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "é", "é", "̸", "Σ", "ß", "İ", "1", "'s", "'LL", "!!", "%", "<|endoftext|>", "😀", "​", "中文", "ﬁ", "\x00"]


def library(path, text):
    return np.array(LIB[path].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_encoding_is_the_library_s(text):
    assert bpe.encoder(BYTE).encode(text) == library(BYTE, text)
    assert bpe.encoder(WORD, True).encode(text) == library(WORD, text)
    assert bpe.decoder(BYTE).decode(library(BYTE, text)) == LIB[BYTE].decode(LIB[BYTE].encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    ids = bpe.encoder(BYTE).encode(text)
    assert ids == library(BYTE, text)
    assert bpe.decoder(BYTE).decode(ids) == text


@pytest.mark.parametrize("seed", range(6))
def test_tree_concatenation_of_long_unsplit_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "the", "ing", "zx", "é", "q"][: 2 + seed % 5]) for _ in range(3000))
    assert bpe.encoder(BYTE).encode("x " + text) == library(BYTE, "x " + text)
    e = bpe.encoder(BYTE)
    piece = "".join(e.printable[b] for b in text.encode())
    for block in (3, 17, 400):
        assert bpe.tree_concat(piece, e.encode_all, e.token_length, block) == e.encode_all([piece])[0]


def test_very_long_unsplit_text_is_encoded_in_parallel():
    import threading

    rng = random.Random(9)
    text = "".join(rng.choice(["a", "the", "ing", "zx", "q", "e"]) for _ in range(60_000))
    e, seen = bpe.Encoder(BYTE), set()
    plain = e.encode_all
    e.encode_all = lambda pieces: (seen.add(threading.current_thread().name), plain(pieces))[1]
    assert e.encode(text) == library(BYTE, text) and len(seen) > 1
    assert bpe.WordEncoder(WORD).encode("b" * 20_000 + " x") == library(WORD, "b" * 20_000 + " x")


def test_fill_is_closest_to_capacity():
    rng = random.Random(4)
    for _ in range(60):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        cap = rng.randint(1, 80)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        chosen = packing.fill({x: items.count(x) for x in items}, cap)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= cap)
        assert all(n <= items.count(k) for k, n in chosen.items())


def check_sequences(sequences, docs, capacity):
    found = {}
    for row in sequences:
        size = sum(len(p[2]) // 4 for p in row)
        assert 0 < size <= capacity
        for doc, start, ids, n in row:
            found.setdefault(doc, []).append((start, ids, n))
    assert set(found) == set(docs)
    for doc, ids in docs.items():
        pieces = sorted(found[doc])
        assert b"".join(p[1] for p in pieces) == ids and all(p[2] == len(ids) // 4 for p in pieces)
        assert [p[0] for p in pieces] == list(np.cumsum([0] + [len(p[1]) // 4 for p in pieces[:-1]]))


def test_packing_loses_nothing_and_pads_nothing():
    rng = np.random.default_rng(6)
    docs = {i: rng.integers(0, 9, rng.integers(1, 400)).astype("<u4").tobytes() for i in range(500)}
    sequences = list(packing.pack_stream(iter(docs.items()), 128, 64))
    check_sequences(sequences, docs, 128)
    sizes = [sum(len(p[2]) // 4 for p in row) for row in sequences]
    assert all(s == 128 or s & (s - 1) == 0 for s in sizes)


def test_packing_table(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (None, ""), (2, "again"), (3, "long " * 6000)], "doc_id long, text string").withColumnRenamed("text", "text")
    out = packing.packing(docs.coalesce(1), WORD).collect()
    assert sum(r.length for r in out) == sum(len(library(WORD, t or "")) // 4 + 1 for t in ("hello world", None, "", "again", "long " * 6000))
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packing(docs.limit(0), WORD).count() == 0


def test_encode_decode_tables(spark):
    docs = spark.createDataFrame([(1, "Hello, world's"), (2, None), (2, ""), (None, "x" * 4000)], "doc_id long, text string")
    out = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert sorted(r.decoded for r in out) == sorted(["Hello, world's", "", "", "x" * 4000])
    assert bpe.decode(bpe.encode(docs.limit(0), BYTE), BYTE).count() == 0
