"""Rank-file BPE: against the public library, a plain merging loop, and exact round trips."""

from __future__ import annotations

import base64
import codecs
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from bandwright.llm import queries, transducer

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MIXED = ["'s", "'", "'re", "'ll", "r", "e", " ", "  ", "\n", "\t", " ", "　", "a", "é", "漢", "1", "٣", "!", "S",
         "'S", "\x1c", "\x85", "😀", "́", "�"]


@pytest.fixture(scope="module")
def content():
    with open(PATH, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def machine(content):
    return transducer.Transducer(content)


@pytest.fixture(scope="module")
def library(machine):
    return tiktoken.Encoding(
        "own", pat_str=transducer.PATTERN, mergeable_ranks=machine.merges.ranks, special_tokens={})


def encoded(machine, texts):
    ids, numbers = transducer.encode_rows(machine, pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(numbers)])
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_pattern_is_the_public_one():
    assert transducer.PATTERN == public_tokenizers.PATTERN


def test_random_texts(machine, library):
    draw = random.Random(5)
    texts = ["".join(draw.choices(MIXED, k=draw.randint(0, 14))) for _ in range(20_000)]
    assert encoded(machine, texts) == library.encode_ordinary_batch(texts)


def test_code_points_of_every_block(machine, library):
    texts = [f"  {chr(i)}{chr(i)}a1!'s{chr(i)} x" for i in range(0, 0x110000, 37) if not 0xD800 <= i < 0xE000]
    assert encoded(machine, texts) == library.encode_ordinary_batch(texts)


def test_long_pieces_and_cleared_states(content, library, monkeypatch):
    monkeypatch.setattr(transducer, "MOST_STATES", 50)
    small = transducer.Transducer(content)
    draw = random.Random(6)
    texts = ["x" * 3_000, "ab" * 2_000, "".join(draw.choices("etaoin", k=5_000)), "漢字" * 900, "", " " * 4_000, "\n" * 2_000]
    want = library.encode_ordinary_batch(texts)
    assert encoded(small, texts) == want and encoded(small, texts[::-1]) == want[::-1]


def ranks_of(tokens):
    lines = [base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)]
    return b"\n".join(lines)


def plain_merge(ranks, piece):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(25))
def test_any_vocabulary(seed):
    """Vocabularies of random strings: tokens that merging never gives, and merges out of order."""
    draw = random.Random(seed)
    longer = {bytes(draw.choices(b"abc", k=draw.randint(2, 6))) for _ in range(25)}
    tokens = [bytes([i]) for i in range(256)] + draw.sample(sorted(longer), len(longer))
    machine = transducer.Transducer(ranks_of(tokens))
    pieces = ["".join(draw.choices("abc", k=draw.randint(1, 30))) for _ in range(400)]
    assert encoded(machine, pieces) == [plain_merge(machine.merges.ranks, p.encode()) for p in pieces]


def test_tokens_leave_before_the_end(machine, library):
    """A stream holds back less than the longest token's worth of bytes."""
    piece = "".join(random.Random(7).choices("abcdefgh", k=2_000)).encode()
    stream, said, waited = transducer.Stream(machine), [], 0
    for byte in piece:
        said += stream.push(bytes([byte]))
        waited = max(waited, stream.pending())
    assert said + stream.close() == library.encode_ordinary(piece.decode()) and waited <= 8


def test_unspellable_bytes_raise():
    machine = transducer.Transducer(ranks_of([b"a", b"b", b"ab"]))
    assert encoded(machine, ["abba"]) == [[2, 1, 0]]
    with pytest.raises(ValueError):
        encoded(machine, ["abc"])


def test_utf8_machine_equals_one_decoding():
    draw = random.Random(8)
    for _ in range(3_000):
        data = bytes(draw.choices([0x41, 0x80, 0xA0, 0xBF, 0xC1, 0xC3, 0xE0, 0xE2, 0xED, 0xF0, 0xF3, 0xF4, 0xFF], k=12))
        machine, text = transducer.Utf8Stream(), ""
        for i in range(0, 12, 3):
            text += machine.push(data[i:i + 3])
            assert len(machine.held) <= 3
        assert text + machine.close() == data.decode("utf-8", "replace")


def test_characters_leave_when_whole():
    machine, codec = transducer.Utf8Stream(), codecs.getincrementaldecoder("utf-8")()
    for byte in "aé漢😀\n".encode():
        assert machine.push(bytes([byte])) == codec.decode(bytes([byte]))


def test_round_trip_of_edge_rows(spark, documents, library):
    clashing = documents.select("*", F.lit(1).alias("ids"), F.lit(2).alias("raw"))
    both = transducer.decode(transducer.encode(clashing, PATH, decoded="raw"), PATH)
    rows = both.collect()
    assert len(rows) == documents.count()
    for row in rows:
        text = row.text or ""
        assert row.ids == library.encode_ordinary(text) and row.decoded == text and bytes(row.raw).decode() == text
    assert transducer.encode(documents.limit(0), PATH).count() == 0
    lists = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in transducer.decode(lists, PATH).collect()] == [None, ""]


def test_query_against_the_library(spark, folder, library):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_transducer(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
