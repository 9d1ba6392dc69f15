from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bandwright.llm import bpe, toxicity
from bandwright.llm.queries import op9_toxicity, vocabulary_path
from bandwright.llm.words import plain

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe._content(vocabulary_path())))


def test_every_token_and_random_texts(library, encoder):
    for token, i in list(encoder.vocabulary.ids.items())[::7]:
        assert encoder.piece(token.decode("latin-1")) == [i]
    rng = random.Random(1)
    pieces = [
        "a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u180e", "\u200b", "\u2028", "\u3000", "é", "漢字", "😀",
        "'s", "'re", "'", "1", "23", "½", "!", "<|endoftext|>", "<|", "\x00", "\ufeff", "AB", "ing", "\r\n", "__", "²", "a\u0301",
    ]
    decoder = bpe.Decoder(encoder.vocabulary)
    for _ in range(4_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == want
        assert decoder.decode(np.array(want)) == library.decode(want, skip_special_tokens=False) == text
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(1, 8))]
        assert decoder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_long_pieces_and_full_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    encoder = bpe.Encoder(bpe.Vocabulary(bpe._content(vocabulary_path())))
    rng = random.Random(2)
    for alphabet in ("abcdefgh", "ab", "é漢"):
        text = "".join(rng.choice(alphabet) for _ in range(3_000))
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_frames(spark, documents, library):
    both = bpe.decode(bpe.encode(documents.withColumns({"ids": F.lit(0), "decoded": F.lit(1)}), vocabulary_path()), vocabulary_path())
    got = both.collect()
    assert len(got) == documents.count() and both.columns == ["doc_id", "text", "ids", "decoded"]
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    once = bpe.encode(documents, vocabulary_path(), decoded="decoded")
    assert sorted(once.collect(), key=str) == sorted(got, key=str)
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert sorted(bpe.decode(nulls, vocabulary_path()).select("decoded").collect(), key=str) == sorted([(None,), ("",)], key=str)
    assert bpe.encode(documents.limit(0), vocabulary_path()).collect() == []
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([99_999],)], "ids array<int>"), vocabulary_path()).collect()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op9_toxicity(spark, folder).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.toxic == y] for y in (0, 1))
    auc = np.mean([np.mean(np.array(good) < b) + 0.5 * np.mean(np.array(good) == b) for b in bad])
    assert auc > 0.96
    assert np.mean([r.predicted for r in held if r.toxic == 0]) < 0.005
    assert np.mean([r.predicted for r in held if r.toxic == 1]) > 0.8


def test_fit_ignores_held_out_rows_and_layout(spark):
    rows = [(i, f"w{i % 37} " + ("awful thing" if i % 3 == 0 else "fine day"), int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    held = toxicity.fold("doc_id") == 0
    first = toxicity.train(docs, labels)
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    second = toxicity.train(docs.repartition(7), flipped.repartition(3))
    assert first.intercept == second.intercept and np.array_equal(first.places, second.places)
    assert np.array_equal(first.values, second.values)
    assert 0 < len(first.places) < 200
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 3 for r in kept.collect()} == {1, 2}


def test_edge_rows(spark, documents):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    weights = toxicity.train(documents, labels)
    extra = documents.withColumns({"score": F.lit("mine"), "_key": F.lit(1)})
    got = toxicity.score(extra, weights).collect()
    assert len(got) == documents.count() and all(r.score == pytest.approx(0.25) and r.predicted == 0 for r in got)
    assert toxicity.clean(extra, labels).columns == extra.columns
    assert toxicity.score(documents.limit(0), weights).collect() == []
    fitted = toxicity.fit(plain(pa.array(["a b", "c d"] * 40)), [1, 0] * 40)
    scores = toxicity.scores(plain(pa.array(["a b", "c d", "", None])), fitted)
    assert scores[0] > 0.5 > scores[1] and scores[2] == scores[3]


def test_repeated_ids_keep_the_bound(spark, monkeypatch):
    """A hot id in both tables doesn't multiply into the fit."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 200)
    docs = spark.range(3_000).selectExpr(
        "if(id % 3 = 0, 7, id) AS doc_id", "concat('text ', id, if(id % 2 = 0, ' vile', ' kind')) AS text")
    labels = spark.range(3_000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "cast(id % 2 = 0 AS int) AS toxic")
    seen, fit = [], toxicity._row_bound
    monkeypatch.setattr(toxicity, "_row_bound", lambda rows: seen.append(fit(rows)) or seen[-1])
    weights = toxicity.train(docs, labels)
    assert seen[0].count() <= 300 and len(weights.places) >= 0
    same = spark.range(2_000).selectExpr("1 AS _key", "'one text' AS _text", "1 AS _label")
    assert fit(same).count() <= 1
