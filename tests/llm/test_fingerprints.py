from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_jaccard import shingles

from bandwright.llm import fingerprints
from bandwright.llm.words import plain


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_estimates_similarity_at_all_sizes():
    rng = random.Random(1)
    errors = []
    for n in [5, 6, 8, 20, 100, 600] * 20:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        cut = rng.randrange(n + 1)
        other = base[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(n - cut)]
        texts = [" ".join(base), " ".join(other)]
        x, y = fingerprints.pack(fingerprints.bins_of(plain(pa.array(texts))))
        errors.append(fingerprints.likeness(x, y) - jaccard(*map(shingles, texts)))
    assert np.abs(errors).max() < 0.13 and abs(np.mean(errors)) < 0.01


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edited_texts_and_order(spark, parts):
    rng = random.Random(parts)
    docs = [(k, "".join(rng.choice("ab é😀\n") for _ in range(rng.randrange(60)))) for k in rng.sample(range(-500, 500), 80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.with_next(df, parts=parts).collect()}
    docs.sort()
    assert len(got) == len(docs)
    for i, (k, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        want = text[: len(text) - cut] + following[:cut]
        row = got[k]
        assert (row.n_chars, row.edited_text) == (len(text), want)
        one, two, three = fingerprints.pack(fingerprints.bins_of(plain(pa.array([text, want, following]))))
        assert (row.fingerprint, row.edited_fingerprint) == (one, two)
        assert row.near_edited == pytest.approx(fingerprints.likeness(one, two))
        assert row.near_next == pytest.approx(fingerprints.likeness(one, three))


def test_edge_rows(spark, documents):
    got = fingerprints.with_next(documents.withColumn("part", F.lit(1))).collect()
    assert len(got) == documents.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == ""
    assert by_id[1].near_next == 1.0 and by_id[3].near_next == 0.0
    assert by_id[4].fingerprint == by_id[5].fingerprint and by_id[4].near_next == 1.0
    assert all(len(r.fingerprint) in (0, fingerprints.BINS) for r in got)
    one = documents.where("doc_id = 6")
    assert fingerprints.with_next(one).first().near_next == 1.0
    assert fingerprints.with_next(documents.limit(0)).collect() == []
    assert fingerprints.fingerprint(documents.withColumn("fingerprint", F.lit(1))).columns == ["doc_id", "text", "fingerprint"]
