from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as hits
from test_jaccard import brute as groups
from test_licenses_pii import brute as personal

import corpus_pipeline
from bandwright.llm import toxicity
from bandwright.llm.queries import vocabulary_path
from bandwright.llm.words import plain
from bandwright.sources.session import written

tokenizers = pytest.importorskip("tokenizers")


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]

    def run(name, docs):
        return written(stages[name](spark, docs, folder), name)

    before, docs = rows_of(docs), run("toxicity", docs)
    import zlib

    train = [(k, t) for k, t in before if k in labels and zlib.crc32(str(k).encode()) % 5]
    weights = toxicity.fit(plain(pa.array([t for _, t in train])), [labels[k] for k, _ in train])
    scores = toxicity.scores(plain(pa.array([t for _, t in before])), weights)
    assert rows_of(docs) == [x for x, s in zip(before, scores) if s < 0.5]
    assert docs.columns == columns

    before, docs = rows_of(docs), run("near_duplicates", docs)
    first = {c for _, _, c in groups(before)}
    assert rows_of(docs) == [(k, t) for k, t in before if k in first] and docs.columns == columns

    before, docs = rows_of(docs), run("decontamination", docs)
    assert rows_of(docs) == [(k, t) for k, t in before if not hits(t, bench)[3]] and docs.columns == columns

    before, docs = rows_of(docs), run("personal_data", docs)
    after = dict(rows_of(docs))
    assert docs.columns == columns and list(after) == [k for k, _ in before]
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    for k, text in before:
        spans = personal(text)
        if not spans:
            assert after[k] == text or "[" in after[k]
        for kind, a, b in spans:
            assert f"[{kind.upper()}]" in after[k] and personal(after[k]) == []

    before, docs = rows_of(docs), run("tokens", docs)
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    want = []
    for k, text in before:
        ids = library.encode(text, add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((k, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in docs.collect()) == want
    assert np.all([n > 0 for _, n, *_ in want])


def test_stages_take_odd_rows(spark, documents, folder):
    """Nulls, empties, repeats and other columns pass every stage; empty tables too."""
    extra = documents.withColumns({
        "lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint"),
        "spans": F.lit(1), "_places": F.lit(2), "score": F.lit("x"), "component_id": F.lit(0), "key": F.lit("k"),
    }).drop("_places")
    docs = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == extra.columns, name
    # One of the three equal texts with an id stays; the row without an id stays.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [
        (False, 1), (False, 2), (False, 3), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)
    ]
    none = extra.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert written(stage(spark, none, folder), name).count() == 0
