from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from bandwright.llm import decontaminate


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m[0], m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(text, items):
    own = [w for w, _ in words(text)]
    hit, met = set(), set()
    for key, item in items:
        w = [x for x, _ in words(item)]
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    met.add(str(key))
    return len(own), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(own), hit


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cd", "é", "x1", "Foo"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 8, 13, 14, 25])))) for i in range(12)]
    texts = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(items)[1] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 30))))
        texts.append((i, rng.choice([" ", ", ", "-"]).join(parts).upper() if rng.random() < 0.3 else " . ".join(parts)))
    return texts, items


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts, items = case(1)
    # Short items would hit nearly everything; keep some cases without them as well.
    items = [x for x in items if len(x[1].split()) != 1]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([*items, (None, "x1 x1"), (99, None), items[0]], "item_id bigint, text string")
    for r in decontaminate.mark(docs, bench).collect():
        n, h, met, bad, _ = brute(r.text, items)
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (n, h, met, bad)
    kept = {r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()}
    assert kept == {k for k, t in texts if not brute(t, items)[3]}
    for r in decontaminate.remove_spans(docs, bench).collect():
        own, hit = words(dict(texts)[r.doc_id]), brute(dict(texts)[r.doc_id], items)[4]
        assert [w for w, _ in words(r.text)] == [w for i, (w, _) in enumerate(own) if i not in hit]


def test_edge_rows(spark, documents):
    bench = spark.createDataFrame([(1, "short text"), (2, ""), (3, None)], "item_id bigint, text string")
    extra = documents.withColumns({"n_hit": F.lit("mine"), "_places": F.lit(1)})
    got = decontaminate.mark(extra, bench).collect()
    assert [(r.doc_id, r.n_hit) for r in got if r.contaminated] == [(4, 2), (5, 2), (5, 2)]
    assert decontaminate.remove_documents(extra.drop("_places"), bench).columns == ["doc_id", "text", "n_hit"]
    none = bench.limit(0)
    assert decontaminate.mark(documents, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.mark(documents.limit(0), bench).collect() == []
    assert decontaminate.remove_spans(documents, bench).where("doc_id = 1").first().text is None


def test_the_table_stays_below_ten_bytes_a_byte():
    """Hashes and places, not the words of each window; equal hashes are told apart by the words."""
    import random

    draw = random.Random(1)
    vocabulary = ["".join(draw.choices("etaoinshr", k=draw.randint(2, 9))) for _ in range(5_000)]
    items = [(i, " ".join(draw.choices(vocabulary, k=400))) for i in range(400)]
    block = decontaminate.item_windows(items)
    table = len(block.blob) + sum(x.nbytes for own in block.widths.values() for x in own)
    assert table < 10 * sum(len(t) for _, t in items)


def test_a_window_in_many_items(spark):
    shared = " ".join(f"w{i}" for i in range(13))
    benchmark = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(500)] + [(7, "again " + shared)], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"a {shared} b"), (2, shared.replace("w3", "x3"))], "doc_id int, text string")
    rows = {r.doc_id: r for r in decontaminate.mark(docs, benchmark).collect()}
    assert len(rows[1]["items"]) == 500 and rows[1].n_hit == 13 and rows[2]["items"] == []
