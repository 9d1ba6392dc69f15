"""Merkle manifest: against a plain loop, over several block sizes, and its edge cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bandwright.llm import merkle


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, changed):
    """(key, leaf, subroot, root, siblings, folded root) by plain loops; `changed` maps a row to its tampered text."""

    def leaf(row, text):
        values = (row.doc_id, row.source, row.lang, row.n_chars, text)
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        paths, own, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, o in enumerate(own):
                run = level[o // 3 * 3:o // 3 * 3 + 3]
                paths[i].append(("".join(run[:o % 3]), "".join(run[o % 3 + 1:])))
                own[i] = o // 3
            level = [digest("".join(level[j:j + 3])) for j in range(0, len(level), 3)]
        return level[0], paths

    sources = defaultdict(list)
    for row in rows:
        sources[row.source].append((row.doc_id is not None, row.doc_id or 0, leaf(row, row.text), leaf(row, changed(row)), row.doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    if not names:
        return []
    trees = {}
    for name in names:
        sources[name].sort(key=lambda x: x[:4])
        trees[name] = tree([x[2] for x in sources[name]])
    root, upper = tree([trees[name][0] for name in names])
    found = []
    for name, above in zip(names, upper):
        for x, below in zip(sources[name], trees[name][1]):
            folded = x[3]
            for left, right in below + above:
                folded = digest(left + folded + right)
            siblings = "".join(left + right for left, right in below + above)
            found.append((x[4], x[2], trees[name][0], root, siblings, folded, folded == root))
    return sorted(found, key=str)


def proved(df, tampered):
    return sorted(
        ((r.doc_id, r.leaf, r.subroot, r.root, "".join(s.left + s.right for s in r.path), r.folded_root, r.verified)
         for r in merkle.prove(df, tampered).collect()), key=str)


@pytest.fixture
def tampered(spark):
    marked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(marked, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def without_lines(row):
    even = zlib.crc32(("" if row.doc_id is None else str(row.doc_id)).encode()) % 2 == 0
    return row.text.replace("\n", "") if even and row.text is not None else row.text


def test_whole_table(spark, folder, tampered):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = proved(docs, tampered)
    assert got == brute(docs.collect(), without_lines)
    assert 0 < sum(row[-1] for row in got) < len(got)


@pytest.mark.parametrize("n", [1, 3, 9, 10, 28, 150])
def test_rounds_of_small_blocks(spark, folder, tampered, monkeypatch, n):
    """Blocks of nine leaves, so that sources need up to three rounds; 20 sources need two above them."""
    monkeypatch.setattr(merkle, "DIGITS", 2)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(n)
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 4 != 0, F.lit("hot")).otherwise(F.col("source")))
    assert proved(docs, tampered) == brute(docs.collect(), without_lines)


def test_nulls_repeats_and_clashing_columns(spark, tampered):
    rows = [
        (1, None, "en", 3, "a\nb"), (1, None, "en", 3, "a\nb"), (None, "é", None, None, None), (None, "é", None, None, ""),
        (2, "", None, 0, ""), (3, "Z", "de", None, "x" * 200_000), (4, "a", "fr", 1, "\n"), (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    clashing = docs.select("*", *[F.lit(9).alias(c) for c in ("leaf", "root", "path", "key", "rank", "n")])
    assert proved(clashing, tampered) == brute(docs.collect(), without_lines)
    assert merkle.prove(docs.limit(0), tampered).count() == 0


def test_any_change_is_seen(spark):
    """Every changed row fails against the root, and its neighbours don't."""
    docs = spark.range(40).selectExpr(
        "id AS doc_id", "concat('s', id % 3) AS source", "'en' AS lang", "id AS n_chars", "concat('text ', id) AS text")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    assert all(r.verified == (r.doc_id % 5 != 0) for r in merkle.prove(docs, changed).collect())


def test_leaves_meet_no_join_inside_a_block(spark, folder):
    """Rolling up moves the leaves once."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nodes = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("rank"), F.lit(99).alias("n"), F.md5("text").alias("digest"))
    plan = merkle.rolled_up(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
