"""Spelling variants against brute force: all places of all words in plain loops."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from bandwright.llm import spelling

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 7
    return {w: n for w, n in count.items() if n >= 2}


def brute(rows):
    count = counted(rows)
    near, alike = defaultdict(set), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            alike[w[:i], w[i + 1:]].add(w)
            v = w[:i] + w[i + 1:]
            if v in count:
                near[w].add(v)
                near[v].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in count.items():
        best = min(((-count[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), count.get(form[w], -1)) for w, n in count.items())


def found(df):
    rows = spelling.variants(df).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_dense_words(spark):
    """Few letters, so that edits hit every place, runs of equal letters and both tries."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abé", k=draw.randint(6, 13))) for _ in range(1_500)]
    rows = [(i, " ".join(draw.choices(words, k=60))) for i in range(250)]
    assert found(frame(spark, rows)) == brute(rows)


def test_words_around_the_longest(spark):
    draw = random.Random(4)
    base, words = "".join(draw.choices("abc", k=900)), []
    for n in (30, 31, 32, 33, 34, 90, 900):
        w = base[:n]
        words += [w, w[:20] + "z" + w[21:], w[:20] + "y" + w[21:], w[:5] + w[6:], w[:-3] + w[-2:], w + "q", w[1:], "k" + w, w[:-1]]
    rows = [(i, ", ".join(words)) for i in range(4)]
    got = found(frame(spark, rows))
    assert got == brute(rows) and max(len(row[0]) for row in got) > 890


def test_forms_and_roots(spark):
    """A chain of forms: each is ten times as common as the word before it."""
    texts = ["spelling " * 2_500, "spellimg " * 240, "spellimgs " * 22, "apelling " * 3, "unrelated " * 3]
    rows = [(10 + i, text) for i, text in enumerate(texts)]
    got = {row[0]: row for row in found(frame(spark, rows))}
    assert sorted(got.values()) == brute(rows)
    assert got["spellimgs"][1:3] == ("spellimg", "spelling") and got["unrelated"][1:3] == ("", "unrelated")


def test_edge_rows(spark, documents):
    rows = [tuple(r) for r in documents.collect()] + [(None, "Éclairs ÉCLAIRS éclairs éclairs"), (None, None), (3, "abcdefg×÷ abcdefg×÷")]
    df = frame(spark, rows).select("*", F.lit(1).alias("word"), F.lit(2).alias("n"), F.lit("x").alias("run"))
    assert found(df) == brute(rows)
    assert found(frame(spark, [])) == [] and found(frame(spark, [(1, None), (2, "few")])) == []


def test_states_are_shared(spark):
    """The first frontier holds a state once, however many words stand behind it."""
    words = [f"abcd{x}efgh{y}{z}" for x in "pq" for y in "klmnop" for z in "rstuv"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    states = spelling._first_frontier(df).filter("side = 'f'")
    assert states.filter("walked = 'abcdpefgh' AND node = 'abcdqefgh' OR walked = 'abcdqefgh' AND node = 'abcdpefgh'").count() == 1
    assert spelling.neighbours(df).distinct().count() == spelling.neighbours(df).count() == 60 * (1 + 5 + 4)
