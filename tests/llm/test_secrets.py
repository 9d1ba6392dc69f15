from __future__ import annotations

import random
import re

import pytest

from bandwright.llm import secrets
from bandwright.llm.secrets import RULES, Rule, candidates, find, required


def brute(text, rules=RULES):
    spans = [
        (m.start(), k, rule.kind, m.end())
        for k, rule in enumerate(rules)
        for m in re.finditer(rule.pattern, text or "", rule.flags)
        if len(m[rule.group]) >= rule.least
    ]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


PIECES = [
    "password", "PassWord", "api_key", "apikey", "API-KEY", "token", "secret", "=", ":", " ", '"', "'", "AKIA", "akia",
    "ABCDEF0123456789", "deadbeefdeadbeef", "0123456789abcdef0", "ABC/+_.=-", "é", "漢", "ghp_", "a" * 40, "xoxb-",
    "1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "eyJ", "abcdefgh_-", ".", "https://", "user", ":", "pw", "@host", "\n",
]


def test_matches_plain_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(4_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    for row in find(df).collect():
        assert [(s.kind, s.start, s.end) for s in row.spans] == brute(row.text), row.text


@pytest.mark.parametrize("rule", RULES)
def test_queries_hold_for_every_match(rule):
    rng = random.Random(6)
    query = required(rule.pattern, rule.flags)
    index = secrets.Index(secrets.grams_in(query))
    import pyarrow as pa

    from bandwright.llm.words import plain

    for _ in range(3_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 8)))
        if re.search(rule.pattern, text, rule.flags):
            rows = secrets.matching(query, index.postings(plain(pa.array([text]))), 1)
            assert rows.tolist() == [0], text


def test_shape_of_queries():
    assert required("[0-9a-f]{16,}") is None and required("a.b") is None
    assert required("abcd") == ("and", ("abc", "bcd"))
    assert required("abc|xyz") == ("or", ("abc", "xyz")) or set(required("abc|xyz")[1]) == {"abc", "xyz"}
    assert required("(abc)?") is None and required("(?:abc)+d*") == "abc"


def test_stored_index_finds_the_same_rows(spark):
    texts = [(1, "my password: x"), (2, "AKIAABC"), (3, "nothing"), (4, None), (5, "pass word"), (6, "SECRET=1")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {(r.key, r.kind) for r in candidates(secrets.build_index(df)).collect()}
    assert found == {(1, "assign"), (2, "access"), (6, "assign")}
    assert candidates(secrets.build_index(df, [Rule("any", "[0-9]+")]), [Rule("any", "[0-9]+")]).collect() == []


def test_edge_rows(spark, documents):
    extra = documents.selectExpr("*", "1 AS spans", "'k' AS kind")
    got = find(extra).collect()
    assert len(got) == documents.count() and got[0].asDict().keys() == {"doc_id", "text", "kind", "spans"}
    for row in got:
        assert [(s.kind, s.start, s.end) for s in row.spans] == brute(row.text)
    assert find(documents.limit(0)).collect() == []
