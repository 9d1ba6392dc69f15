"""URL filter: host and path rules, then a weighted vocabulary.

The longest rule that fits decides. Where none fits, an Aho-Corasick automaton finds the
vocabulary's terms in the lower-cased URL. A term counts where it is a whole word, that is,
between characters that are no ASCII letters or digits. One strict term rejects the URL;
soft terms reject it when at least SOFT_HITS different ones count.

A null URL, or one without `://`, has an empty host and path, and no rule fits it; a null
URL has no terms. Repeated rows are judged one by one. Input columns that carry a result's
name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.frames import beside, extended, mapped, without


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# Rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
# Our own vocabulary.
STRICT = ("porn", "xxx", "hentai", "escort", "camgirl", "warez", "viagra", "cialis")
SOFT = (
    "adult", "sex", "nude", "dating", "casino", "poker", "bet", "betting", "slots", "jackpot",
    "loan", "payday", "pills", "pharmacy", "crack", "keygen", "torrent", "replica", "cheap", "free",
)
SOFT_HITS = 2
RESULTS = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits"]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or end, A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(raw, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return host & F.col("path").startswith(rule.path)


class Vocabulary:
    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        self.automaton = ahocorasick.Automaton()
        for term in soft:
            self.automaton.add_word(term, (term, False))
        for term in strict:
            self.automaton.add_word(term, (term, True))
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int]:
        """Numbers of different strict and soft terms that stand in the URL as words."""
        low = url.lower()
        met: tuple[set[str], set[str]] = (set(), set())
        for end, (term, strict) in self.automaton.iter(low):
            start = end - len(term) + 1
            if not (_word(low[start - 1:start]) or _word(low[end + 1:end + 2])):
                met[not strict].add(term)
        return len(met[0]), len(met[1])


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS, url: str = "url",
) -> DataFrame:
    """`pages` with host, path, rule (the longest that fits, or null), strict_hits,
    soft_hits and verdict (allow or block)."""
    pages = without(pages, RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(strict, soft)
        for batch in batches:
            hits = [vocabulary.hits(u or "") for u in batch.column(url).to_pylist()]
            yield beside(
                batch,
                {name: pa.array([h[i] for h in hits], pa.int32()) for i, name in enumerate(RESULTS[4:])},
            )

    counted = mapped(pages, run, extended(pages, [(name, "int") for name in RESULTS[4:]]))
    counted = counted.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    # The longest first; of equally long rules the first in the list.
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(ordered):
        name = F.when(_fits(rule), rule.host + rule.path).otherwise(name)
        verdict = F.when(_fits(rule), rule.verdict).otherwise(verdict)
    own = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits)
    return counted.withColumns(
        {"rule": name, "verdict": F.coalesce(verdict, F.when(own, "block").otherwise("allow"))}
    )
