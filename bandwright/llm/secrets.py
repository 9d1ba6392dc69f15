"""Secret scan over a trigram inverted index.

From the parse tree of each rule's pattern comes a Boolean query of trigrams that every
match must contain (`required`). Texts are indexed by block: a posting list per trigram
says which of the block's rows have it, A-Z counting as a-z, over UTF-8 bytes. A query's
posting lists are intersected and united, and only the rows that remain are searched with
the pattern. A rule without mandatory trigrams has every row as a candidate.

`find` builds each block's index where its texts are and searches them in the same pass;
`build_index` keeps the posting lists as a table for later searches by `candidates`. Only
trigrams that some rule asks for are indexed.

Spans are code points, end exclusive, leftmost and non-overlapping within a rule; those of
different rules may overlap, and are ordered by start, then by the order of the rules.
Null and empty texts have none. Repeated rows are searched one by one. Input columns that
carry a result's name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants as sre
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.frames import beside, extended, mapped, without
from bandwright.llm.words import bytes_of, plain, slices


class Rule(NamedTuple):
    """A pattern; a match counts if its `group` has `least` characters at least."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


# The first three are the base rules.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII, 2, 12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    # Runs of 16 and more; shorter ones would be dropped anyway.
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20:/@]{1,100}:[^\x00-\x20:/@]{1,100}@"),
)
RULES = BASE + MORE
MOST_STRINGS = 64

#: A trigram, ("and", queries), ("or", queries), or None: every text may match.
Query = str | tuple | None


def _all(parts: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(text: str) -> Query:
    raw = text.encode().lower().decode("latin-1")
    return _all([raw[i:i + 3] for i in range(len(raw) - 2)])


def _strings(node: tuple) -> set[str] | None:
    """All strings that an item of the parse tree can match, if these are few."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value)}
    if kind is sre.IN:
        out: set[str] = set()
        for what, x in value:
            if what is sre.LITERAL:
                out.add(chr(x))
            elif what is sre.RANGE and x[1] - x[0] < MOST_STRINGS:
                out |= set(map(chr, range(x[0], x[1] + 1)))
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is sre.AT or kind in (sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    if kind is sre.SUBPATTERN:
        return _joined(value[3])
    if kind is sre.BRANCH:
        return _few([_joined(x) for x in value[1]])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, item = value
        if high == 1:
            own = _joined(item)
            return None if own is None else own | ({""} if low == 0 else set())
        if low == high and low <= 4:
            return _joined(list(item) * low)
    return None


def _few(sets: list[set[str] | None]) -> set[str] | None:
    if any(s is None for s in sets):
        return None
    out = set().union(*sets)
    return out if len(out) <= MOST_STRINGS else None


def _joined(items) -> set[str] | None:
    out = {""}
    for item in items:
        own = _strings(item)
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _sequence(items) -> Query:
    """What a sequence requires: the trigrams of its runs of known strings, and of its parts."""
    parts, run = [], {""}
    for item in [*items, None]:
        own = None if item is None else _strings(item)
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        parts.append(_any([_grams(s) for s in run]))
        run = {""} if own is None else own
        if item is not None and own is None:
            kind, value = item
            if kind is sre.SUBPATTERN:
                parts.append(_sequence(value[3]))
            elif kind is sre.BRANCH:
                parts.append(_any([_sequence(x) for x in value[1]]))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                parts.append(_sequence(value[2]))
    if run != {""}:
        parts.append(_any([_grams(s) for s in run]))
    return _all(parts)


def required(pattern: str, flags: int = 0) -> Query:
    """A query that holds for the trigrams of every text the pattern matches in."""
    return _sequence(list(_parser.parse(pattern, flags)))


def grams_in(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(grams_in, query[1]))


class Index:
    """Posting lists of a block of rows for the trigrams that some rule asks for."""

    def __init__(self, grams: Sequence[str]):
        self.grams = sorted(grams)
        codes = [int.from_bytes(g.encode("latin-1"), "big") for g in self.grams]
        self.codes = np.array(codes, np.uint32)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def postings(self, texts: pa.Array) -> dict[str, np.ndarray]:
        data, ends = bytes_of(texts)
        if len(data) < 3 or not len(self.codes):
            return {}
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(self.wanted[code])
        row = np.searchsorted(ends, at, "right") - 1
        inside = at + 3 <= ends[row + 1]
        gram = np.searchsorted(self.codes, code[at[inside]])
        keys = np.unique(gram << 32 | row[inside])
        cuts = np.searchsorted(keys, np.arange(len(self.codes) + 1) << 32)
        return {
            g: keys[cuts[i]:cuts[i + 1]] & 0xFFFFFFFF for i, g in enumerate(self.grams) if cuts[i] < cuts[i + 1]
        }


def matching(query: Query, postings: dict[str, np.ndarray], total: int) -> np.ndarray:
    """Rows of the block whose trigrams satisfy the query."""
    if query is None:
        return np.arange(total)
    if isinstance(query, str):
        return postings.get(query, np.empty(0, np.int64))
    rows = [matching(q, postings, total) for q in query[1]]
    out = rows[0]
    for other in rows[1:]:
        out = np.intersect1d(out, other) if query[0] == "and" else np.union1d(out, other)
    return out


def spans_of(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]


def find(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", name: str = "spans") -> DataFrame:
    """`docs` with array<struct<kind, start, end>> of every rule's spans in the whole text."""
    docs = without(docs, [name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [required(r.pattern, r.flags) for r in rules]
        patterns = [re.compile(r.pattern, r.flags) for r in rules]
        index = Index(set().union(*map(grams_in, queries)))
        for batch in batches:
            texts = plain(batch.column(text))
            found: list[list[tuple[int, int, int]]] = []
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                postings, values = index.postings(part), part.to_pylist()
                block = [[] for _ in values]
                for k, (rule, query, pattern) in enumerate(zip(rules, queries, patterns)):
                    for row in matching(query, postings, hi - lo).tolist():
                        block[row] += [(a, k, b) for a, b in spans_of(values[row], rule, pattern)]
                found += map(sorted, block)
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in row] for row in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield beside(batch, {name: pa.array(spans, kind)})

    return mapped(docs, run, extended(docs, [(name, "array<struct<kind:string,start:bigint,end:bigint>>")]))


def build_index(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, keys): posting lists, one per trigram and block of rows, to be kept as a table."""
    field = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(set().union(*(grams_in(required(r.pattern, r.flags)) for r in rules)))
        for batch in batches:
            texts = plain(batch.column(1))
            for lo, hi in slices(texts):
                lists = index.postings(texts.slice(lo, hi - lo))
                keys = batch.column(0).slice(lo, hi - lo)
                column = pa.array([keys.take(pa.array(rows)).to_pylist() for rows in lists.values()], pa.list_(keys.type))
                yield pa.record_batch({"gram": pa.array(list(lists), pa.string()), "keys": column})

    return mapped(docs.select(F.col(key), F.col(text)), run, f"gram string, keys array<{field}>")


def _holds(query: Query) -> Column:
    if query is None:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains("grams", query)
    parts = [_holds(q) for q in query[1]]
    out = parts[0]
    for other in parts[1:]:
        out = out & other if query[0] == "and" else out | other
    return out


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(key, kind) of the rows that rules with mandatory trigrams may match, from an index.

    Only such rules can be looked up; the others have to read every text.
    """
    asked = [(r.kind, q) for r in rules if (q := required(r.pattern, r.flags)) is not None]
    if not asked:
        return index.select(F.explode("keys").alias("key"), F.lit("").alias("kind")).limit(0)
    wanted = sorted(set().union(*(grams_in(q) for _, q in asked)))
    met = index.where(F.col("gram").isin(wanted)).select("gram", F.explode("keys").alias("key"))
    rows = met.groupBy("key").agg(F.collect_set("gram").alias("grams"))
    kinds = F.array(*[F.when(_holds(q), F.lit(kind)) for kind, q in asked])
    return rows.select("key", F.explode(F.array_compact(kinds)).alias("kind"))
