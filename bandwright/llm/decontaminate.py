"""Benchmark decontamination: documents that repeat passages of test items.

The windows of all items (13 words; a shorter item is one window) form a hash table that
is broadcast. Tasks hash every window of a document, look the hashes up, and compare the
words of each hit with the item's, so that equal hashes of different words count for
nothing. Items are broadcast in blocks of about BLOCK_BYTES of text, whose table (sorted
hashes, places in one blob of words) takes less than ten times as many bytes: the usual
benchmark is one block, a larger one takes one pass over the documents for each block.

Null texts have no words and are never contaminated. Null items, items without words and
items without an id are no items. Repeated documents are judged one by one; repeated items
count once. Input columns that carry a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.frames import beside, extended, mapped, without
from bandwright.llm.words import NOT_ALNUM, Words, plain, slices, whole_hash, window_hashes, words
from bandwright.sources.session import written

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARE = 20
RESULTS = ["n_words", "n_hit", "items", "contaminated"]
_STATE = {"_places": "array<bigint>", "_names": "array<string>", "_words": "bigint"}
_BITS = 20

class Windows(NamedTuple):
    """Windows of one width, by ascending hash: their item, and their words in the block's blob.

    Each takes 20 bytes; the blob holds the items' words in lower case, a space between them.
    """

    hashes: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Block(NamedTuple):
    names: list[str]
    blob: bytes
    widths: dict[int, Windows]


def item_windows(items: list[tuple[object, str]], window: int = WINDOW) -> Block:
    """The windows of all items. Items of one name are one item; a window repeated inside an item counts once."""
    numbers: dict[str, int] = {}
    blob, size, parts = [], 0, {}
    for key, text in items:
        own = words(plain(pa.array([text])), NOT_ALNUM)
        n = len(own.hashes)
        if not n:
            continue
        width = min(window, n)
        hashes = window_hashes(own.hashes, width) if n >= window else np.array([whole_hash(own.hashes)], np.uint64)
        _, once = np.unique(hashes, return_index=True)
        item = numbers.setdefault(str(key), len(numbers))
        lengths = (own.end - own.start).astype(np.int64)
        starts = size + np.cumsum(lengths + 1) - lengths - 1
        ends = starts + lengths
        blob.append(b" ".join(own.text(0, n)) + b" ")
        size += len(blob[-1])
        parts.setdefault(width, []).append(
            (hashes[once], np.full(len(once), item, np.int32), starts[once].astype(np.int32), ends[once + width - 1].astype(np.int32)))
    widths = {}
    for width, found in parts.items():
        arrays = [np.concatenate(column) for column in zip(*found)]
        order = np.argsort(arrays[0], kind="stable")
        widths[width] = Windows(*(x[order] for x in arrays))
    return Block(list(numbers), b"".join(blob), widths)


class Scanner:
    """Looks the windows of texts up in one block of items."""

    def __init__(self, block: Block):
        self.block = block
        self.seen = {}
        for width, own in block.widths.items():
            self.seen[width] = np.zeros(1 << _BITS, bool)
            self.seen[width][own.hashes >> np.uint64(64 - _BITS)] = True

    def candidates(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """(place, first window, one past the last window) of the hashes that the block has."""
        values = window_hashes(hashes, width)
        at = np.flatnonzero(self.seen[width][values >> np.uint64(64 - _BITS)])
        keys = self.block.widths[width].hashes
        first, last = (np.searchsorted(keys, values[at], side) for side in ("left", "right"))
        return np.stack([at, first, last], axis=1)[first < last]

    def hits(self, found: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words lie in a verified window, and the items met per row."""
        edges = np.zeros(len(found.start) + 1, np.int64)
        items: dict[int, set[str]] = {}
        names, blob = self.block.names, self.block.blob
        for width, own in self.block.widths.items():
            for at, first, last in self.candidates(found.hashes, width).tolist():
                row = int(np.searchsorted(found.first, at, "right")) - 1
                if at + width > found.first[row + 1]:
                    continue
                text = b" ".join(found.text(at, at + width))
                met = {names[own.items[k]] for k in range(first, last) if blob[own.starts[k]:own.ends[k]] == text}
                if met:
                    edges[at] += 1
                    edges[at + width] -= 1
                    items.setdefault(row, set()).update(met)
        return edges.cumsum()[:-1] > 0, items


def _marker(block, text: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(block.value)
        for batch in batches:
            texts = plain(batch.column(text))
            places, names, totals = [], [], []
            for lo, hi in slices(texts):
                found = words(texts.slice(lo, hi - lo), NOT_ALNUM)
                hit, items = scanner.hits(found)
                totals += np.diff(found.first).tolist()
                for row in range(hi - lo):
                    own = hit[found.first[row]:found.first[row + 1]] if row in items else []
                    places.append(np.flatnonzero(own).tolist())
                    names.append(sorted(items.get(row, ())))
            if not first:
                places = [sorted({*x, *y}) for x, y in zip(places, batch.column("_places").to_pylist())]
                names = [sorted({*x, *y}) for x, y in zip(names, batch.column("_names").to_pylist())]
                batch = batch.drop_columns(list(_STATE))
            arrays = {
                "_places": pa.array(places, pa.list_(pa.int64())),
                "_names": pa.array(names, pa.list_(pa.string())),
                "_words": pa.array(totals, pa.int64()),
            }
            yield beside(batch, arrays)

    return run


def _cutter(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.names.index(text), batch.column(text).to_pylist()
            for row, hit in enumerate(batch.column("_places").to_pylist()):
                if hit:
                    texts[row] = cut_words(texts[row], hit)
            yield batch.set_column(at, text, pa.array(texts, batch.schema.field(at).type))

    return run


def cut_words(text: str, hit: list[int]) -> str:
    """The text without its runs of hit words; what stands between two runs stays."""
    found = words(plain(pa.array([text])), NOT_ALNUM)
    data, out, last = text.encode(), [], 0
    places = set(hit)
    for k in hit:
        if k - 1 not in places:
            out.append(data[last:found.start[k]])
        if k + 1 not in places:
            last = found.end[k]
    return b"".join([*out, data[last:]]).decode()


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    rows = benchmark.select(F.col(item).alias("k"), F.col(text).alias("t")).dropna().distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES) or 1
    for i in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(count)) == i)
        yield [(r.k, r.t) for r in part.collect()]


def _places(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int) -> DataFrame:
    marked = without(docs, list(_STATE))
    schema = extended(marked, list(_STATE.items()))
    context = docs.sparkSession.sparkContext
    for i, block in enumerate(_blocks(benchmark, item, item_text)):
        if i:
            marked = written(marked)
        table = context.broadcast(item_windows(block, window))
        marked = mapped(marked, _marker(table, text, not i), schema)
    return marked


def _contaminated() -> Column:
    hits = F.size("_places")
    return (hits > 0) & (hits * SHARE >= F.col("_words"))


def mark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """`docs` with n_words, n_hit, items (ids met, as sorted strings) and contaminated.

    Contaminated: at least one hit word, and at least 1 in SHARE of the words are hit.
    """
    return _places(without(docs, RESULTS), benchmark, text, item, item_text, window).withColumns(
        {
            "n_words": F.col("_words"), "n_hit": F.size("_places").cast("bigint"),
            "items": F.col("_names"), "contaminated": _contaminated(),
        }
    ).drop(*_STATE)


def remove_documents(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return _places(docs, benchmark, text, item, item_text, window).where(~_contaminated()).drop(*_STATE)


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """All documents, their texts without the words inside occurrences of item windows."""
    marked = _places(docs, benchmark, text, item, item_text, window)
    return mapped(marked, _cutter(text), marked.schema).drop(*_STATE)
