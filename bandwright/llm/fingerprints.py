"""Document fingerprints: one-permutation MinHash with optimal densification, b bits a bin.

Every WIDTH-word shingle is hashed once; the hash's first bits choose one of BINS bins, and
a bin keeps its least hash. An empty bin borrows from the bin that a hash of (bin, attempt)
names, at the first attempt that meets a filled one; attempts depend on the bin alone, so
that two documents borrow alike and the borrowed bins stay independent (Shrivastava 2017).
BITS low bits of each bin are packed and written in hexadecimal.

The share m of equal bins of two fingerprints overstates their likeness, as unequal bins
still agree in their low bits by chance: likeness is (m - c) / (1 - c) for c = 2**-BITS,
held within 0 and 1.

Equal texts have equal fingerprints. Texts without words, null ones too, have the empty
fingerprint; two of them are alike (1), one of them and another text are not (0). Input
columns that carry a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.frames import beside, extended, mapped, without
from bandwright.llm.words import mix, plain, shingle_lists, slices

WIDTH = 5
BINS = 512
BITS = 4
_EMPTY = np.uint64(2**64 - 1)
_bin_bits = BINS.bit_length() - 1


def _donor(bins: np.ndarray, attempt: int) -> np.ndarray:
    seed = bins.astype(np.uint64) << np.uint64(32) | np.uint64(attempt)
    return (mix(seed ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - _bin_bits)).astype(np.int64)


def densify(least: np.ndarray) -> np.ndarray:
    """Rows of bins, each with one filled bin at least, with every empty bin filled."""
    out = least.copy()
    row, place = np.nonzero(least == _EMPTY)
    attempt = 0
    while len(row):
        attempt += 1
        found = least[row, _donor(place, attempt)]
        filled = found != _EMPTY
        out[row[filled], place[filled]] = found[filled]
        row, place = row[~filled], place[~filled]
    return out


def bins_of(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """One row of densified bins per text; all bins are empty where there are no words."""
    least = np.full((len(texts), BINS), _EMPTY)
    for lo, hi in slices(texts):
        for i, found in enumerate(shingle_lists(texts.slice(lo, hi - lo), width), lo):
            if len(found):
                found = np.sort(found)
                bins = (found >> np.uint64(64 - _bin_bits)).astype(np.int64)
                first = np.flatnonzero(np.diff(bins, prepend=-1))
                # A shingle's hash never is _EMPTY but with probability 2**-64.
                least[i, bins[first]] = found[first]
    some = (least != _EMPTY).any(axis=1)
    least[some] = densify(least[some])
    return least


def pack(bins: np.ndarray) -> list[str]:
    """Hexadecimal fingerprints of rows of bins."""
    # Mixed with the bin's number, so that one hash lent to many bins doesn't agree with
    # another by chance in all of them at once.
    low = (mix(bins ^ np.arange(1, BINS + 1, dtype=np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    packed = low[:, 0::2] << 4 | low[:, 1::2]
    empty = bins[:, 0] == _EMPTY
    return ["" if gone else row.tobytes().hex() for row, gone in zip(packed, empty)]


def likeness(x: str, y: str) -> float:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    if not x or not y:
        return float(x == y)
    same = sum(map(str.__eq__, x, y)) / BINS
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def likenesses(x: list[str], y: list[str]) -> np.ndarray:
    """The same for many pairs at once."""
    out = np.array([float(a == b) for a, b in zip(x, y)])
    full = np.array([bool(a and b) for a, b in zip(x, y)], bool)
    if full.any():
        rows = [
            np.frombuffer("".join(v for v, f in zip(side, full) if f).encode(), np.uint8).reshape(-1, BINS)
            for side in (x, y)
        ]
        chance = 2.0**-BITS
        out[full] = np.clip(((rows[0] == rows[1]).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return out


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of the whole text."""
    docs = without(docs, [name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield beside(batch, {name: pa.array(pack(bins_of(plain(batch.column(text)))), pa.string())})

    return mapped(docs, run, extended(docs, [(name, "string")]))


def _range_of(key: str, cuts: list[int], base: int = 0) -> Column:
    """Number of cuts up to the key, by halving; 0 for null."""
    if not cuts:
        return F.lit(base)
    mid = len(cuts) // 2
    return F.when(F.col(key) >= cuts[mid], _range_of(key, cuts[mid + 1:], base + mid + 1)).otherwise(
        _range_of(key, cuts[:mid], base)
    )


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(part, helper, key, text): the documents in ranges of the key, for `with_next`.

    Each range also gets the first document of the next one that has any (the last range
    the very first), marked as helper. Only the cuts and each range's least key pass
    through the driver. Null keys come first; equal keys are ordered by text.
    """
    own = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = (own.agg(F.percentile_approx("key", shares, 10_000)).first()[0] if shares else None) or []
    cuts = sorted(set(cuts))
    placed = own.withColumn("part", _range_of("key", cuts))
    found = placed.groupBy("part").agg(F.min("key").alias("least"), F.count_if(F.col("key").isNull()).alias("nulls"))
    firsts = {r["part"]: None if r["nulls"] else r["least"] for r in found.collect()}
    filled = sorted(firsts)
    before = {part: filled[i - 1] for i, part in enumerate(filled)}
    expected = F.array(*[F.lit(firsts.get(i)).cast("bigint") for i in range(len(cuts) + 1)])
    target = F.array(*[F.lit(before.get(i)).cast("int") for i in range(len(cuts) + 1)])
    helpers = placed.where(F.col("key").eqNullSafe(expected[F.col("part")]))
    helpers = helpers.groupBy("part", "key").agg(F.min("text").alias("text"))
    helpers = helpers.select(target[F.col("part")].alias("part"), F.lit(True).alias("helper"), "key", "text")
    both = placed.select("part", F.lit(False).alias("helper"), "key", "text").union(helpers)
    return both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(
        "part", "helper", F.col("key").asc_nulls_first(), "text"
    )


def edited(text: str, following: str) -> str:
    """`text`, its last quarter replaced by the beginning of `following`."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per document: its edited text, both fingerprints, and the likeness of its
    fingerprint to the edited text's and to the next document's, in ascending key order.
    Keys are integers.

    The next of the last document is the first. Columns: key, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            keys, texts, helper = batch.column("key").to_pylist(), plain(batch.column("text")), batch.column("helper")
            prints = pack(bins_of(texts))
            rows = list(zip(keys, texts.to_pylist(), prints, helper.to_pylist()))
            if held:
                rows.insert(0, held)
            if not rows:
                continue
            held = rows[-1]
            # A helper only is the next of the row before it.
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3]]
            now, following = [a for a, _ in pairs], [b for _, b in pairs]
            changed = [edited(a[1], b[1]) for a, b in zip(now, following)]
            changed_prints = pack(bins_of(plain(pa.array(changed, pa.large_string()))))
            own, nexts = [r[2] for r in now], [r[2] for r in following]
            yield pa.record_batch(
                {
                    "key": pa.array([r[0] for r in now], pa.int64()),
                    "n_chars": pa.array([len(r[1]) for r in now], pa.int64()),
                    "edited_text": pa.array(changed, pa.string()),
                    "fingerprint": pa.array(own, pa.string()),
                    "edited_fingerprint": pa.array(changed_prints, pa.string()),
                    "near_edited": pa.array(likenesses(own, changed_prints), pa.float64()),
                    "near_next": pa.array(likenesses(own, nexts), pa.float64()),
                }
            )

    return mapped(in_order(docs, key, text, parts),
        run,
        "key bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    ).withColumnRenamed("key", key)
