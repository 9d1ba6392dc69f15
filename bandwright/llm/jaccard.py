"""Exact Jaccard join of word shingles as a join in a metric space, up to components.

Distance is 1 - |A n B| / |A u B| over sets of WIDTH-word shingles; documents link within
RADIUS. Equal sets are one node from the start. Then:

1. Regions. Unrelated documents all lie at distance 1 from each other and from any pivot
   document, so pivot documents alone would replicate every document everywhere. The first
   pivots are therefore single shingles, nearest first: the order of shingles is by how
   many documents have them. A set's home is the region of its first shingle. A set with a
   partner in a region of another home shares that region's shingle, or is at least as far
   from the partner as all of its own shingles before it; so it is replicated to the
   regions of its first |A| - ceil((1 - RADIUS) |A|) + 1 shingles and no others. Shingles that
   no second document has come first in the order and need no rows.
2. Pivots. In each region the least and largest members under two orders are pivots.
   Every member's distance to them is computed from the whole sets, and members within
   RADIUS are linked: a ball around a pivot is one component without any further pair.
3. Windows. Members that are not in the region's main component form the Voronoi cells
   of their nearest pivots p. By the triangle inequality such a member x can only link to
   members y with |d(x, p) - d(y, p)| <= RADIUS, and a pair in one component needs no link.
   Strays and members are dealt out in blocks; a second metric, the Hamming distance of
   parity sketches, never exceeds the size of the symmetric difference and rules out most
   pairs in the block. The whole sets of the pairs that remain are compared. Every pair
   that links is thus met or already joined.

Sets are compared by 64-bit shingle hashes, within a pair only, and a node's id is a 64-bit
hash of its set: two different sets or two shingles are confused with probability 2**-64.
Shingle counts are taken over all documents; they only order shingles and change no result.

Null texts and texts without words have no shingles and link with nothing. Rows with equal
keys are one document. Rows without a key count in links but never name a component; a
component of such rows alone has none. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwright.llm.components import components
from bandwright.llm.frames import mapped
from bandwright.llm.words import mix, plain, shingle_lists, slices
from bandwright.sources.session import written

WIDTH = 5
#: Linked: SHARE[0] * |A n B| >= SHARE[1] * |A u B|.
SHARE = (100, 75)
FREQUENT = 8
MAX_FREQUENT = 1 << 20
MAX_BITS = 28
GROUP = 1 << 21
FLUSH = 1 << 21
BLOCK = 1024
HELD_BYTES = 4 << 20
_TURN = 0x3333333333333333


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for lo, hi in slices(texts):
        for found in shingle_lists(texts.slice(lo, hi - lo), width):
            yield np.unique(found)


def _node(own: np.ndarray) -> np.int64:
    total = np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(len(own)))
    return mix(np.array([total]))[0].view(np.int64)


def signed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, node) per row; rows with equal sets have equal nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for own in _sets(plain(batch.column(1)), width):
                sizes.append(len(own))
                nodes.append(_node(own))
            yield pa.record_batch(
                {"key": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.int64())}
            )

    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return mapped(docs, run, f"key {docs.schema['key'].dataType.simpleString()}, n_shingles bigint, node bigint")


class Order(NamedTuple):
    """What is known of how many documents have a shingle, by the hash's first bits."""

    bits: int
    shared: np.ndarray  # bit set: two rows at least have a shingle of these first bits
    frequent: np.ndarray  # first 32 bits, ascending
    counts: np.ndarray

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """0: no other row has it; 1: few; else the count of a frequent shingle."""
        place = hashes >> np.uint64(64 - self.bits)
        out = (self.shared[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(np.int64)
        if len(self.frequent):
            first = (hashes >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.frequent, first), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == first, self.counts[at], out)
        return out


def order(docs: DataFrame, text: str, width: int, total: int) -> Order:
    """Counts of all shingles of all rows by the first 32 bits of their hashes.

    Tasks send the bits in sorted runs with their counts, by range; a range's counts are
    summed in one task, which sees about GROUP entries whatever the input is.
    """
    groups = 1 << max(0, (total // GROUP).bit_length())
    bits = min(MAX_BITS, max(16, groups.bit_length() + 2, (total * 2).bit_length()))

    def runs(values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(np.concatenate(values), return_counts=True)
        group = (found.astype(np.uint64) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=groups))
        pieces = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        small = np.minimum(counts, 65535).astype(np.uint16)
        yield pa.record_batch(
            {
                "range": pa.array([int(group[a]) for a, _ in pieces], pa.int32()),
                "found": pa.array([found[a:b].tobytes() for a, b in pieces], pa.binary()),
                # Only counts over 1 are sent, with their places.
                "more": pa.array([_more(small[a:b]) for a, b in pieces], pa.binary()),
            }
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for own in _sets(plain(batch.column(0)), width):
                held.append((own >> np.uint64(32)).astype(np.uint32))
                size += len(own)
                if size >= FLUSH:
                    yield from runs(held)
                    held, size = [], 0
        if size:
            yield from runs(held)

    per_group = (1 << bits) // groups // 8

    def add(table: pa.Table) -> pa.Table:
        values, weights = [], []
        for found, more in zip(table["found"], table["more"]):
            values.append(np.frombuffer(found.as_buffer(), np.uint32))
            weights.append(_counts(len(values[-1]), more.as_buffer()))
        values, weights = np.concatenate(values), np.concatenate(weights)
        turn = np.argsort(values)
        values, weights = values[turn], weights[turn]
        starts = np.flatnonzero(np.diff(values, prepend=values[0] ^ 1))
        sums = np.add.reduceat(weights, starts)
        keys = values[starts]
        own = int(table["range"][0].as_py())
        place = (keys[sums > 1] >> np.uint32(32 - bits)).astype(np.int64) - own * per_group * 8
        shared = np.zeros(per_group, np.uint8)
        np.bitwise_or.at(shared, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        often = sums >= FREQUENT
        return pa.table(
            {
                "range": pa.array([own], pa.int32()), "shared": pa.array([shared.tobytes()], pa.binary()),
                "keys": pa.array([keys[often].tobytes()], pa.binary()),
                "counts": pa.array([sums[often].astype(np.int64).tobytes()], pa.binary()),
            }
        )

    sent = mapped(docs.select(F.col(text).alias("text")), emit, "range int, found binary, more binary")
    summed = written(
        sent.groupBy("range").applyInArrow(add, "range int, shared binary, keys binary, counts binary"), "counts"
    )
    # The bit map has 2**MAX_BITS bits at most; of frequent shingles the most frequent are kept.
    shared = np.zeros((1 << bits) // 8, np.uint8)
    for row in summed.select("range", "shared").toLocalIterator():
        shared[row["range"] * per_group:(row["range"] + 1) * per_group] = np.frombuffer(row["shared"], np.uint8)
    keys, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
    for row in summed.select("keys", "counts").toLocalIterator():
        keys = np.concatenate([keys, np.frombuffer(row["keys"], np.uint32)])
        counts = np.concatenate([counts, np.frombuffer(row["counts"], np.int64)])
        if len(keys) > 2 * MAX_FREQUENT:
            keys, counts = _most(keys, counts)
    keys, counts = _most(keys, counts)
    turn = np.argsort(keys)
    return Order(bits, shared, keys[turn], counts[turn])


def _most(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) <= MAX_FREQUENT:
        return keys, counts
    kept = np.argsort(-counts, kind="stable")[:MAX_FREQUENT]
    return keys[kept], counts[kept]


def _more(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts > 1)
    return at.astype(np.uint32).tobytes() + counts[at].tobytes()


def _counts(n: int, more) -> np.ndarray:
    out = np.ones(n, np.int64)
    k = len(more) // 6
    if k:
        at = np.frombuffer(more, np.uint32, k)
        out[at] = np.frombuffer(more, np.uint16, k, 4 * k)
    return out


def homes(docs: DataFrame, text: str, width: int, known: Order) -> DataFrame:
    """(node, n, firsts, own, sketch) for every row with a region to be in: its regions'
    shingles, its whole set and its sketch. A task sends each of its different sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, sent = shared.value, set()
        rows, held = [], 0
        for batch in batches:
            for own in _sets(plain(batch.column(0)), width):
                n = len(own)
                need = n - -(-SHARE[1] * n // SHARE[0]) + 1
                rank = order.rank(own) if n else np.empty(0, np.int64)
                # Shingles without a second document fill the first places.
                left = need - np.count_nonzero(rank == 0)
                if not n or left <= 0:
                    continue
                node = int(_node(own))
                if node in sent:
                    continue
                sent.add(node)
                at = np.flatnonzero(rank)
                firsts = own[at[np.argsort(rank[at], kind="stable")[:left]]]
                rows.append((node, n, firsts.view(np.int64), own.tobytes(), sketch(own).tobytes()))
                held += 12 * n
                if held >= HELD_BYTES:
                    yield _homes(rows)
                    rows, held = [], 0
        if rows:
            yield _homes(rows)

    return mapped(docs.select(F.col(text).alias("text")),
        run, "node bigint, n bigint, firsts array<bigint>, own binary, sketch binary"
    )


def _homes(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.record_batch(columns, names=["node", "n", "firsts", "own", "sketch"])


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, either) of the pairs (a, b): sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, either = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                c = int(np.count_nonzero(both[1:] == both[:-1]))
                common.append(c)
                either.append(len(both) - c)
            yield pa.record_batch(
                {"a": batch.column("a"), "b": batch.column("b"), "common": pa.array(common, pa.int64()),
                 "either": pa.array(either, pa.int64())}
            )

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return mapped(both.select("a", "b", "x", "y"), run, "a bigint, b bigint, common bigint, either bigint")


def _linked() -> Column:
    return F.lit(SHARE[0]) * F.col("common") >= F.lit(SHARE[1]) * F.col("either")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links(docs: DataFrame, text: str, width: int, total: int) -> DataFrame:
    """Pairs of nodes (a, b) that join exactly what the links between all nodes join."""
    found = written(homes(docs, text, width, order(docs, text, width, total)), "homes")
    sets = written(found.groupBy("node").agg(F.min("own").alias("own"), F.min("sketch").alias("sketch")), "sets")
    rows = written(
        found.select("node", "n", F.explode("firsts").alias("s")).distinct(), "regions"
    )
    turned = F.col("node").bitwiseXOR(F.lit(_TURN))
    regions = rows.groupBy("s").agg(
        F.count("*").alias("size"), F.bit_xor("node").alias("members"),
        F.min("node").alias("p0"), F.max("node").alias("p1"),
        F.min(turned).bitwiseXOR(F.lit(_TURN)).alias("p2"), F.max(turned).bitwiseXOR(F.lit(_TURN)).alias("p3"),
    ).where("size > 1")
    # Regions with the same members are one.
    pivots = ["p0", "p1", "p2", "p3"]
    regions = regions.groupBy("size", "members", *pivots).agg(F.min("s").alias("s"))
    members = written(rows.join(regions.drop("members"), "s"), "members")

    spokes = members.select("node", F.explode(F.array_distinct(F.array(*pivots))).alias("p")).where("node <> p")
    spokes = spokes.select(*_ordered("node", "p")).distinct()
    distances = written(measured(spokes, sets), "distances")
    sure = distances.where(_linked()).select("a", "b")
    labels = components(sure)

    labelled = written(
        members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled"
    )
    # Pivots count for the main component, but their own pairs are all measured.
    inner = ~F.col("node").isin(*map(F.col, pivots))
    counts = labelled.groupBy("s", "label").agg(F.count("*").alias("k"), F.count_if(inner).alias("inner"))
    main = counts.groupBy("s").agg(F.max(F.struct("k", "label", "inner")).alias("most"), F.sum("inner").alias("m"))
    # In a region without a stray all members are joined already.
    open_regions = main.select("s", F.col("most.label").alias("main"), "m", (F.col("m") - F.col("most.inner")).alias("k"))
    # Each step is written, so that the driver never holds one plan of them all.
    unsettled = written(labelled.join(open_regions.where("k > 0 and m > 1"), "s").where(inner), "unsettled")
    reach = written(_reach(unsettled, distances, pivots), "reach")
    rest = _windows(reach, sets, len(pivots))
    rest = written(rest.join(distances.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    # The stars stand for the links that they were made of.
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return stars.union(measured(rest, sets).where(_linked()).select("a", "b"))


def _reach(unsettled: DataFrame, distances: DataFrame, pivots: list[str]) -> DataFrame:
    """The rows of `unsettled` with their distances d0, d1, ... to the region's pivots."""
    d = (1 - F.col("common") / F.col("either")).alias("d")
    own = ["s", "node", "n", "label", "main", "m", "k"]
    spokes = unsettled.select(*own, F.posexplode(F.array(*pivots)).alias("i", "p"))
    spokes = spokes.select(*own, "i", *_ordered("node", "p")).join(distances.select("a", "b", d), ["a", "b"])
    found = [F.max(F.when(F.col("i") == i, F.col("d"))).alias(f"d{i}") for i in range(len(pivots))]
    # (s, node) is a key; the other columns come along, so that no join brings them back.
    return spokes.groupBy("s", "node").agg(*[F.first(c).alias(c) for c in own[2:]], *found)


def _windows(reach: DataFrame, sets: DataFrame, pivots: int) -> DataFrame:
    """Pairs (a, b) of a region's stray and another of its members that may link.

    A task compares a block of strays with a block of members and returns only the pairs
    that the windows and the sketches leave.
    """
    stray = F.col("label") != F.col("main")
    # Two members may share many regions; the least that both are unsettled in compares them.
    # A list holds at most a set's first shingles.
    shared = reach.groupBy("node").agg(F.array_sort(F.collect_list("s")).alias("regions"))
    rows = reach.join(sets.select("node", "sketch"), "node").join(shared, "node")
    blocks = {"m": F.ceil(F.col("m") / BLOCK).cast("int"), "k": F.ceil(F.col("k") / BLOCK).cast("int")}
    own = {name: F.pmod(F.xxhash64("node"), n).cast("int") for name, n in blocks.items()}
    columns = ["s", "i", "j", "stray", "node", "n", "label", "main", *[f"d{i}" for i in range(pivots)], "sketch", "regions"]

    def lots(count: str, lot) -> Column:
        return F.transform(F.sequence(F.lit(0), blocks[count] - 1), lot)

    strays = lots("m", lambda j: F.struct(own["k"].alias("i"), j.alias("j"), F.lit(True).alias("stray")))
    others = lots("k", lambda i: F.struct(i.alias("i"), own["m"].alias("j"), F.lit(False).alias("stray")))
    both = rows.withColumn("_lot", F.explode(F.when(stray, F.concat(strays, others)).otherwise(others)))
    both = both.select("*", "_lot.*").select(columns)
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "s", "i", "j").sortWithinPartitions("s", "i", "j")
    return mapped(dealt, _compare, "a bigint, b bigint").distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = [held[c].to_numpy() for c in ("s", "i", "j")]
        cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        cuts = [0, *cuts.tolist()]
        pairs = [_near(held.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
        held = held.slice(cuts[-1])
        yield _pairs(pairs)
    if held is not None:
        yield _pairs([_near(held)])


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    found = np.concatenate([np.empty((0, 2), np.int64), *found])
    return pa.record_batch({"a": pa.array(found.min(axis=1, initial=2**63 - 1)), "b": pa.array(found.max(axis=1, initial=-2**63))})


def _near(group: pa.Table) -> np.ndarray:
    """Pairs of one block of strays and one of members that may link."""
    stray = group["stray"].to_numpy()
    if not stray.any() or stray.all():
        return np.empty((0, 2), np.int64)
    node, n, label, main = (group[c].to_numpy() for c in ("node", "n", "label", "main"))
    d = np.stack([group[c].to_numpy() for c in group.column_names if c in ("d0", "d1", "d2", "d3")])
    sketches = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["sketch"]]
    width = np.array([len(x) for x in sketches])
    others = np.flatnonzero(~stray)
    here = group["s"][0].as_py()
    regions = group["regions"]
    classes = {w: others[width[others] == w] for w in set(width[others].tolist())}
    matrices = {w: np.stack([sketches[y] for y in rows]) for w, rows in classes.items()}
    radius = 1 - SHARE[1] / SHARE[0] + 1e-9
    out = []
    for x in np.flatnonzero(stray):
        for w, rows in classes.items():
            keep = (label[rows] != label[x]) & ((label[rows] == main[x]) | (node[x] < node[rows]))
            keep &= np.minimum(n[rows], n[x]) * SHARE[0] >= np.maximum(n[rows], n[x]) * SHARE[1]
            # The Voronoi cell of x is its nearest pivot's; a partner lies in the window.
            home = int(np.argmin(d[:, x]))
            keep &= np.abs(d[home, rows] - d[home, x]) <= radius
            if not keep.any():
                continue
            narrow = min(w, width[x])
            apart = np.bitwise_count(fold(matrices[w][keep], narrow) ^ fold(sketches[x], narrow)).sum(axis=1)
            # Sketches are no further apart than the sets; linked sets are no further apart than this.
            most = (n[rows[keep]] + n[x]) * (SHARE[0] - SHARE[1])
            close = rows[keep][apart.astype(np.int64) * (SHARE[0] + SHARE[1]) <= most]
            if len(close):
                mine = regions[x].values.to_numpy()
                least = [np.intersect1d(mine, regions[y].values.to_numpy(), assume_unique=True)[0] for y in close.tolist()]
                close = close[np.array(least) == here]
            if len(close):
                out.append(np.stack([np.full(len(close), node[x]), node[close]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes in at least four times as many bits as it has members.

    A member changes one bit, so that two sketches differ in at most as many bits as the
    sets do in members.
    """
    bits = max(256, 1 << (4 * len(own) - 1).bit_length())
    parity = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """The same sketches in fewer bits."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_shingles, component_id) per row; component_id: the least key reachable by links."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    nodes = written(signed(own, "key", "text", width), "nodes")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    full = nodes.where("n_shingles > 0")
    # Rows with one key are one document, whatever their texts.
    again = full.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("m")).where("a <> m and key is not null")
    repeated = full.join(again, "key").select("a", F.col("node").alias("b"))
    labels = components(links(own, "text", width, total).union(repeated))
    placed = written(full.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    names = placed.groupBy("label").agg(F.min("key").alias("component_id"))
    joined = placed.join(names, "label").select("key", "n_shingles", "component_id")
    alone = nodes.where("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    return joined.union(alone).withColumnRenamed("key", key)


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """`docs` with one row of each component, that of the least key; of rows with this key
    the one with the least text. Rows without a key stay."""
    found = join(docs, key, text, width)
    firsts = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_first")).distinct()
    kept = docs.join(firsts, F.col(key) == F.col("_first"), "left_semi")
    place = F.row_number().over(Window.partitionBy(key).orderBy(text))
    kept = kept.withColumn("_place", place).where("_place = 1").drop("_place")
    return kept.union(docs.where(F.col(key).isNull()))
