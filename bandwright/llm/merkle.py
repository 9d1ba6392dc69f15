"""Merkle manifest of a table: leaves, a tree for each source, one root, proofs and their check.

A leaf is the SHA-256 of the row's fields, each written as its length in bytes, a colon and
the value, or as a dash for a null. The leaves of a source ascend by key; every run of
FAN consecutive nodes becomes the hash of its digests until one node remains, the subroot.
The subroots, ordered by source, become the root in the same way.

* **Rank.** The leaves are sorted in ranges of (source, key, leaf, place in the scan), so
  that a hot source, or a row repeated many times, is dealt over many tasks. Counts of
  source by range give each leaf its rank.
* **Roll up.** The rank's lowest digits name a place inside a block of FAN ** DIGITS
  consecutive leaves. The digit columns are grouped away one after the other: each step
  nests the child structs of up to FAN nodes and hashes their digests. All steps of a block
  keep the partitioning by (source, block), so the leaves move once. A block's row is
  bounded; its digest is a leaf of the next round, until each source has one node. The
  number of rounds is the logarithm of the longest source to base FAN ** DIGITS.
* **Proofs.** One nested transform walks a block's structs downwards, growing the list of
  siblings (what stands left and right of the path, level by level), and an explode gives a
  row for each leaf. No level and no leaf is joined. Only between two rounds the path above a
  block, one row for a block of leaves, reaches the block's row by its key.
* **Check.** A changed leaf is folded with the siblings of the original one.

Null sources are a source of their own and come first; null keys come first; rows with
equal keys are ordered by their leaf, equal rows in any order (their digests are equal).
Null texts differ from empty ones. An empty table has no leaves and gives no rows. Text
of any length is hashed as a whole; extra columns are not part of a leaf and are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwright.sources.session import written

FAN = 3
DIGITS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The part of monotonically_increasing_id that counts the rows of a partition.
ROWS = (1 << 33) - 1
_NO_PATH = "array<struct<left string, right string>>"


def field(column: Column) -> Column:
    """A value's length in bytes, a colon and the value; a dash for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def leaves(docs: DataFrame, tampered: Column, key: str = "doc_id", group: str = "source",
           text: str = "text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Key, group, leaf and, where it differs, the leaf with `tampered` for its text, as a table.

    The texts are read once; what follows works on digests.
    """
    changed = leaf([tampered if c == text else F.col(c) for c in fields])
    own = leaf([F.col(c) for c in fields])
    rows = docs.select(
        F.col(key).alias("key"), F.col(group).alias("group"), own.alias("leaf"), changed.alias("tampered"),
        F.monotonically_increasing_id().alias("place"),
    )
    kept = rows.withColumn("tampered", F.nullif("tampered", "leaf"))
    return written(kept, "leaves")


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` with `rank` (from 0, inside each group by `order`) and `n`, the group's rows.

    Written by sorted ranges; the window below sees one row for each range of a group.
    """
    order = [group, *order]
    ranges = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("range", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(ROWS)),
        "ranges",
    )
    counts = ranges.groupBy(group, "range").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_group"), F.col("range").alias("_range"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("_offset"),
        F.sum("rows").over(whole).alias("n"),
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("range") == F.col("_range"))
    joined = ranges.join(offsets, same)
    return joined.withColumn("rank", F.col("row") + F.col("_offset")).drop("_group", "_range", "_offset", "range", "row")


def _hashed(children: str) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256)


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Blocks of (group, rank, n, digest, ...): the digit columns of the rank grouped away.

    The result has group, rank (of the block), n (of blocks), digest, and the block's nodes
    nested in `tree`.
    """
    block = FAN**DIGITS
    digits = [f"d{i}" for i in range(DIGITS)]
    payload = [c for c in nodes.columns if c not in ("group", "rank", "n")]
    level = nodes.select(
        "group", F.floor(F.col("rank") / block).alias("block"), "n",
        *[(F.floor(F.col("rank") / FAN**i) % FAN).cast("tinyint").alias(d) for i, d in enumerate(digits)],
        F.struct(*payload).alias("node"),
    ).repartition("group", "block")
    for i, digit in enumerate(digits):
        kept = ["group", "block", "n", *digits[i + 1:]]
        level = level.groupBy(*kept).agg(F.sort_array(F.collect_list(F.struct(digit, "node"))).alias("run"))
        children = F.transform("run", lambda c: c["node"])
        level = level.withColumn("children", children).drop("run")
        # A group that has come down to one node is not hashed any further.
        alone = F.col("children")[0]["digest"]
        digest = F.when(F.col("n") > FAN**i, _hashed("children")).otherwise(alone)
        level = level.select(*kept, F.struct(digest.alias("digest"), "children").alias("node"))
    return level.select(
        "group", F.col("block").alias("rank"), F.ceil(F.col("n") / block).alias("n"),
        F.col("node.digest").alias("digest"), F.col("n").alias("below"), F.col("node").alias("tree"),
    )


def _steps(n: Column, node: Column, path: Column, height: int) -> Column:
    """The nodes at the foot of `node`, each with the path from it up to where `path` starts."""

    def child(own: Column, i: Column) -> Column:
        digests = F.transform(node["children"], lambda c: c["digest"])
        beside = F.struct(
            F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"),
            F.array_join(F.slice(digests, i + 2, F.lit(FAN)), "").alias("right"),
        )
        longer = F.when(n > FAN ** (height - 1), F.concat(F.array(beside), path)).otherwise(path)
        if height == 1:
            return F.array(F.struct(own.alias("node"), longer.alias("path")))
        return _steps(n, own, longer, height - 1)

    return F.flatten(F.transform(node["children"], child))


def unrolled(blocks: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row for each node of blocks with `tree`, `below` and the `path` above them: group, node, path, carried."""
    feet = _steps(F.col("below"), F.col("tree"), F.col("path"), DIGITS)
    return blocks.select("group", *carried, F.explode(feet).alias("foot")).select("group", *carried, "foot.node.*", "foot.path")


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks over (group, rank, n, digest, ...), the last with one block for each group."""
    rounds = []
    while True:
        blocks = written(rolled_up(nodes), "blocks")
        rounds.append(blocks)
        if (blocks.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds
        nodes = blocks.select("group", "rank", "n", "digest", F.col("rank").alias("at"))


def _proved(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every node under the rounds' blocks, its path prolonged by that of `above` for its group.

    Further columns of `above` reach every node of the group.
    """
    carried = [c for c in above.columns if c not in ("group", "path")]
    found = above.withColumn("at", F.lit(0))
    for blocks in reversed(rounds):
        paths = found.select(F.col("group").alias("_group"), F.col("at").alias("_at"), "path", *carried)
        same = F.col("group").eqNullSafe(F.col("_group")) & (F.col("rank") == F.col("_at"))
        found = unrolled(blocks.join(paths, same), carried)
    return found


def manifest(rows: DataFrame) -> DataFrame:
    """`leaves` with their proofs: group, key, digest (the leaf), tampered, subroot, root and path.

    The path holds, for each level up to the root, what stands left and right of the leaf's
    own branch.
    """
    nodes = ranked(rows, "group", ["key", "leaf", "place"]).withColumnRenamed("leaf", "digest").drop("place")
    own = _grown(nodes)
    subroots = own[-1].select(F.lit(0).alias("all"), F.col("group").alias("source"), "digest")
    upper = _grown(ranked(subroots, "all", ["source"]).withColumnRenamed("all", "group"))
    top = upper[-1].select("group", F.col("digest").alias("root"), F.array().cast(_NO_PATH).alias("path"))
    paths = _proved(upper, top).select(F.col("source").alias("group"), F.col("digest").alias("subroot"), "root", "path")
    return _proved(own, written(paths, "subroots"))


def siblings(path: Column) -> Column:
    """The digests beside a path, bottom up and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings on its path."""
    return F.aggregate(path, own, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def prove(docs: DataFrame, tampered: Column, key: str = "doc_id", group: str = "source",
          text: str = "text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row for each row of `docs`: key, leaf, subroot, root, path, folded_root and verified.

    `tampered` is the text as it is found when the manifest is checked.
    """
    proved = manifest(leaves(docs, tampered, key, group, text, fields))
    refolded = folded(F.coalesce("tampered", "digest"), F.col("path"))
    return proved.select(
        F.col("key").alias(key), F.col("group").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "path",
        refolded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
