"""Running totals per key at any size, in as many levels of ranges as needed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwright.sources.session import written

#: Rows that one range holds, so that a window's task is bounded.
RANGE_ROWS = 250_000


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, str], rows: int | None = None,
) -> DataFrame:
    """`df` with, for each output of `totals`, the sum of its column up to and with the row.

    (keys, order) should be unique; equal places of a key count in any order. A table of
    more than `rows` rows is sorted into ranges of about that many; the ranges' own sums
    are a table of one row for each range and key, whose running totals are taken in the
    same way, until one range holds a level. Nothing but counts of rows reaches the driver.
    """
    rows = max(rows or RANGE_ROWS, 4)
    at = f"{order}_" if order.startswith("_range") else "_range"
    keys = list(keys)
    df = written(df, "totals")
    parts = -(-df.count() // rows)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if parts <= 1:
        return df.withColumns({out: F.sum(c).over(upto) for out, c in totals.items()})
    cut = df.repartitionByRange(parts, *keys, order).withColumn(at, F.spark_partition_id())
    cut = written(cut, "ranges")
    sums = cut.groupBy(*keys, at).agg(*[F.sum(c).alias(f"_sum_{out}") for out, c in totals.items()])
    # A key inside one range needs nothing from above, so that a level has two rows for each range at most.
    split = sums.withColumn("_ranges", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_ranges > 1").drop("_ranges")
    above = running_totals(split, keys, at, {f"_upto_{out}": f"_sum_{out}" for out in totals}, rows)
    before = above.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(at).alias("_r"),
        *[(F.col(f"_upto_{out}") - F.col(f"_sum_{out}")).alias(f"_before_{out}") for out in totals])
    inside = Window.partitionBy(*keys, at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(at) == F.col("_r"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    joined = cut.join(before, same, "left")
    return joined.select(
        *df.columns,
        *[(F.coalesce(f"_before_{out}", F.lit(0)) + F.sum(c).over(inside)).alias(out) for out, c in totals.items()])
