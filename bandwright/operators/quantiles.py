"""Exact linear-interpolation quantiles at any size and for any number of groups.

One aggregate sketches every group and brackets each wanted rank between two values of the
sketch; its error is bounded, so the bracket always holds the rank. A second pass counts, for
each bracket, the values below it and how often each value inside occurs. Running totals
over these counts then find the exact values. Brackets are a table that the values are
joined with; nothing about groups or values reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.functions.columns import INF, finite, join_back, unpivot
from bandwright.operators.running import running_totals
from bandwright.sources.session import written

# Of a group of more than SKETCH values a bracket holds about SLACK * 2 / SKETCH; the error
# of the sketch is a tenth of 1 / SKETCH. Smaller groups are counted whole.
SKETCH = 10_000
SLACK = 2


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """(by..., variable, quantiles array, n) over the finite values of each column.

    Groups without a value have null quantiles and n = 0. `rows` bounds the counted values in
    one range of the running totals.
    """
    by, probabilities = list(by), [float(p) for p in probabilities]
    keys = [*by, "variable"]
    narrow = df.select(*by, *[finite(c).alias(c) for c in columns])
    values = unpivot(narrow, by, columns, "double")
    brackets = written(_brackets(values, keys, probabilities), "brackets")
    counted = _counted(values.filter(F.col("value").isNotNull()), brackets, keys)
    placed = running_totals(counted, [*keys, "slot"], "value", {"upto": "m"}, rows)
    at = (F.col("n") - 1) * F.col("p")
    # The row that counts what lies below has no value, and never reaches a wanted rank.
    picked = placed.groupBy(*keys, "slot", "p", "n").agg(
        F.min(F.when(F.col("upto") > F.floor(at), F.col("value"))).alias("a"),
        F.min(F.when(F.col("upto") > F.ceil(at), F.col("value"))).alias("b"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))
    lists = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", value.alias("v")))).alias("found"))
    whole = brackets.select(*keys, "n")
    found = lists.select(*[F.col(k).alias(f"_{k}") for k in keys], F.transform("found", lambda s: s["v"]).alias("quantiles"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return whole.join(found, same, "left").select(*keys, "quantiles", "n")


def _brackets(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(keys..., n, brackets): for each probability the values between which its rank lies."""
    ends = [(p - SLACK / SKETCH, p + SLACK / SKETCH) for p in probabilities]
    inner = sorted({e for pair in ends for e in pair if 0 < e < 1})
    place = {e: i for i, e in enumerate(inner)}
    sketch = F.percentile_approx("value", inner, SKETCH * 10) if inner else F.lit(None).cast("array<double>")
    sized = values.groupBy(*keys).agg(F.count("value").alias("n"), sketch.alias("_s"))

    def end(e: float, beyond: float) -> Column:
        known = F.col("_s")[place[e]] if e in place else F.lit(beyond)
        return F.when(F.col("n") > SKETCH, known).otherwise(F.lit(beyond))

    parts = [
        F.struct(F.lit(i).alias("slot"), F.lit(p).alias("p"), end(lo, -INF).alias("lo"), end(hi, INF).alias("hi"))
        for i, (p, (lo, hi)) in enumerate(zip(probabilities, ends))
    ]
    return sized.select(*keys, "n", F.array(*parts).alias("brackets"))


def _counted(values: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., slot, p, n, value, m): how often each value inside a bracket occurs; without
    a value, how many lie below."""
    # A generator and plain columns: functions over arrays run uncompiled, once for every value.
    beside = join_back(values, brackets, keys).select(*keys, "n", "value", F.explode("brackets").alias("_b"))
    reached = beside.filter(F.col("value") <= F.col("_b.hi"))
    inside = F.when(F.col("value") >= F.col("_b.lo"), F.col("value"))
    each = reached.select(*keys, "n", "_b.slot", "_b.p", inside.alias("value"))
    return each.groupBy(*keys, "slot", "p", "n", "value").agg(F.count(F.lit(1)).alias("m"))
