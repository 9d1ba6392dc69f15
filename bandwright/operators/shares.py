"""Shares of categorical values within a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.functions.columns import chunks, join_back, share, unpivot

# Value columns that one aggregate of a wide table makes.
WIDE_BLOCK = 500


def cohort_shares(df: DataFrame, cohort: str, columns: Sequence[str]) -> DataFrame:
    """(cohort, variable, value, n, pct) with pct over the cohort's non-null values.

    One unpivoted job for all variables. Null values and null cohorts are left
    out, as in a crosstab.
    """
    return with_share(cohort_counts(df, cohort, columns), [cohort, "variable"])


def cohort_counts(df: DataFrame, cohort: str, columns: Sequence[str]) -> DataFrame:
    """(cohort, variable, value, n): what the shares are made of. Counts of disjoint rows add up."""
    long = unpivot(df.filter(F.col(cohort).isNotNull()), [cohort], columns, "string")
    known = long.filter(F.col("value").isNotNull())
    return known.groupBy(cohort, "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def with_share(tally: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `pct` of `n` within `keys`.

    Totals come from a second aggregate and a join, so a variable with very many
    values is never gathered into one window partition.
    """
    totals = tally.groupBy(*keys).agg(F.sum("n").alias("__total"))
    joined = join_back(tally, totals, keys)
    return joined.select(*tally.columns, (share(F.col("n"), F.col("__total")) * 100).alias("pct"))


def wide_shares(
    shares: DataFrame, cohort: str, variable: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Cohort rows by value columns for one variable; absent pairs are null.

    Any number of values: blocks of conditional aggregates, joined by cohort. Without
    `values` the distinct ones are found first, as many as the result has columns. Each block
    reads only its own values' shares.
    """
    one = shares.filter(F.col("variable") == variable)
    if values is None:
        values = sorted(row["value"] for row in one.select("value").distinct().collect())
    out = one.select(cohort).distinct()
    for block in chunks(list(dict.fromkeys(values)), WIDE_BLOCK):
        cells = [F.max(F.when(F.col("value") == v, F.col("pct"))).alias(v) for v in block]
        part = one.filter(F.col("value").isin(block)).groupBy(cohort).agg(*cells)
        out = out.join(part, cohort, "left")
    return out


def class_cube(df: DataFrame, cohort: str, columns: Sequence[str]) -> DataFrame:
    """Row counts per cohort and class for many class columns; nulls are kept."""
    out = None
    for batch in chunks(columns, 200):
        long = unpivot(df, [cohort], batch, "string", value="class")
        part = long.groupBy(cohort, "variable", "class").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
