"""Column profiles: missing and zero shares, summaries and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.functions.columns import chunks, count_if, finite, numeric_columns, share, unpivot
from bandwright.operators.quantiles import exact_quantiles

# Columns per aggregate: wide enough to keep the number of scans low, small
# enough for the generated code. Each batch reads only its own parquet columns.
BATCH = 200


def sparse_profile(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95
) -> DataFrame:
    """(variable, rows, missing, zeros, share, drop), nulls and zeros in one pass.

    Zeros are counted for numeric columns only and are null for the others.
    """
    columns = list(df.columns) if columns is None else list(columns)
    numeric = set(numeric_columns(df))
    out = None
    for batch in chunks(columns, BATCH):
        aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(batch):
            aggregates.append(count_if(F.col(c).isNull()).alias(f"m{i}"))
            if c in numeric:
                aggregates.append(count_if(F.col(c) == 0).alias(f"z{i}"))
        lines = [
            F.struct(
                F.lit(c).alias("variable"),
                F.col(f"m{i}").alias("missing"),
                (F.col(f"z{i}") if c in numeric else F.lit(None).cast("bigint")).alias("zeros"),
            )
            for i, c in enumerate(batch)
        ]
        part = df.agg(*aggregates).select("rows", F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    sparse = share(F.col("missing") + F.coalesce(F.col("zeros"), F.lit(0)), F.col("rows"))
    return out.select(
        "variable", "rows", "missing", "zeros", sparse.alias("share"),
        F.coalesce(sparse > threshold, F.lit(False)).alias("drop"),
    )


def sparse_names(profile: DataFrame) -> list[str]:
    """Names marked for dropping: O(columns) values."""
    return [r["variable"] for r in profile.filter("drop").select("variable").collect()]


def drop_sparse(df: DataFrame, threshold: float = 0.95, keep: Sequence[str] = ()) -> DataFrame:
    names = sparse_names(sparse_profile(df, [c for c in df.columns if c not in keep], threshold))
    return df.drop(*names)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact column medians as literals: one value per column."""
    rows = exact_quantiles(df, columns, [0.5]).collect()
    return {r["variable"]: r["quantiles"][0] if r["quantiles"] else None for r in rows}


def numeric_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max per group and column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by)
    out = None
    for batch in chunks(columns, BATCH // 4):
        aggregates, lines = [], []
        for i, c in enumerate(batch):
            x = finite(c)
            aggregates += [
                F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"),
            ]
            lines.append(
                F.struct(
                    F.lit(c).alias("variable"), F.col(f"n{i}").alias("n"),
                    F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                    F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
                )
            )
        part = df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    q = quartiles.drop("n")
    keys = [*by, "variable"]
    joined = out.join(q, [out[k].eqNullSafe(q[k]) for k in keys], "left")
    return joined.select(
        *[out[k] for k in keys], "n", "mean", "std", "min",
        F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"), "max",
    )


def boxplot_stats(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], reach: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers (furthest value within `reach` IQR) and outlier counts.

    The box of each group is report-sized and meets the rows as one wide row per
    group, so the second pass aggregates every column without unpivoting.
    """
    boxes = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by)
    keys = [*by, "variable"]
    narrow = df.select(*by, *[finite(c).alias(c) for c in columns])
    rows = unpivot(narrow, by, columns, "double").filter(F.col("value").isNotNull())
    # Collapse rows to distinct values first: ties and integer scores shrink map-side,
    # and the join with the boxes meets the smaller side.
    tied = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("m"))
    joined = tied.join(boxes, [tied[k].eqNullSafe(boxes[k]) for k in keys])
    q1, q2, q3 = (F.col("quantiles")[i] for i in range(3))
    low, high = q1 - (q3 - q1) * reach, q3 + (q3 - q1) * reach
    x = F.col("value")
    inside = x.between(low, high)
    return joined.groupBy(*[tied[k] for k in keys]).agg(
        F.sum("m").alias("n"), F.first(q1).alias("q1"), F.first(q2).alias("median"),
        F.first(q3).alias("q3"), F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("m"))), F.lit(0)).alias("outliers"),
    )


def filtered_median(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Median of a subset, such as the stand-in score below a cut."""
    q = exact_quantiles(df.filter(condition), [column], [0.5])
    return q.select("variable", F.col("quantiles")[0].alias("median"), "n")
