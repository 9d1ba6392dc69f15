"""Feature screening: association tests, information value, correlation, selection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from bandwright.functions.columns import INF, chunks, count_if, finite, join_back, log_ratio, share, unpivot
from bandwright.functions.pvalues import chi2_tail_col, t_two_sided_col
from bandwright.operators.profile import medians
from bandwright.sources.session import written

BATCH = 100


# --- numeric columns against the target ---------------------------------------------------


def point_biserial_stats(
    df: DataFrame, target: str, columns: Sequence[str], fill: Mapping[str, float | None] | None = None
) -> DataFrame:
    """(variable, n, r, t): Pearson r of each null-to-median column with the 0/1 target."""
    fill = medians(df, columns) if fill is None else fill
    y = F.col(target).cast("double")
    out = None
    for batch in chunks(columns, BATCH):
        lines, aggregates = [], [F.count(y).alias("n"), F.stddev_pop(y).alias("sy")]
        for i, c in enumerate(batch):
            x = F.coalesce(F.col(c).cast("double"), F.lit(fill[c]))
            # corr() divides by zero on a constant column in ANSI mode.
            aggregates += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"s{i}")]
            r = F.try_divide(F.col(f"c{i}"), F.col(f"s{i}") * F.col("sy"))
            lines.append(F.struct(F.lit(c).alias("variable"), r.alias("r")))
        part = df.filter(y.isNotNull()).agg(*aggregates).select("n", F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    r = F.when(~F.isnan("r"), F.col("r"))
    t = F.when(F.abs(r) < 1, r * F.sqrt((F.col("n") - 2) / (1 - r * r))).otherwise(r * INF)
    return out.select("variable", "n", r.alias("r"), t.alias("t"))


def point_biserial(
    df: DataFrame, target: str, columns: Sequence[str], alpha: float = 0.05,
    fill: Mapping[str, float | None] | None = None,
) -> DataFrame:
    """Adds the two-sided p-value and `Reject H0` / `Accept H0`; accepted columns are dropped."""
    stats = point_biserial_stats(df, target, columns, fill)
    p = t_two_sided_col(F.coalesce("t", F.lit(float("nan"))), F.col("n") - 2)
    return _decide(stats.withColumn("p_value", p), alpha)


def _decide(stats: DataFrame, alpha: float) -> DataFrame:
    # A missing or NaN p-value is not <= alpha, so it accepts.
    known = F.col("p_value").isNotNull() & ~F.isnan("p_value")
    result = F.when(known & (F.col("p_value") <= alpha), "Reject H0").otherwise("Accept H0")
    return stats.withColumn("result", result)


# --- value counts shared by the categorical tests -----------------------------------------


def value_counts(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(variable, value, good, bad, n, present) for all columns in one unpivoted aggregate.

    `present` tells a value from null. It is an aggregate, so that filtering on it
    stays above the shuffle, which cells and their totals share.
    """
    present = F.max(F.col("value").isNotNull()).alias("present")
    parts = [
        tally(unpivot(df, [target], batch, "string").groupBy("variable", "value"), target, present)
        for batch in chunks(columns, BATCH)
    ]
    return reduce(DataFrame.unionByName, parts)


def tally(grouped: GroupedData, target: str, *more: Column) -> DataFrame:
    """Counts per group: good (y = 0), bad (y = 1) and n (all rows).

    `n` is the sum of its parts, so an aggregate read twice, once for cells and once
    for totals, keeps the same columns on both sides and is shuffled once.
    """
    y = F.col(target)
    counted = grouped.agg(
        count_if(y == 0).alias("good"), count_if(y == 1).alias("bad"),
        count_if(y.isNull() | ~y.isin(0, 1)).alias("unknown"), *more,
    )
    return counted.withColumn("n", F.col("good") + F.col("bad") + F.col("unknown")).drop("unknown")


# --- chi-square ---------------------------------------------------------------------------


def chi_square_stats(df: DataFrame, target: str, columns: Sequence[str], least: int = 5) -> DataFrame:
    """(variable, chi2, dof, evaluable); a cell under `least` makes it not evaluable.

    2x2 tables get Yates' correction: each |O - E| is cut by 1/2, at most to 0.
    """
    cells = value_counts(df, target, columns).filter(
        F.col("present") & (F.col("good") + F.col("bad") > 0)
    )
    totals = cells.groupBy("variable").agg(
        F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"),
        F.count(F.lit(1)).alias("levels"),
        F.min(F.least("good", "bad")).alias("smallest"),
    )
    # One row per screened column, a bound known from the schema.
    joined = join_back(cells, totals, ["variable"], broadcast=True)
    row, total = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
    yates = F.col("levels") == 2

    def cell(observed: str, column_total: str) -> Column:
        expected = F.try_divide((row * F.col(column_total)).cast("double"), total)
        gap = F.abs(F.col(observed) - expected)
        gap = F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.try_divide(gap * gap, expected)

    summed = joined.groupBy("variable").agg(
        F.sum(cell("good", "all_good") + cell("bad", "all_bad")).alias("chi2"),
        (F.first("levels") - 1).alias("dof"),
        (F.first("smallest") >= least).alias("evaluable"),
    )
    return summed.select(
        "variable", F.when(F.col("evaluable"), F.col("chi2")).alias("chi2"), "dof", "evaluable"
    )


def chi_square(
    df: DataFrame, target: str, columns: Sequence[str], alpha: float = 0.05, least: int = 5
) -> DataFrame:
    """Adds p-value and result; a column that is not evaluable accepts, hence is dropped."""
    stats = chi_square_stats(df, target, columns, least)
    p = F.when(
        F.col("evaluable"),
        chi2_tail_col(F.coalesce("chi2", F.lit(float("nan"))), F.col("dof")),
    )
    return _decide(stats.withColumn("p_value", p), alpha)


def dropped_by_test(tested: DataFrame) -> DataFrame:
    return tested.filter(F.col("result") == "Accept H0").select("variable")


# --- weight of evidence and information value ---------------------------------------------


def woe_table(
    df: DataFrame, target: str, columns: Sequence[str], null_as_level: bool = False
) -> DataFrame:
    """(variable, value, good, bad, dist_good, dist_bad, woe, iv) per value.

    The totals are those of the reports: bad counts rows with a value and y = 1,
    good is every other row, so rows without a value weigh in the good total.
    `null_as_level` gives the symmetric form with a level for nulls.
    """
    cells = value_counts(df, target, columns)
    if null_as_level:
        cells = cells.withColumn("value", F.coalesce("value", F.lit("null")))
        totals = cells.groupBy("variable").agg(
            F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")
        )
    else:
        seen_bad = F.sum(F.when(F.col("present"), F.col("bad")).otherwise(0))
        totals = cells.groupBy("variable").agg(
            (F.sum("n") - seen_bad).alias("all_good"), seen_bad.alias("all_bad")
        )
        # No group is empty; naming `n` keeps both sides of the join on one shuffle.
        cells = cells.filter(F.col("present") & (F.col("n") > 0))
    return _weigh(cells, totals, ["variable", "value"])


def banded_woe_table(df: DataFrame, target: str, columns: Sequence[str], q: int = 10) -> DataFrame:
    """(variable, band, ...) over `q` equal-width bands; empty bands are absent, nulls ignored."""
    clean = df.select(target, *[finite(c).alias(c) for c in columns])
    edges = equal_width_edges(clean, columns, q)
    inner = [f"__e{i}" for i in range(1, q)]
    rows = [(c, *e[1:-1]) for c, e in edges.items() if e]
    shape = ", ".join(["variable string", *[f"{name} double" for name in inner]])
    # One row per screened column, a bound known from the schema. Looking the edges
    # up per long row keeps the generated code small however many columns there are.
    lookup = F.broadcast(df.sparkSession.createDataFrame(rows, shape))
    long = unpivot(clean.filter(F.col(target).isNotNull()), [target], columns, "double")
    band = reduce(add, [(F.col("value") > F.col(name)).cast("int") for name in inner], F.lit(1))
    banded = long.filter(F.col("value").isNotNull()).join(lookup, "variable")
    cells = tally(banded.groupBy("variable", band.alias("band")), target)
    totals = cells.groupBy("variable").agg(
        F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")
    )
    return _weigh(cells, totals, ["variable", "band"])


def _weigh(cells: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    # One row per screened column, a bound known from the schema.
    joined = join_back(cells, totals, ["variable"], broadcast=True)
    dist_good, dist_bad = share(F.col("good"), F.col("all_good")), share(F.col("bad"), F.col("all_bad"))
    out = joined.select(*keys, "good", "bad", dist_good.alias("dist_good"), dist_bad.alias("dist_bad"))
    out = out.withColumn("woe", log_ratio(F.col("dist_good"), F.col("dist_bad")))
    return out.withColumn(
        "iv",
        F.coalesce(F.col("woe") * (F.col("dist_good") - F.col("dist_bad")), F.lit(0.0)),
    )


def information_value(table: DataFrame) -> DataFrame:
    """(variable, iv) summed from either table, largest first."""
    return table.groupBy("variable").agg(F.sum("iv").alias("iv")).orderBy(F.desc("iv"), "variable")


def equal_width_edges(df: DataFrame, columns: Sequence[str], q: int) -> dict[str, list[float]]:
    """q + 1 edges per column from its finite range (O(columns) values)."""
    ranges: dict[str, tuple] = {}
    for batch in chunks(columns, BATCH):
        row = df.agg(
            *[F.min(finite(c)).alias(f"l{i}") for i, c in enumerate(batch)],
            *[F.max(finite(c)).alias(f"h{i}") for i, c in enumerate(batch)],
        ).first()
        ranges |= {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(batch)}
    return {c: cut_range(*ranges[c], q) if ranges[c][0] is not None else [] for c in columns}


def cut_range(low: float, high: float, q: int) -> list[float]:
    """Evenly spaced edges; the first is moved down a little so that the minimum is inside."""
    if low == high:
        pad = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - pad, high + pad
        return [low + i * ((high - low) / q) for i in range(q + 1)]
    edges = [low + i * ((high - low) / q) for i in range(q + 1)]
    edges[0] -= (high - low) * 0.001
    edges[-1] = high
    return edges


# --- correlation between features ---------------------------------------------------------


# Columns of a block: a task holds the products of two blocks.
GRAM_COLUMNS = 1_000


def correlation_pairs(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """(col_a, col_b, abs_r) for every unordered pair, in the order of `columns`.

    Missing and infinite values are filled first. A constant column has no correlation
    (null). Two passes: means and ranges, of which one number for each column reaches the
    driver, then the products about the means. Each task sums its own products as a matrix,
    for one pair of column blocks at a time, and gives them out as rows; sums and pairs
    stay on the executors.
    """
    filled = df.select(*[F.coalesce(finite(c), F.lit(fill)).alias(c) for c in columns])
    means, constant = {}, set()
    for batch in chunks(columns, 200):
        row = filled.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(batch) for n, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
        for i, c in enumerate(batch):
            means[c] = row[f"m{i}"] or 0.0
            if row[f"lo{i}"] == row[f"hi{i}"]:
                constant.add(c)
    blocks = list(chunks(list(columns), GRAM_COLUMNS))
    parts = [
        _products(filled, left, right, means, i * GRAM_COLUMNS, j * GRAM_COLUMNS)
        for i, left in enumerate(blocks) for j, right in enumerate(blocks) if i <= j
    ]
    products = reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(F.sum("g").alias("g"))
    products = written(products, "products")
    own = products.filter("i = j").select("i", F.col("g").alias("own"))
    names = df.sparkSession.createDataFrame(
        [(i, c, c in constant) for i, c in enumerate(columns)], "i long, name string, flat boolean")
    known = names.join(own, "i")
    a, b = (known.select(
        F.col("i").alias(k), F.col("name").alias(f"col_{n}"), F.col("own").alias(f"own_{n}"), F.col("flat").alias(f"flat_{n}"))
        for k, n in (("i", "a"), ("j", "b")))
    varied = ~F.col("flat_a") & ~F.col("flat_b") & (F.col("own_a") > 0) & (F.col("own_b") > 0)
    r = F.least(F.abs(F.col("g")) / F.sqrt(F.col("own_a")) / F.sqrt(F.col("own_b")), F.lit(1.0))
    return products.filter("i < j").join(a, "i").join(b, "j").select("col_a", "col_b", F.when(varied, r).alias("abs_r"))


def _products(
    df: DataFrame, left: Sequence[str], right: Sequence[str], means: dict[str, float], first: int, second: int,
) -> DataFrame:
    """(i, j, g): each task's sums of products about the means, on and above the diagonal."""
    used = list(dict.fromkeys([*left, *right]))
    shift = np.array([means[c] for c in used])
    rows, cols = [used.index(c) for c in left], [used.index(c) for c in right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(rows), len(cols)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            total += x[:, rows].T @ x[:, cols]
        i, j = np.meshgrid(np.arange(len(rows)) + first, np.arange(len(cols)) + second, indexing="ij")
        upper = i <= j
        yield pa.RecordBatch.from_arrays([pa.array(v[upper]) for v in (i, j, total)], ["i", "j", "g"])

    return df.select(*used).mapInArrow(run, "i long, j long, g double")


# --- selection rule -----------------------------------------------------------------------


def select_features(
    sparse: DataFrame | None = None,
    tests: Sequence[tuple[str, DataFrame]] = (),
    iv: DataFrame | None = None,
    least_iv: float = 0.02,
    correlation: DataFrame | None = None,
    most_correlation: float = 0.8,
    importance: DataFrame | None = None,
    least_importance: float = 0.0,
    exclude: Sequence[str] = (),
    include: Sequence[str] = (),
) -> DataFrame:
    """(variable, reason) for every column to drop, one row per rule that hit.

    `tests` are (reason, frame with `variable`) lists of rejected columns, for
    example from the association tests or the all-relevant search. Of a pair
    correlated beyond `most_correlation` the member with the lower IV goes (the
    later name on equal IV). `exclude` always drops; `include` always stays.
    """
    spark = None
    parts: list[DataFrame] = []

    def add(frame: DataFrame, reason: str) -> None:
        parts.append(frame.select("variable", F.lit(reason).alias("reason")))

    if sparse is not None:
        add(sparse.filter("drop"), "sparse")
    for reason, frame in tests:
        add(frame, reason)
    if iv is not None:
        add(iv.filter(F.col("iv") < least_iv), "low_iv")
    if correlation is not None and iv is not None:
        a = iv.select(F.col("variable").alias("col_a"), F.col("iv").alias("iv_a"))
        b = iv.select(F.col("variable").alias("col_b"), F.col("iv").alias("iv_b"))
        pairs = correlation.filter(F.col("abs_r") > most_correlation).join(a, "col_a").join(b, "col_b")
        later = F.greatest("col_a", "col_b")
        weaker = (
            F.when(F.col("iv_a") < F.col("iv_b"), F.col("col_a"))
            .when(F.col("iv_b") < F.col("iv_a"), F.col("col_b"))
            .otherwise(later)
        )
        add(pairs.select(weaker.alias("variable")).distinct(), "correlated")
    if importance is not None:
        add(importance.filter(F.col("importance") <= least_importance), "low_importance")
    if exclude:
        spark = parts[0].sparkSession if parts else None
        if spark is None:
            raise ValueError("explicit exclusions need at least one screening result")
        add(spark.createDataFrame([(c,) for c in exclude], "variable string"), "excluded")
    out = reduce(DataFrame.unionByName, parts)
    return out.filter(~F.col("variable").isin(*include)) if include else out
