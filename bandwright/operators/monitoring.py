"""Baseline against production: class distributions by cohort and stability index."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions.banding import Bands, Groups, with_classes
from bandwright.functions.columns import share
from bandwright.operators.panel import cohort_label, cohort_of, eligible, exclude
from bandwright.operators.shares import cohort_counts, cohort_shares, with_share

# Share standing in for an empty class.
EPSILON = 1e-4


def baseline_frame(
    scored: DataFrame, rules: Sequence[tuple], specs: Sequence[Bands | Groups], cohort: str,
    oot: str, output: str = "safra",
) -> DataFrame:
    """Scored base without production exclusions, labelled by cohort, with classes."""
    kept = eligible(exclude(scored, rules, "__reason"), "__reason").drop("__reason")
    return with_classes(kept.withColumn(output, cohort_label(cohort, oot)), specs)


def production_frame(
    variables: DataFrame, score_log: DataFrame, keys: Sequence[str], score: str, stamp: str,
    start: str, specs: Sequence[Bands | Groups], output: str = "safra", until: str | None = None,
) -> DataFrame:
    """Production variables with their logged score: score > 1, from `start` to before `until`, monthly cohort.

    The score filter discards unmatched rows, so Catalyst may turn the left join
    into an inner one; the date filter sits on a join key and reaches both scans.
    """
    joined = variables.join(score_log, list(keys), "left")
    recent = joined.filter((F.col(score) > 1) & (F.col(stamp) >= start))
    if until is not None:
        recent = recent.filter(F.col(stamp) < until)
    return with_classes(recent.withColumn(output, cohort_of(stamp)), specs)


def append_frames(baseline: DataFrame, production: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Baseline rows followed by production rows; a column one side lacks is null there."""
    def present(df: DataFrame) -> DataFrame:
        return df.select(*[c for c in columns if c in df.columns])

    return present(baseline).unionByName(present(production), allowMissingColumns=True)


def class_distribution(frame: DataFrame, cohort: str, classes: Sequence[str]) -> DataFrame:
    """(cohort, variable, value, n, pct) of every class column."""
    return cohort_shares(frame, cohort, classes)


def record_counts(frame: DataFrame, path: str, batch: str, cohort: str, classes: Sequence[str]) -> None:
    """Counts the classes of a batch of rows and keeps them in the table of counts at `path`.

    A batch is a delivery of rows, such as a month; counts of several batches add up, so a
    late delivery for an earlier cohort comes as a batch of its own. A batch recorded again
    takes the place of its former self as a whole, cohorts that it no longer has included.
    Only `frame` is read. Rows without a cohort, and null classes, are left out.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"batch {batch!r}: letters, digits, dot, hyphen and underscore only")
    counted = cohort_counts(frame, cohort, classes).select("variable", "value", "n", F.col(cohort).cast("string").alias(cohort))
    counted.hint("rebalance", cohort).write.mode("overwrite").partitionBy(cohort).parquet(f"{path}/batch={batch}")


def recorded_distribution(spark: SparkSession, path: str, cohort: str) -> DataFrame:
    """(cohort, variable, value, n, pct) from the table of counts; no rows are read again."""
    kept = spark.read.schema(f"variable string, value string, n bigint, batch string, `{cohort}` string").parquet(path)
    merged = kept.groupBy(cohort, "variable", "value").agg(F.sum("n").alias("n"))
    return with_share(merged, [cohort, "variable"])


def stability_index(
    distribution: DataFrame, cohort: str, baseline: str, epsilon: float = EPSILON
) -> DataFrame:
    """(cohort, variable, psi) of every cohort against `baseline`.

    Sum of (p - q) ln(p / q) over the classes of either side; an empty class
    counts as `epsilon`. Works on the distribution, never on rows.
    """
    based = distribution.filter(F.col(cohort) == baseline).select(
        "variable", "value", F.col("n").alias("base_n")
    )
    others = distribution.filter(F.col(cohort) != baseline).select(cohort, "variable", "value", "n")
    # Every (cohort, variable) is compared on the union of its classes and the baseline's.
    pairs = others.select(cohort, "variable").distinct().join(based, "variable")
    both = pairs.join(others, [cohort, "variable", "value"], "full").select(
        cohort, "variable", "value", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("base_n", F.lit(0)).alias("base_n"),
    )
    keys = [cohort, "variable"]
    totals = both.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.sum("base_n").alias("all_base"))
    joined = both.join(totals, keys)
    p = F.greatest(share(F.col("n"), F.col("all_n")), F.lit(epsilon))
    q = F.greatest(share(F.col("base_n"), F.col("all_base")), F.lit(epsilon))
    return joined.groupBy(*keys).agg(F.sum((p - q) * F.ln(p / q)).alias("psi"))
