"""Population build: star joins, latest or first rows, waterfalls and samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.operators import skew


@dataclass(frozen=True)
class Satellite:
    """A feature table for the star join.

    `keep` names the feature columns (all non-key columns by default). The table
    must be unique on `keys`; pass it through `first_per_key` otherwise. `salt`
    spreads a known hot key: the base is split over that many sub-keys and the
    satellite repeated for each, so no task receives the whole key. With "auto" a pass
    over the base's keys finds the heavy ones, and only these are spread; rows without
    a whole key are dealt over the tasks too.
    """

    frame: DataFrame
    keys: tuple[str, ...]
    keep: tuple[str, ...] | None = None
    salt: int | Literal["auto"] | None = None


def star_assembly(base: DataFrame, satellites: Sequence[Satellite]) -> DataFrame:
    """Left-join every satellite, projected to its keys and kept columns first.

    Consecutive satellites on the same keys share the base's shuffle; AQE splits
    skewed base partitions, which is legal as the base is the outer side.
    """
    out = base
    for (keys, salt), group in groupby(satellites, lambda s: (tuple(s.keys), s.salt)):
        rights = [_projected(s) for s in group]
        if salt == "auto":
            out = _spread(base, out, rights, list(keys))
            continue
        for right in rights:
            if salt:
                out = _salted(out, right, list(keys), salt)
            else:
                out = out.join(right, on=list(keys), how="left")
    return out


def _projected(s: Satellite) -> DataFrame:
    keep = s.keep if s.keep is not None else [c for c in s.frame.columns if c not in s.keys]
    return s.frame.select(*s.keys, *keep)


def _spread(base: DataFrame, out: DataFrame, rights: list[DataFrame], keys: list[str]) -> DataFrame:
    # Keys that the base itself has are counted there, without the joins so far.
    source = base if set(keys) <= set(base.columns) else out
    kinds = [skew.common_kinds(out, right, keys) for right in rights]
    if all(k is not None and k == kinds[0] for k in kinds):
        heavy = skew.find_heavy(source, keys, kinds[0])
        if heavy:
            return skew.spread_left_join(out, rights, keys, kinds[0], heavy)
    return reduce(lambda left, right: left.join(right, on=keys, how="left"), rights, out)


def _salted(base: DataFrame, right: DataFrame, keys: list[str], salt: int) -> DataFrame:
    # The salt hashes the whole row, so a retried task deals the same sub-keys.
    left = base.withColumn("__salt", F.pmod(F.xxhash64(*base.columns), F.lit(salt)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(copies, on=[*keys, "__salt"], how="left").drop("__salt")


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the smallest by `order`, ties broken by the kept columns.

    An aggregate over structs, not a window: map-side combine reduces a hot key
    to one row per task before the shuffle.
    """
    keep = [c for c in df.columns if c not in keys] if keep is None else list(keep)
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in keep if c not in order])
    best = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return best.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in keep])


def latest_per_key(
    df: DataFrame, keys: Sequence[str], at: str, keep: Sequence[str]
) -> DataFrame:
    """The kept columns of each key's newest row; ties on `at` take the largest values."""
    best = df.groupBy(*keys).agg(F.max(F.struct(at, *keep)).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in keep])


def first_match(rules: Sequence[tuple[str, Column]]) -> Column:
    """Flat ordered CASE: the label of the first rule that is true, null if none.

    A null condition is not true, so the row falls through to the next rule.
    """
    (label, condition), *rest = rules
    return reduce(lambda case, r: case.when(r[1], r[0]), rest, F.when(condition, label))


def exclude(df: DataFrame, rules: Sequence[tuple[str, Column]], output: str) -> DataFrame:
    return df.withColumn(output, first_match(rules))


def eligible(df: DataFrame, reason: str) -> DataFrame:
    """Rows without an exclusion reason."""
    return df.filter(F.col(reason).isNull())


def out_of_scope(
    df: DataFrame, tenure: str, payments: str, months: int = 3, least: int = 1
) -> DataFrame:
    """Drop long-standing, paying customers; unknown tenure or payments stay."""
    flagged = F.when((F.col(tenure) >= months) & (F.col(payments) >= least), F.lit(True))
    return df.filter(flagged.isNull())


def study_exclusions(
    bad_at_origin: Column, scores: Sequence[str], target: str, inactive: Column, age: str,
    ages: tuple[int, int], labels: Sequence[str],
) -> list[tuple[str, Column]]:
    """The six development rules in their order; `labels` name them."""
    def any_score(value: int) -> Column:
        return reduce(lambda a, b: a | b, [F.col(s) == value for s in scores])

    conditions = [
        bad_at_origin,
        any_score(0),
        any_score(1),
        F.col(target).isNull(),
        inactive,
        (F.col(age) < ages[0]) | (F.col(age) > ages[1]),
    ]
    return list(zip(labels, conditions))


def production_exclusions(
    score: str, cut: int, age: str, ages: tuple[int, int], labels: Sequence[str]
) -> list[tuple[str, Column]]:
    conditions = [F.col(score) <= cut, (F.col(age) < ages[0]) | (F.col(age) > ages[1])]
    return list(zip(labels, conditions))


def counts(df: DataFrame, keys: Sequence[str], output: str = "n") -> DataFrame:
    """Rows per key combination, most frequent first."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(output))
    return totals.orderBy(F.desc(output), *keys)


def cohort_of(stamp: str | Column) -> Column:
    """`YYYY-MM` from a date string."""
    return F.substring(F.col(stamp) if isinstance(stamp, str) else stamp, 1, 7)


def cohort_label(cohort: str, oot: str, baseline: str = "Baseline", late: str = "Out-of-Time") -> Column:
    """Baseline or out-of-time; a null cohort has no label."""
    return F.when(F.col(cohort) == oot, late).when(F.col(cohort) != oot, baseline)


def hash_bucket(key: str | Column) -> Column:
    """0..99 from the key alone, so the split does not move with partitioning."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("bigint") % 100


def sample_of(key: str | Column, cohort: str | Column, oot: str, dev_percent: int = 80) -> Column:
    """oot / dev / val; a null cohort counts as in-time."""
    c = F.col(cohort) if isinstance(cohort, str) else cohort
    return (
        F.when(c.eqNullSafe(oot), "oot")
        .when(hash_bucket(key) < dev_percent, "dev")
        .otherwise("val")
    )


def with_in_time_total(df: DataFrame, sample: str = "sample") -> DataFrame:
    """Repeat dev and val rows under `tot` (the in-sample whole of in-time rows).

    Meant for histograms: apply it after aggregating by sample.
    """
    names = F.when(F.col(sample).isin("dev", "val"), F.array(F.col(sample), F.lit("tot"))).otherwise(
        F.array(F.col(sample))
    )
    return df.withColumn(sample, F.explode(names))
