"""End-to-end flows: population build, training report, scoring and monitoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import count
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.operators import allrelevant, models, monitoring, profile, screening
from bandwright.operators.panel import Satellite, exclude, first_per_key, star_assembly
from bandwright.sources.model_store import load_newest, save_run
from bandwright.sources.session import written
from bandwright.sources.tables import write_parquet


def population(
    base: DataFrame, satellites: Sequence[Satellite], rules: Sequence[tuple[str, Column]],
    scope: Callable[[DataFrame], DataFrame] | None = None, lookup: Satellite | None = None,
    lookup_order: Sequence[str] = (), reason: str = "exclusao",
) -> DataFrame:
    """Star assembly, scope filter, deduplicated lookup, exclusion reasons; all lazy."""
    panel = star_assembly(base, satellites)
    if scope:
        panel = scope(panel)
    if lookup:
        unique = first_per_key(lookup.frame, lookup.keys, lookup_order, lookup.keep)
        panel = star_assembly(panel, [Satellite(unique, lookup.keys, salt=lookup.salt)])
    return exclude(panel, rules, reason)


class Statistics(NamedTuple):
    """What the rules read of each column or pair, whichever other columns are in."""

    sparse: DataFrame
    rejected: list[tuple[str, DataFrame]]
    iv: DataFrame
    correlation: DataFrame | None

    def kept(self) -> Statistics:
        """Computed now: rows by column are held as literals, those by pair as a table."""
        pairs = None if self.correlation is None else written(self.correlation, "correlations")
        return Statistics(_report(self.sparse), [(name, _report(t)) for name, t in self.rejected], self.iv, pairs)

    def of(self, columns: Sequence[str]) -> Statistics:
        """Those of some of the columns."""
        own = F.col("variable").isin(*columns)
        pairs = self.correlation
        if pairs is not None:
            pairs = pairs.filter(F.col("col_a").isin(*columns) & F.col("col_b").isin(*columns))
        return Statistics(self.sparse.filter(own), [(name, t.filter(own)) for name, t in self.rejected], self.iv.filter(own), pairs)


def statistics(dev: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str]) -> Statistics:
    rejected, tables = [], []
    if numeric:
        tested = screening.point_biserial(dev, target, numeric)
        rejected.append(("point_biserial", screening.dropped_by_test(tested)))
    if categorical:
        tested = screening.chi_square(dev, target, categorical)
        rejected.append(("chi_square", screening.dropped_by_test(tested)))
        tables.append(screening.woe_table(dev, target, categorical))
    if numeric:
        tables.append(screening.banded_woe_table(dev, target, numeric))
    iv = reduce(DataFrame.unionByName, map(screening.information_value, tables))
    return Statistics(
        profile.sparse_profile(dev, [*numeric, *categorical]), rejected, _report(iv),  # read by three rules
        screening.correlation_pairs(dev, numeric) if numeric else None,
    )


def screen(
    dev: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str],
    key: Sequence[str], iterations: int = 0, least_iv: float = 0.02,
    most_correlation: float = 0.8, exclude_names: Sequence[str] = (),
    include_names: Sequence[str] = (), relevant: DataFrame | None = None,
    importance: DataFrame | None = None, least_importance: float = 0.0, known: Statistics | None = None,
) -> DataFrame:
    """(variable, reason) of every column the screening drops.

    The development rows are kept while the tests pass over them. The all-relevant search
    runs when `iterations` is positive; `relevant` takes the result of an earlier one, and
    `importance` a model's table of importances. `known` takes the statistics of these columns.
    `rounds` repeats the screening.
    """
    kept = dev.select(*key, target, *numeric, *categorical).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known = known or statistics(kept, target, numeric, categorical)
        tests = list(known.rejected)
        if iterations:
            found = allrelevant.all_relevant(kept, target, numeric, categorical, key, iterations)
            tests.append(("all_relevant", allrelevant.rejected(found)))
        if relevant is not None:
            tests.append(("all_relevant", allrelevant.rejected(relevant)))
        dropped = screening.select_features(
            sparse=known.sparse, tests=tests, iv=known.iv, least_iv=least_iv, correlation=known.correlation,
            most_correlation=most_correlation, importance=importance,
            least_importance=least_importance, exclude=exclude_names, include=include_names,
        )
        return _report(dropped)
    finally:
        kept.unpersist()


def rounds(
    dev: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], key: Sequence[str],
    importances: Callable[[Sequence[str], Sequence[str]], DataFrame] | None = None, **rules,
) -> DataFrame:
    """(round, variable, reason): `screen` on what the rounds before have left, until a
    round drops nothing.

    `importances` gives the importances of a model fitted on the columns still in; columns
    that a rule's `include_names` keeps never count as dropped. No column's statistics depend
    on which others are in, so they are taken once, of all columns.
    """
    found: list[tuple[int, str, str]] = []
    numeric, categorical = list(numeric), list(categorical)
    rows = dev.select(*key, target, *numeric, *categorical).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known = statistics(rows, target, numeric, categorical).kept()
    finally:
        rows.unpersist()
    # A round that drops nothing is the last, so there are at most as many as columns.
    for number in count(1):
        table = importances(numeric, categorical) if importances else None
        excluded = [c for c in rules.get("exclude_names", ()) if c in {*numeric, *categorical}]
        own = {**rules, "exclude_names": excluded, "known": known.of([*numeric, *categorical])}
        rows = screen(dev, target, numeric, categorical, key, importance=table, **own).collect()
        found += [(number, r["variable"], r["reason"]) for r in rows]
        gone = {r["variable"] for r in rows}
        numeric = [c for c in numeric if c not in gone]
        categorical = [c for c in categorical if c not in gone]
        if not gone or not (numeric or categorical):
            break
    return dev.sparkSession.createDataFrame(found, "round int, variable string, reason string")


def _report(df: DataFrame) -> DataFrame:
    """A result of O(columns) rows, computed now and held as literals."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def score_population(
    population_frame: DataFrame, model: PipelineModel, numeric: Sequence[str], keep: Sequence[str],
    score: str = "score", path: str | None = None, cohort: str | None = None,
) -> DataFrame:
    """Score a whole base in one plan and, given a path, write it by cohort.

    No step leaves the cluster: what the model needs is read, scored and written.
    """
    inputs = list(dict.fromkeys([*keep, *models.required_columns(model)]))
    scored = models.score(population_frame.select(*inputs), model, numeric, score).select(*keep, score)
    if path:
        write_parquet(scored, path, [cohort] if cohort else [])
        # The declared schema keeps the cohort a string when it comes back from a path.
        return population_frame.sparkSession.read.schema(scored.schema).parquet(path).select(*scored.columns)
    return scored


def reload_check(
    df: DataFrame, model: PipelineModel, store: str, name: str, numeric: Sequence[str],
    sample: str = "sample",
) -> DataFrame:
    """Save the model as a new run, load the newest run and compare both scorings."""
    spark = df.sparkSession
    save_run(spark, model, store, name)
    return models.parity(df, model, load_newest(spark, store, name), numeric, sample)


def drift_report(
    baseline: DataFrame, production: DataFrame, classes: Sequence[str], cohort: str,
    baseline_label: str,
) -> Mapping[str, DataFrame]:
    """The class distribution of both frames appended, and the stability index on it.

    The distribution is written once; the index compares it with itself.
    """
    frame = monitoring.append_frames(baseline, production, [*classes, cohort])
    distribution = written(monitoring.class_distribution(frame, cohort, classes), "distribution")
    return {
        "distribution": distribution,
        "psi": monitoring.stability_index(distribution, cohort, baseline_label),
    }


def drift_update(frame: DataFrame, path: str, batch: str, classes: Sequence[str], cohort: str) -> None:
    """Adds a batch of baseline or production rows to the table of counts."""
    monitoring.record_counts(frame, path, batch, cohort, classes)


def drift_so_far(spark: SparkSession, path: str, cohort: str, baseline_label: str) -> Mapping[str, DataFrame]:
    """The drift report of all batches recorded at `path`."""
    distribution = monitoring.recorded_distribution(spark, path, cohort)
    return {
        "distribution": distribution,
        "psi": monitoring.stability_index(distribution, cohort, baseline_label),
    }
