"""Right-closed bands: declarative label specs and edge lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.functions.columns import INF


@dataclass(frozen=True)
class Bands:
    """Ordered labels for a numeric column.

    `uppers[i]` is the inclusive upper edge of `labels[i]`; None leaves the last
    band open. `points` are exact values tested before the bands. Values under
    `low` (or equal to it when `low_closed` is false) and values above the last
    edge get `outside`, nulls get `null_label`; both default to `other`.
    """

    column: str
    output: str
    uppers: tuple[float | None, ...]
    labels: tuple[str, ...]
    other: str
    points: Mapping[float, str] = field(default_factory=dict)
    low: float | None = None
    low_closed: bool = True
    outside: str | None = None
    null_label: str | None = None

    def expr(self) -> Column:
        x = F.col(self.column)
        outside = self.other if self.outside is None else self.outside
        case = F.when(x.isNull(), self.other if self.null_label is None else self.null_label)
        for value, label in self.points.items():
            case = case.when(x == value, label)
        if self.low is not None:
            case = case.when(x < self.low if self.low_closed else x <= self.low, outside)
        for upper, label in zip(self.uppers, self.labels):
            if upper is None:
                return case.otherwise(label)
            case = case.when(x <= upper, label)
        return case.otherwise(outside)


@dataclass(frozen=True)
class Groups:
    """Labels for lists of exact values; `default` None passes the value through."""

    column: str
    output: str
    groups: Mapping[str, tuple[str, ...]]
    default: str | None = None
    null_label: str | None = None

    def expr(self) -> Column:
        x = F.col(self.column)
        case = F.when(x.isNull(), F.lit(self.null_label if self.null_label is not None else self.default))
        for label, values in self.groups.items():
            case = case.when(x.isin(*values), label)
        return case.otherwise(x if self.default is None else F.lit(self.default))


def with_classes(df: DataFrame, specs: Sequence[Bands | Groups]) -> DataFrame:
    """Add every class column in one projection."""
    return df.withColumns({s.output: s.expr() for s in specs})


def edges_below(x: Column, edges: Sequence[float]) -> Column:
    """How many literal edges lie strictly below `x` (null stays null)."""
    return reduce(add, [(x > F.lit(float(e))).cast("int") for e in edges], F.lit(0))


def edges_below_array(x: Column, edges: Column) -> Column:
    """`edges_below` for an edge array column; used on histogram-sized rows."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x)))


def snap_up(df: DataFrame, column: str, cuts: Sequence[float]) -> DataFrame:
    """Replace `column` by the smallest cut >= its value (+inf beyond the last).

    For edges taken from `cuts`, lo < x <= hi gives the same answer for the
    snapped value, so a raw score shrinks to at most len(cuts) + 1 points before
    any shuffle. `Bucketizer` is left-closed, hence the sign flip.
    """
    cuts = sorted({float(c) for c in cuts})
    if not cuts:
        return df.withColumn(column, F.when(F.col(column).isNotNull(), F.lit(INF)))
    flipped, index = f"__flip_{column}", f"__cut_{column}"
    splits = [-INF, *[-c for c in reversed(cuts)], INF]
    # index 0 holds -x < -last, i.e. x > last; index k holds the k-th cut from the top
    values = [INF, *reversed(cuts)]
    bucketed = Bucketizer(
        splits=splits, inputCol=flipped, outputCol=index, handleInvalid="keep"
    ).transform(df.withColumn(flipped, -F.col(column).cast("double")))
    snapped = F.element_at(F.array(*[F.lit(v) for v in values]), F.col(index).cast("int") + 1)
    # NaN has no band
    keep = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))
    return bucketed.withColumn(column, F.when(keep, snapped)).drop(flipped, index)
