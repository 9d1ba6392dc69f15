"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kinds = (T.StringType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude]


def is_fractional(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.FractionalType, T.DecimalType))


def finite(column: str | Column) -> Column:
    """The value as double; NaN and both infinities become null."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    # NaN compares as larger than any number, so one test covers all three.
    return F.when(F.abs(x) < F.lit(INF), x)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); 0 where either side is empty."""
    return F.coalesce(F.ln(F.try_divide(a, b)), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def chunks(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def unpivot(
    df: DataFrame,
    keep: Sequence[str],
    columns: Sequence[str],
    kind: str,
    name: str = "variable",
    value: str = "value",
) -> DataFrame:
    """Long form (keep..., name, value) of `columns` cast to one type.

    A generator rather than UNPIVOT: plans above an Expand are not recognised as
    equal, so an aggregate and its totals would each scan the base.
    """
    pairs = [
        F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns
    ]
    return df.select(*keep, F.inline(F.array(*pairs)))


def percent_text(column: Column) -> Column:
    """Share as text with two decimals."""
    return F.format_string("%.2f%%", column * 100)


def join_back(left: DataFrame, right: DataFrame, keys: Sequence[str], broadcast: bool = False) -> DataFrame:
    """Inner join of an aggregate with totals of that same aggregate.

    Null-safe on purpose: plain equality lets the optimizer push `isnotnull` into
    one side only, the two sides then differ and their common shuffle is computed
    twice. This way the base is scanned once.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, on)
    return joined.drop(*[f"__r_{k}" for k in keys])
