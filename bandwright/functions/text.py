"""Text normalisation: kept lists, ordered substring match, dictionary grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.functions import presets

# A typed-in dictionary stays far below this; a longer one is a table to join.
MAX_DICTIONARY = 10_000


def keep_listed(
    column: Column,
    values: Sequence[str] = presets.EMAIL_DOMAINS,
    default: str = presets.EMAIL_DEFAULT,
) -> Column:
    """Lower-cased value if listed, else `default` (null included)."""
    low = F.lower(column)
    return F.when(low.isin(*values), low).otherwise(F.lit(default))


def with_first_contained(
    df: DataFrame,
    column: str,
    output: str,
    tokens: Sequence[str] = presets.DEVICE_BRANDS,
    default: str = presets.DEVICE_DEFAULT,
) -> DataFrame:
    """Add the first token, in list order, found anywhere in the lower-cased text.

    Order decides because a short token such as `lg` also occurs inside longer
    words. The text is lowered once, in its own projection: inside the chain it
    would be lowered again for every token.
    """
    low = f"__{output}_low"
    hits = [F.when(F.col(low).contains(t), F.lit(t)) for t in tokens]
    lowered = df.withColumn(low, F.lower(F.col(column)))
    return lowered.withColumn(output, F.coalesce(*hits, F.lit(default))).drop(low)


def group_by_dictionary(
    df: DataFrame,
    column: str,
    output: str,
    groups: Mapping[str, Sequence[str]] = presets.ISSUER_GROUPS,
    default: str | None = presets.ISSUER_DEFAULT,
    null_label: str | None = presets.ISSUER_NULL,
    lower: bool = True,
) -> DataFrame:
    """Many-to-one grouping by a join with the dictionary as a two-column dimension.

    `default` None passes unlisted values through. The first group naming a value
    wins. The dictionary is typed in by hand, so its size is known here; only one
    within MAX_DICTIONARY entries is hinted for broadcast.
    """
    pairs: dict[str, str] = {}
    for label, values in groups.items():
        for value in values:
            pairs.setdefault(value, label)
    key, label = f"__{output}_key", f"__{output}_label"
    dimension = df.sparkSession.createDataFrame(list(pairs.items()), f"`{key}` string, `{label}` string")
    if len(pairs) <= MAX_DICTIONARY:
        dimension = F.broadcast(dimension)
    value = F.col(column)
    joined = df.join(dimension, (F.lower(value) if lower else value) == F.col(key), "left")
    rest = value if default is None else F.lit(default)
    grouped = F.when(value.isNull(), F.lit(null_label)).otherwise(F.coalesce(F.col(label), rest))
    return joined.withColumn(output, grouped).drop(key, label)
