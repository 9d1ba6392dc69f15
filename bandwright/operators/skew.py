"""Heavy join keys: found by a sketch in one pass over the keys, then spread over sub-keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is heavy when it has more than one task's even share of the rows. No more shares
# than this are told apart, so a report has at most as many keys.
MOST_SHARES = 10_000
# Items the sketch tracks for each share, which keeps its error far below a share.
TRACKED = 64
MOST_TRACKED = 1_000_000

KEY, COPIES, LOT = "__key", "__copies", "__lot"


@dataclass(frozen=True)
class Heavy:
    """What one pass over the keys found: hash of each heavy key with its number of sub-keys,
    and over how many lots rows without a whole key are dealt."""

    copies: dict[int, int]
    null_lots: int = 1

    def __bool__(self) -> bool:
        return bool(self.copies) or self.null_lots > 1


def _whole(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def find_heavy(df: DataFrame, keys: Sequence[str], kinds: Sequence[T.DataType], tasks: int | None = None) -> Heavy:
    """The keys of `df` with more rows than an even share of `tasks` (the session's shuffle partitions).

    Reads the key columns only. The sketch of frequent hashes merges map-side, so neither a
    hot key nor the number of keys makes a large task. A heavy key gets one sub-key for each
    share it holds: all sub-keys together are at most twice the shares. Two keys with one hash
    are merely spread alike.
    """
    spark = df.sparkSession
    shares = max(1, min(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SHARES))
    tracked = min(max(shares * TRACKED, 1024), MOST_TRACKED)
    hashed = df.select(F.when(_whole(keys), hash_of(keys, kinds)).alias(KEY))
    row = hashed.agg(
        F.count(F.lit(1)).alias("rows"), F.count(KEY).alias("known"),
        F.expr(f"approx_top_k({KEY}, {shares}, {tracked})").alias("top"),
    ).first()
    share = row["rows"] / shares
    if not share or shares == 1:
        return Heavy({})
    heavy = {i["item"]: -(-i["count"] // max(1, int(share))) for i in row["top"] or () if i["count"] > share and i["item"] is not None}
    nulls = row["rows"] - row["known"]
    return Heavy(heavy, max(1, int(-(-nulls // max(1, int(share))))) if nulls > share else 1)


def common_kinds(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[T.DataType] | None:
    """The types both sides' keys are hashed in; None where hashes of equal keys could differ.

    Equal types stay; whole numbers of different sizes meet as long. For other mixed types
    the comparison's own casts decide what is equal, so these are not spread.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    out = []
    for k in keys:
        a, b = left.schema[k].dataType, right.schema[k].dataType
        if a == b and not isinstance(a, (T.MapType, T.VariantType)):
            out.append(a)
        elif isinstance(a, whole) and isinstance(b, whole):
            out.append(T.LongType())
        else:
            return None
    return out


def hash_of(keys: Sequence[str], kinds: Sequence[T.DataType]) -> Column:
    return F.xxhash64(*[F.col(k).cast(kind) for k, kind in zip(keys, kinds)])


def _table(df: DataFrame, heavy: Heavy) -> DataFrame:
    rows = sorted(heavy.copies.items())
    return F.broadcast(df.sparkSession.createDataFrame(rows, f"{KEY} bigint, {COPIES} bigint"))


def dealt(df: DataFrame, keys: Sequence[str], kinds: Sequence[T.DataType], heavy: Heavy) -> DataFrame:
    """`df` with the lot of every row: 0, but for heavy keys and rows without a whole key.

    The lot hashes the row and its input partition: a retried task deals as before, and
    many equal rows are dealt apart as well.
    """
    simple = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    deal = F.xxhash64(*simple, F.spark_partition_id())
    hashed = df.withColumn(KEY, F.when(_whole(keys), hash_of(keys, kinds)))
    copies = F.when(F.col(KEY).isNull(), F.lit(heavy.null_lots)).otherwise(F.coalesce(COPIES, F.lit(1)))
    # The sub-keys of a key may be fewer than those of another one, so the modulus is the key's own.
    return hashed.join(_table(df, heavy), KEY, "left").withColumn(LOT, F.pmod(deal, copies)).drop(KEY, COPIES)


def repeated(right: DataFrame, keys: Sequence[str], kinds: Sequence[T.DataType], heavy: Heavy) -> DataFrame:
    """`right` once for each lot its key is dealt over; rows without a whole key match nothing and go."""
    hashed = right.filter(_whole(keys)).withColumn(KEY, hash_of(keys, kinds))
    found = hashed.join(_table(right, heavy), KEY, "left")
    lots = F.sequence(F.lit(0), F.coalesce(COPIES, F.lit(1)) - 1).cast("array<bigint>")
    return found.withColumn(LOT, F.explode(lots)).drop(KEY, COPIES)


def spread_left_join(
    base: DataFrame, rights: Sequence[DataFrame], keys: Sequence[str], kinds: Sequence[T.DataType], heavy: Heavy,
) -> DataFrame:
    """Left-joins every right side on the same keys; the base is dealt, and shuffled, once for all."""
    out = dealt(base, keys, kinds, heavy)
    for right in rights:
        out = out.join(repeated(right, keys, kinds, heavy), [*keys, LOT], "left")
    return out.drop(LOT)
