"""Small helpers the operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_BYTES = 2 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`df` without the columns that carry a result's name; results take their place."""
    return df.select(*[f"`{c}`" for c in df.columns if c not in set(names)])


def extended(df: DataFrame, fields: Sequence[tuple[str, str]]) -> T.StructType:
    """Schema of `df` followed by the given (name, type) columns."""
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    return T.StructType([*df.schema.fields, *added.fields])


def mapped(df: DataFrame, task: Callable, schema: T.StructType | str) -> DataFrame:
    """`df.mapInArrow`, in batches of at most BATCH_BYTES.

    Spark's own bound (64 MB) is held several times over by an executor's JVM and workers;
    a smaller one that the session has set stays.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?[0-9]*)\s*([a-z]*)", conf.get(_BOUND).lower()).groups()
    size = int(number or 0) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)
    if not 0 < size <= BATCH_BYTES:
        conf.set(_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def beside(batch: pa.RecordBatch, arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays.values()], [*batch.schema.names, *arrays])
