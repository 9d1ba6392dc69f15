"""Most-frequent imputation, weight-of-evidence encoding and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwright.functions.columns import join_back, unpivot
from bandwright.operators.profile import medians
from bandwright.operators.screening import value_counts
from bandwright.sources.session import written

# Sub-keys that rows without a level are dealt to in a join.
NULL_KEYS = 1024


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value): most frequent non-null value, the smallest on a tie."""
    counted = (
        unpivot(df, [], columns, "string")
        .filter(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), "value"))
    return counted.groupBy("variable").agg(best.alias("best")).select("variable", "best.value")


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """`modes` as literals: one value per column."""
    return {r["variable"]: r["value"] for r in modes(df, columns).collect()}


def woe_levels(df: DataFrame, target: str, columns: Sequence[str], smoothing: float = 1.0) -> DataFrame:
    """(variable, value, woe) with woe = ln((bad+a)/(B+2a)) - ln((good+a)/(G+2a))."""
    cells = value_counts(df, target, columns).filter("present")
    totals = cells.groupBy("variable").agg(
        F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")
    )
    a = F.lit(float(smoothing))
    # One row per encoded column, a bound known from the schema.
    joined = join_back(cells, totals, ["variable"], broadcast=True)
    woe = F.ln((F.col("bad") + a) / (F.col("all_bad") + 2 * a)) - F.ln(
        (F.col("good") + a) / (F.col("all_good") + 2 * a)
    )
    return joined.select("variable", "value", woe.alias("woe"))


def encode_by_join(df: DataFrame, levels: DataFrame, columns: Sequence[str], suffix: str = "_woe") -> DataFrame:
    """Encode any number of levels; unseen and null values become 0."""
    values = {c: F.col(c).cast("string") for c in columns}
    return joined_levels(df, levels, values, {c: c + suffix for c in columns})


def joined_levels(
    df: DataFrame, levels: DataFrame, values: Mapping[str, Column], outputs: Mapping[str, str],
) -> DataFrame:
    """`df` with the weight of evidence of each variable's value, 0 where it has no level.

    Spark decides by the table's size between a broadcast and a shuffle. In a shuffle the
    rows without a value are dealt by a hash of the row, so that no task gets them all; a hot
    level is split by adaptive execution, as `df` is the outer side.
    """
    lot = F.pmod(F.xxhash64(*df.columns), F.lit(NULL_KEYS)).cast("int") + 1
    for variable, value in values.items():
        key, deal, woe = (f"__{variable}_{part}" for part in ("key", "deal", "woe"))
        one = levels.filter((F.col("variable") == variable) & F.col("value").isNotNull()).select(
            F.col("value").alias(f"{key}_"), F.lit(0).alias(f"{deal}_"), F.col("woe").alias(woe))
        known = F.coalesce(value, F.lit(""))
        df = df.withColumns({key: known, deal: F.when(value.isNull(), lot).otherwise(0)})
        df = df.join(one, (F.col(key) == F.col(f"{key}_")) & (F.col(deal) == F.col(f"{deal}_")), "left")
        df = df.withColumn(outputs[variable], F.coalesce(woe, F.lit(0.0))).drop(key, deal, f"{key}_", f"{deal}_", woe)
    return df


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the exact median of the finite values of each column."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianModel:
        columns = self.getInputCols()
        return MedianModel(inputCols=columns, outputCols=self.getOutputCols(), values=medians(dataset, columns))


class MedianModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Puts the median in place of null and NaN; a column without a median stays as it is."""

    values = Param(Params._dummy(), "values", "median by column")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = self.getOrDefault("values")

        def filled(c: str) -> Column:
            x = F.col(c).cast("double")
            return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(values.get(c)).cast("double"))

        return dataset.withColumns({out: filled(c) for c, out in zip(self.getInputCols(), self.getOutputCols())})


class _WoeParams(HasInputCols, HasOutputCols, HasLabelCol):
    smoothing = Param(
        Params._dummy(), "smoothing", "added to every count", typeConverter=TypeConverters.toFloat
    )
    imputed = Param(
        Params._dummy(), "imputed", "replace nulls by the most frequent level first",
        typeConverter=TypeConverters.toBoolean,
    )


class WoeEncoder(Estimator, _WoeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the most frequent level and the weight of evidence of every level."""

    @keyword_only
    def __init__(
        self, *, inputCols=None, outputCols=None, labelCol="label", smoothing=1.0, imputed=True
    ):
        super().__init__()
        self._setDefault(labelCol="label", smoothing=1.0, imputed=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> WoeModel:
        columns, label = self.getInputCols(), self.getLabelCol()
        known = dataset.filter(F.col(label).isNotNull())
        fill = mode_values(known, columns) if self.getOrDefault("imputed") else {}
        filled = known.withColumns(
            {c: F.coalesce(F.col(c).cast("string"), F.lit(fill.get(c))) for c in columns}
        )
        levels = written(woe_levels(filled, label, columns, self.getOrDefault("smoothing")), "levels")
        return WoeModel(inputCols=columns, outputCols=self.getOutputCols(), table=levels, fill=fill)


class WoeModel(Model, _WoeParams, MLReadable, MLWritable):
    """Replaces each category by its weight of evidence; unseen and null give 0.

    The levels, of any number, are a table (variable, value, woe): it is saved beside the
    parameters and joined by `transform`.
    """

    fill = Param(Params._dummy(), "fill", "most frequent level by column")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, table=None, fill=None):
        super().__init__()
        given = self._input_kwargs
        self.table = given.pop("table", None)
        self._set(**given)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fill, columns = self.getOrDefault("fill"), self.getInputCols()
        values = {c: F.coalesce(F.col(c).cast("string"), F.lit(fill.get(c))) for c in columns}
        return joined_levels(dataset, self.table, values, dict(zip(columns, self.getOutputCols())))

    def write(self) -> _WoeWriter:
        return _WoeWriter(self)

    @classmethod
    def read(cls) -> _WoeReader:
        return _WoeReader()


class _WoeWriter(MLWriter):
    def __init__(self, model: WoeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/levels")


class _WoeReader(MLReader):
    def load(self, path: str) -> WoeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = WoeModel(table=self.sparkSession.read.parquet(f"{path}/levels"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, n, weight) with weight = n_rows / (2 * n_class)."""
    per_class = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # Two classes, so the window sees two rows.
    whole = F.sum("n").over(Window.partitionBy())
    return per_class.select(target, "n", (whole / (2 * F.col("n"))).alias("weight"))


def with_class_weight(
    df: DataFrame, target: str, output: str = "weight", of: DataFrame | None = None,
) -> DataFrame:
    """`df` with the weight that each row's class has among the rows of `of`, or its own."""
    counted = df if of is None else of
    weights = {r[target]: r["weight"] for r in class_weights(counted, target).collect()}
    # A class that the fit has not seen weighs as an average row.
    case = F.when(F.col(target).isNotNull(), F.lit(1.0))
    for value, weight in weights.items():
        case = F.when(F.col(target) == value, F.lit(weight)).otherwise(case)
    return df.withColumn(output, case)
