"""Per-row contributions of the inputs of a tree ensemble.

Path-dependent Shapley values (Lundberg et al. 2018). For one leaf the value function is a
product over the features on its path: 1 or 0 where the feature is known (the row meets the
path's conditions or not), the covered share of rows where it is not. With m features on the
path, feature i contributes

    value * (met_i - share_i) * integral over t from 0 to 1 of prod over j != i of ((1 - t) share_j + t met_j),

a polynomial of degree m - 1, which Gauss-Legendre quadrature with m / 2 points gives exactly.

The leaves are a table, made tree by tree from the nodes of the saved model. Rows take the
contributions of one block of leaves after the other; a block is bounded in bytes, so that
deep forests need no broadcast of all their leaves. Boosted trees are explained in
log-odds, forests in the probability of the bad class.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.operators.models import prepare
from bandwright.sources.session import scratch_path, written

LEAVES = (
    "tree int, leaf int, value double, features array<int>, low array<double>, high array<double>,"
    " allowed array<array<double>>, share array<double>"
)
#: Bytes that a feature on a path takes in a block, and of a block.
STEP_BYTES = 48
BLOCK_BYTES = 16 << 20
#: Numbers that an array of rows x leaves x features may hold in a task.
CHUNK = 1 << 21


def leaf_table(spark: SparkSession, trees, path: str) -> DataFrame:
    """One row for each leaf: its weighted value, and for each feature on its path the bounds
    (low, high], the categories allowed (null: any) and the covered share."""
    trees.write().overwrite().save(path)
    forest = isinstance(trees, RandomForestClassificationModel)
    weights = [1.0 / trees.getNumTrees] * trees.getNumTrees if forest else [2.0 * w for w in trees.treeWeights]
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    flat = nodes.select(
        "treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.col("split.numCategories").alias("categories"),
        F.col("split.leftCategoriesOrThreshold").alias("cut"),
    )

    def walk(tree: pd.DataFrame) -> pd.DataFrame:
        rows = {r.id: r for r in tree.itertuples(index=False)}
        number, found = int(tree["treeID"].iloc[0]), []
        open_nodes = [(0, {})]
        while open_nodes:
            at, steps = open_nodes.pop()
            r = rows[at]
            if r.leftChild < 0:
                stats = np.asarray(r.impurityStats, float)
                value = stats[1] / stats.sum() if forest else r.prediction
                parts = [steps[f] for f in steps]
                found.append((
                    number, at, weights[number] * value, list(steps), [p[0] for p in parts], [p[1] for p in parts],
                    [p[2] for p in parts], [p[3] for p in parts]))
                continue
            low, high, allowed, share = steps.get(r.feature, (-np.inf, np.inf, None, 1.0))
            for child, left in ((r.leftChild, True), (r.rightChild, False)):
                ratio = rows[child].rawCount / r.rawCount
                if r.categories != -1:
                    named = set(map(float, r.cut)) if left else set(map(float, range(r.categories))) - set(map(float, r.cut))
                    step = (low, high, sorted(named if allowed is None else named & set(allowed)), share * ratio)
                elif left:
                    step = (low, min(high, r.cut[0]), allowed, share * ratio)
                else:
                    step = (max(low, r.cut[0]), high, allowed, share * ratio)
                open_nodes.append((child, {**steps, r.feature: step}))
        return pd.DataFrame(found, columns=[c.split(" ")[0] for c in LEAVES.split(", ")])

    return flat.groupBy("treeID").applyInPandas(walk, LEAVES)


def _groups(leaves: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """Leaves with paths of one length as arrays: value, features, low, high, share, and the places with categories."""
    by_size: dict[int, list[dict]] = {}
    for leaf in leaves.to_pylist():
        by_size.setdefault(len(leaf["features"]), []).append(leaf)
    out = []
    for size, rows in by_size.items():
        if size:
            named = [(i, j, a) for i, r in enumerate(rows) for j, a in enumerate(r["allowed"]) if a is not None]
            arrays = [np.array([r[c] for r in rows], float) for c in ("value", "low", "high", "share")]
            out.append((arrays[0], np.array([r["features"] for r in rows], int), *arrays[1:], named))
    return out


def _contributions(x: np.ndarray, groups) -> np.ndarray:
    """Rows by features; see the module text for the formula."""
    out = np.zeros_like(x)
    x = np.where(np.isnan(x), np.inf, x)  # a missing value goes right
    for value, features, low, high, share, named in groups:
        count, size = features.shape
        points, weights = np.polynomial.legendre.leggauss((size + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        rows = max(1, CHUNK // max(1, count * size))
        for lo in range(0, len(x), rows):
            part = x[lo:lo + rows]
            seen = part[:, features]
            met = (seen > low) & (seen <= high)
            for i, j, allowed in named:
                met[:, i, j] &= np.isin(seen[:, i, j], allowed)
            total = np.zeros(met.shape)
            for t, w in zip(points, weights):
                factors = (1 - t) * share + t * met
                total += w * factors.prod(axis=2, keepdims=True) / factors
            total *= (met - share) * value[:, None]
            for j in range(size):
                np.add.at(out[lo:lo + rows], (slice(None), features[:, j]), total[:, :, j])
    return out


def expected_value(leaves: DataFrame) -> float:
    """The ensemble's output with no feature known."""
    share = F.aggregate("share", F.lit(1.0), lambda a, b: a * b)
    return leaves.agg(F.sum(F.col("value") * share).alias("base")).first()["base"]


def blocks(leaves: DataFrame, limit: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The leaves with a block number, and how many blocks of about `limit` bytes there are."""
    size = leaves.agg(F.sum(F.size("features") + 1).alias("steps")).first()["steps"] or 0
    count = max(1, -(-size * STEP_BYTES // limit))
    return leaves.withColumn("block", F.pmod(F.xxhash64("tree", "leaf"), F.lit(count)).cast("int")), count


def attributions(
    df: DataFrame, model: PipelineModel, numeric: Sequence[str], keys: Sequence[str],
    path: str | None = None, limit: int = BLOCK_BYTES,
) -> DataFrame:
    """(keys..., base, log_odds or probability, contributions): contributions + base = the output."""
    spark = df.sparkSession
    trees = model.stages[-1]
    if isinstance(trees, RandomForestClassificationModel):
        output = vector_to_array("probability")[1].alias("probability")
    else:
        output = (vector_to_array("rawPrediction")[1] * 2).alias("log_odds")
    table, count = blocks(leaf_table(spark, trees, path or scratch_path(spark, "trees")), limit)
    table = written(table, "leaves")
    base = expected_value(table)
    features = vector_to_array("features")
    rows = prepare(df, numeric)
    rows = model.transform(rows).select(
        *keys, output, features.alias("_x"), F.transform(features, lambda x: F.lit(0.0)).alias("contributions"))
    for number in range(count):
        # Bounded by BLOCK_BYTES, whatever the size of the ensemble.
        shared = spark.sparkContext.broadcast(_groups(table.filter(F.col("block") == number).toArrow()))
        rows = rows.mapInArrow(_adding(shared), rows.schema)
        if number + 1 < count:
            rows = written(rows, "attributions")
            shared.unpersist()
    kept = [c for c in rows.columns if c not in ("_x", "contributions", *keys)]
    return rows.select(*keys, F.lit(base).alias("base"), *kept, "contributions")


def _adding(shared):
    """Adds one block's contributions to each row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x, before = (
                    batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("_x", "contributions"))
                after = before + _contributions(x.astype(float), shared.value)
                ends = pa.array(np.arange(n + 1) * x.shape[1], pa.int32())
                column = pa.ListArray.from_arrays(ends, pa.array(after.ravel()))
                place = batch.schema.get_field_index("contributions")
                batch = batch.set_column(place, "contributions", column)
            yield batch

    return run


def input_names(model: PipelineModel) -> list[str]:
    return [
        c.removesuffix("__num").removesuffix("__cat") for c in model.stages[-2].getInputCols()
    ]


def mean_absolute(explained: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, mean_abs), largest first: one wide aggregate, no row explosion."""
    wide = explained.agg(
        *[F.avg(F.abs(F.col("contributions")[i])).alias(f"a{i}") for i in range(len(names))]
    )
    lines = [
        F.struct(F.lit(n).alias("variable"), F.col(f"a{i}").alias("mean_abs"))
        for i, n in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*lines))).orderBy(F.desc("mean_abs"), "variable")
