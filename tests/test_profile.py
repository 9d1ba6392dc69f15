from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwright.functions.banding import snap_up
from bandwright.operators import cleaning, profile, shares
from bandwright.operators import quantiles
from bandwright.operators.quantiles import exact_quantiles
from bandwright.operators.running import running_totals

INF = float("inf")


def test_cleaning_rules(spark):
    df = spark.createDataFrame(
        [(1.0, "3.5", True, None), (INF, "x", None, None), (3.0, None, False, None), (float("nan"), "1", None, None)],
        "a double, b string, c boolean, d double",
    )
    cast = cleaning.to_double(df, ["b"])
    assert [r["b"] for r in cast.collect()] == [3.5, None, None, 1.0]
    filled = cleaning.fill_numeric_mean(cast, ["a", "b", "d"]).collect()
    assert [r["a"] for r in filled] == [1.0, 2.0, 3.0, 2.0]
    assert [r["d"] for r in filled] == [0.0] * 4
    zero = cleaning.fill_numeric_zero(df, ["a", "d"], target="d").collect()
    assert [r["a"] for r in zero] == [1.0, 0.0, 3.0, 0.0] and [r["d"] for r in zero] == [None] * 4
    text = cleaning.fill_categorical(df.select("b", "c")).collect()
    assert [r["c"] for r in text] == ["True", "others", "False", "others"] and text[2]["b"] == "others"


def test_integer_score_truncates(spark):
    df = spark.createDataFrame([(0.9999,), (0.0,), (1.0,)], "p double")
    assert [r[0] for r in df.select(cleaning.to_integer_score(F.col("p"))).collect()] == [999, 0, 1000]


def test_sparse_columns(spark):
    df = spark.range(100).select(
        F.when(F.col("id") == 0, 1).alias("mostly_null"), F.when(F.col("id") < 3, 1).otherwise(0).alias("mostly_zero"),
        F.col("id").alias("full"), F.lit("x").alias("label"),
    )
    prof = {r["variable"]: r for r in profile.sparse_profile(df).collect()}
    assert prof["mostly_null"]["missing"] == 99 and prof["mostly_zero"]["zeros"] == 97
    assert prof["label"]["zeros"] is None
    assert profile.drop_sparse(df).columns == ["full", "label"]


def test_wide_profile_is_batched(spark):
    df = spark.range(3).select(*[F.lit(i).alias(f"c{i}") for i in range(450)])
    out = profile.sparse_profile(df)
    assert out.count() == 450 and out.filter("zeros = 3").first()["variable"] == "c0"


@pytest.mark.parametrize("rows, sketch", [(1_000_000, 10_000), (40, 10_000), (40, 200), (7, 200)])
def test_quantiles_match_numpy(spark, monkeypatch, rows, sketch):
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    dice = random.Random(7)
    data = [(g, dice.choice([dice.gauss(0, 10), 5.0, float(dice.randint(0, 3))])) for g in "ab" for _ in range(1_500)]
    data += [("c", 1.0), ("c", None), ("a", INF), (None, 2.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    probs = [i / 10 for i in range(11)]
    out = {r["g"]: r for r in exact_quantiles(df, ["x"], probs, ["g"], rows=rows).collect()}
    for g in ("a", "b", "c", None):
        values = [x for k, x in data if k == g and x is not None and math.isfinite(x)]
        assert out[g]["n"] == len(values)
        assert np.allclose(out[g]["quantiles"], np.quantile(values, probs), atol=1e-9)


def test_snap_up_is_the_smallest_cut_not_below(spark):
    values = [-5.0, 0.0, 0.5, 1.0, 1.0001, 7.0, 8.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["x"] for r in snap_up(df, "x", [0, 1, 7]).collect()]
    assert got == [0.0, 0.0, 1.0, 1.0, 7.0, 7.0, INF, None, None]


def test_summary_and_box(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", None)], "g string, x double")
    s = {r["g"]: r for r in profile.numeric_summary(df, ["x"], ["g"]).collect()}
    assert (s["a"]["n"], s["a"]["q1"], s["a"]["median"], s["a"]["q3"]) == (5, 2.0, 3.0, 4.0)
    assert s["b"]["n"] == 0 and s["b"]["mean"] is None
    box = profile.boxplot_stats(df, ["x"], ["g"]).filter("g = 'a'").first()
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 4.0, 1)


def test_shares_sum_to_one_hundred_without_nulls(spark):
    df = spark.createDataFrame(
        [("1", "x", None), ("1", "y", "p"), ("1", "x", "p"), (None, "x", "p"), ("2", "y", "q")],
        "cohort string, a string, b string",
    )
    long = shares.cohort_shares(df, "cohort", ["a", "b"])
    sums = long.groupBy("cohort", "variable").agg(F.sum("pct").alias("s")).collect()
    assert len(sums) == 4 and all(abs(r["s"] - 100) < 1e-9 for r in sums)
    wide = shares.wide_shares(long, "cohort", "a").orderBy("cohort").collect()
    assert [tuple(r) for r in wide] == [("1", pytest.approx(200 / 3), pytest.approx(100 / 3)), ("2", None, 100.0)]
    assert shares.class_cube(df, "cohort", ["a"]).agg(F.sum("n")).first()[0] == 5


@pytest.mark.parametrize("sketch", [1, 50, 10_000])
def test_quantiles_of_ties_and_extremes(spark, monkeypatch, sketch):
    """However coarse the sketch, the brackets hold the ranks."""
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    dice = np.random.default_rng(8)
    values = np.concatenate([dice.normal(size=400), np.full(300, 0.25), [1e300, -1e300], np.nextafter(0.25, [0, 1])])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.1, 0.5, 0.55, 0.9, 1.0]
    found = exact_quantiles(df, ["x"], probs, rows=20).first()["quantiles"]
    assert found == pytest.approx(list(np.quantile(values, probs)))


def test_values_meet_their_brackets_in_compiled_code(spark):
    values = spark.createDataFrame([("x", float(v)) for v in range(9)], "variable string, value double")
    brackets = spark.createDataFrame(
        [("x", 9, [(0, 0.25, 1.0, 3.0), (1, 0.5, 4.0, 4.0)])],
        "variable string, n bigint, brackets array<struct<slot: int, p: double, lo: double, hi: double>>")
    counted = quantiles._counted(values, brackets, ["variable"])
    found = {(r["slot"], r["value"]): r["m"] for r in counted.collect()}
    assert found == {(0, None): 1, (0, 1.0): 1, (0, 2.0): 1, (0, 3.0): 1, (1, None): 4, (1, 4.0): 1}
    assert "lambda" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_a_million_groups(spark):
    df = spark.range(2_500_000).select((F.col("id") % 1_000_000).alias("g"), F.col("id").cast("double").alias("x"))
    out = exact_quantiles(df, ["x"], [0.5], ["g"])
    middle = F.when(F.col("g") < 500_000, F.col("g") + 1_000_000).otherwise(F.col("g") + 500_000).cast("double")
    assert out.filter(F.col("quantiles")[0] == middle).count() == 1_000_000


@pytest.mark.parametrize("rows", [10_000, 200, 20, 4])
def test_running_totals_in_one_to_many_levels(spark, rows):
    dice = random.Random(2)
    data = [(k, i, dice.randint(0, 9)) for k in ("a", "b", None) for i in range(dice.randint(100, 500))]
    df = spark.createDataFrame(data, "k string, i int, v long").repartition(3)
    got = {(r["k"], r["i"]): r["s"] for r in running_totals(df, ["k"], "i", {"s": "v"}, rows).collect()}
    expected, total = {}, {}
    for k, i, v in data:
        total[k] = expected[k, i] = total.get(k, 0) + v
    assert got == expected


def test_wide_shares_have_any_number_of_columns(spark, monkeypatch):
    monkeypatch.setattr(shares, "WIDE_BLOCK", 7)
    df = spark.range(600).select((F.col("id") % 3).cast("string").alias("cohort"), (F.col("id") % 40).cast("string").alias("a"))
    long = shares.cohort_shares(df, "cohort", ["a"])
    limit = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "10")
    try:
        wide = shares.wide_shares(long, "cohort", "a")
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", limit)
    assert wide.columns == ["cohort", *sorted(map(str, range(40)))]
    cells = {(r["cohort"], v): r[v] for r in wide.collect() for v in wide.columns[1:] if r[v] is not None}
    assert cells == {(r["cohort"], r["value"]): r["pct"] for r in long.collect()}
    assert shares.wide_shares(long, "cohort", "absent").columns == ["cohort"]
