from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from bandwright.functions import pvalues
from bandwright.operators import allrelevant, encoding, screening
from bandwright.plans import flows


def table(spark, cells):
    """Rows from {(value, y): count}."""
    data = [(v, y) for (v, y), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(data, "v string, y int")


def test_tail_constants():
    assert pvalues.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert pvalues.t_two_sided(1.959963985, 10**9) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert pvalues.chi2_tail(18.307038053, 10) == pytest.approx(0.05, abs=1e-9)
    assert pvalues.ks_tail(0.1, 1000, 1000) == pytest.approx(9.08e-5, rel=1e-3)
    assert pvalues.binomial_tail(15, 20) == pytest.approx(0.0206947, abs=1e-7)


def test_chi_square_yates_only_on_two_by_two(spark):
    two = screening.chi_square(table(spark, {("a", 0): 20, ("a", 1): 10, ("b", 0): 12, ("b", 1): 18}), "y", ["v"]).first()
    # |O - E| = 4 everywhere, less 1/2, over expected 16 and 14
    assert two["chi2"] == pytest.approx(2 * 3.5**2 / 16 + 2 * 3.5**2 / 14) and two["dof"] == 1
    assert two["p_value"] == pytest.approx(pvalues.chi2_tail(two["chi2"], 1)) and two["result"] == "Accept H0"
    cells = {("a", 0): 20, ("a", 1): 10, ("b", 0): 10, ("b", 1): 20, ("c", 0): 15, ("c", 1): 15}
    three = screening.chi_square(table(spark, cells), "y", ["v"]).first()
    assert three["chi2"] == pytest.approx(4 * 25 / 15) and three["dof"] == 2 and three["result"] == "Reject H0"


def test_small_cell_is_not_evaluable_and_is_dropped(spark):
    tested = screening.chi_square(table(spark, {("a", 0): 50, ("a", 1): 4, ("b", 0): 5, ("b", 1): 60}), "y", ["v"])
    row = tested.first()
    assert (row["evaluable"], row["chi2"], row["p_value"], row["result"]) == (False, None, None, "Accept H0")
    assert screening.dropped_by_test(tested).count() == 1


def test_woe_totals_count_valueless_rows_as_good(spark):
    df = table(spark, {("a", 0): 6, ("a", 1): 2, ("b", 0): 3, ("b", 1): 3, ("c", 0): 4, (None, 1): 1, (None, 0): 1})
    rows = {r["value"]: r for r in screening.woe_table(df, "y", ["v"]).collect()}
    # bad total 5 (with a value), good total 20 - 5 = 15
    assert rows["a"]["dist_good"] == pytest.approx(6 / 15) and rows["a"]["dist_bad"] == pytest.approx(2 / 5)
    assert rows["c"]["woe"] == 0 and rows["c"]["iv"] == 0 and set(rows) == {"a", "b", "c"}
    even = {r["value"]: r for r in screening.woe_table(df, "y", ["v"], null_as_level=True).collect()}
    assert even["null"]["dist_bad"] == pytest.approx(1 / 6)


def test_banded_iv_matches_a_plain_count(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(size=400).round(2)
    y = (dice.random(400) < 1 / (1 + np.exp(-x))).astype(int)
    data = [(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1)]
    df = spark.createDataFrame(data, "x double, y int").withColumn("flat", F.lit(2.0))
    iv = {r["variable"]: r["iv"] for r in screening.information_value(screening.banded_woe_table(df, "y", ["x", "flat"])).collect()}
    edges = np.linspace(x.min(), x.max(), 11)
    band = np.searchsorted(edges[1:-1], x, side="left")
    expected = 0.0
    for b in range(10):
        g, m = ((band == b) & (y == 0)).sum() / (y == 0).sum(), ((band == b) & (y == 1)).sum() / (y == 1).sum()
        expected += math.log(g / m) * (g - m) if g and m else 0.0
    assert iv["x"] == pytest.approx(expected) and iv["flat"] == 0


def test_point_biserial_fills_with_the_median(spark):
    x, y = [1.0, 2.0, None, 8.0, 9.0, 3.0], [0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y int").withColumn("same", F.lit(1))
    out = {r["variable"]: r for r in screening.point_biserial(df, "y", ["x", "same"]).collect()}
    filled = [v if v is not None else 3.0 for v in x]
    assert out["x"]["r"] == pytest.approx(np.corrcoef(filled, y)[0, 1])
    t = out["x"]["r"] * math.sqrt(4 / (1 - out["x"]["r"] ** 2))
    assert out["x"]["p_value"] == pytest.approx(pvalues.t_two_sided(t, 4))
    assert out["same"]["r"] is None and out["same"]["result"] == "Accept H0"


def test_selection_rule(spark):
    iv = spark.createDataFrame([("a", 0.3), ("b", 0.2), ("c", 0.001), ("d", 0.2)], "variable string, iv double")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "d", 0.95), ("a", "d", 0.1)], "col_a string, col_b string, abs_r double")
    sparse = spark.createDataFrame([("e", True), ("a", False)], "variable string, drop boolean")
    out = screening.select_features(sparse=sparse, iv=iv, correlation=pairs, exclude=["z"], include=["c"])
    assert sorted(map(tuple, out.collect())) == [("b", "correlated"), ("d", "correlated"), ("e", "sparse"), ("z", "excluded")]


def test_modes_and_encoder_round_trip(spark, tmp_path):
    df = table(spark, {("a", 0): 5, ("a", 1): 1, ("b", 0): 1, ("b", 1): 5, (None, 1): 2})
    assert encoding.mode_values(df, ["v"]) == {"v": "a"}  # tie: the smallest
    encoder = encoding.WoeEncoder(inputCols=["v"], outputCols=["w"], labelCol="y", smoothing=1.0)
    model = encoder.fit(df)
    path = str(tmp_path / "woe")
    model.write().overwrite().save(path)
    loaded = encoding.WoeModel.load(path)
    probe = spark.createDataFrame([("a",), ("b",), (None,), ("unseen",)], "v string")
    got = [r["w"] for r in loaded.transform(probe).collect()]
    # nulls became 'a': good 5, bad 3 of totals 6 and 8
    a = math.log(4 / 10) - math.log(6 / 8)
    b = math.log(6 / 10) - math.log(2 / 8)
    assert got == [pytest.approx(a), pytest.approx(b), pytest.approx(a), 0.0]


def test_model_and_join_form_agree(spark):
    df = spark.range(3_000).select((F.col("id") % 300).cast("string").alias("v"), (F.col("id") % 2).alias("y"))
    model = encoding.WoeEncoder(inputCols=["v"], outputCols=["w"], labelCol="y", imputed=False).fit(df)
    levels = encoding.woe_levels(df, "y", ["v"])
    both = encoding.encode_by_join(model.transform(df), levels, ["v"])
    assert both.filter(F.abs(F.col("w") - F.col("v_woe")) > 1e-12).count() == 0 and both.count() == 3_000


def test_a_hundred_thousand_levels_in_a_pipeline(spark, tmp_path):
    """One fit, saved, reloaded and used: as many levels as there are, none of them on the driver."""
    df = spark.range(300_000).select((F.col("id") % 100_000).cast("string").alias("v"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    encoder = encoding.WoeEncoder(inputCols=["v"], outputCols=["w"], labelCol="y", imputed=False)
    model = Pipeline(stages=[encoder, VectorAssembler(inputCols=["w"], outputCol="x")]).fit(df)
    model.write().save(str(tmp_path / "many"))
    again = PipelineModel.load(str(tmp_path / "many"))
    assert again.stages[0].table.count() == 100_000 and again.stages[0].uid == model.stages[0].uid
    a, b = (m.transform(df).select("v", "y", "w") for m in (model, again))
    assert a.exceptAll(b).isEmpty() and a.select("w").distinct().count() > 1
    counts = df.groupBy("v").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    bad, good = df.agg(F.sum("y"), F.count_if(F.col("y") == 0)).first()
    expected = counts.select("v", (
        F.ln((F.col("bad") + 1) / (bad + 2)) - F.ln((F.col("n") - F.col("bad") + 1) / (good + 2))).alias("e"))
    assert again.transform(df).join(expected, "v").filter(F.abs(F.col("w") - F.col("e")) > 1e-9).isEmpty()


def test_rows_without_a_level_are_dealt(spark):
    """Null keys spread over many sub-keys when the levels are shuffled, and give 0."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.lit("a")).alias("v"))
    levels = spark.createDataFrame([("v", "a", 0.5), ("v", None, 9.0), ("v", "", 8.0)], "variable string, value string, woe double")
    out = encoding.joined_levels(df, levels.hint("merge"), {"v": F.col("v")}, {"v": "w"})
    assert out.columns == ["id", "v", "w"] and out.count() == 20_000
    assert {(r["v"], r["w"]) for r in out.select("v", "w").distinct().collect()} == {("a", 0.5), (None, 0.0)}


def test_class_weights(spark):
    df = table(spark, {("a", 0): 30, ("a", 1): 10, ("b", None): 3})
    assert {r["y"]: r["weight"] for r in encoding.class_weights(df, "y").collect()} == {0: pytest.approx(40 / 60), 1: 2.0}


def test_all_relevant_search_finds_the_planted_feature(spark):
    dice = np.random.default_rng(5)
    n = 1_500
    signal, noise = dice.normal(size=n), dice.normal(size=(n, 2))
    kind = dice.choice(["p", "q"], size=n)
    y = (signal + dice.normal(scale=0.3, size=n) > 0).astype(int)
    data = [(i, float(signal[i]), float(noise[i, 0]), float(noise[i, 1]), str(kind[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "id int, signal double, n1 double, n2 double, kind string, y int")
    found = allrelevant.all_relevant(
        df, "y", ["signal", "n1", "n2"], ["kind"], ["id"], iterations=9, trees=10
    )
    rows = {r["variable"]: r for r in found.collect()}
    assert rows["signal"]["decision"] == "confirmed" and rows["signal"]["hits"] == rows["signal"]["trials"]
    assert "signal" not in {r["variable"] for r in allrelevant.rejected(found).collect()}


@pytest.mark.parametrize("t", [0.0, 0.01, 0.7, 1.96, 5.0])
def test_t_tail_at_a_billion_rows(t):
    """One formula at any size: at 1e9 degrees of freedom it meets the normal tail."""
    assert pvalues.t_two_sided(t, 1e9) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6)
    assert pvalues.t_two_sided(1.0, 1) == pytest.approx(0.5)


def test_rounds_repeat_on_what_is_left(spark):
    from bandwright.plans import flows

    dice = np.random.default_rng(4)
    n = 4_000
    y = dice.integers(0, 2, n)
    x = {"strong": y + dice.normal(size=n), "noise": dice.normal(size=n), "weak": 0.6 * y + dice.normal(size=n)}
    rows = [(i, int(y[i]), *(float(x[c][i]) for c in x)) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, y int, strong double, noise double, weak double")
    seen = []

    def importances(numeric, categorical):
        seen.append(list(numeric))
        # `weak` loses its importance once `noise` is gone.
        return spark.createDataFrame([(c, 0.0 if c == "weak" and "noise" not in numeric else 1.0) for c in numeric], "variable string, importance double")

    found = [tuple(r) for r in flows.rounds(df, "y", list(x), [], ["id"], importances, least_iv=0.02).collect()]
    assert (2, "weak", "low_importance") in found and {r[1] for r in found} == {"noise", "weak"}
    assert seen == [["strong", "noise", "weak"], ["strong", "weak"], ["strong"]]


def test_a_row_bound_leaves_the_all_relevant_statistics_whole(spark):
    rows = [(i, None if i % 4 == 0 else float(i), f"k{i % 300}", 1 if i % 40 == 0 else 0) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id int, x double, k string, y int")
    every, some = (allrelevant._chunked(df, "y", ["x"], ["k"], ["id"], 7, n).collect() for n in (None, 300))

    def weights(frame):
        return {(y, w) for r in frame for y, w in zip(r["y"], r["class_weight"])}

    def median(frame):
        return max({x for r in frame for x in r["x"]}, key=lambda v: sum(x == v for r in frame for x in r["x"]))

    assert 220 < sum(len(r["y"]) for r in some) < 380 and sum(len(r["y"]) for r in every) == 3_000
    assert weights(some) <= weights(every) and median(some) == median(every)
    codes = {k for r in some for k in r["k"]}
    assert codes <= {k for r in every for k in r["k"]} and max(codes) > 250


@pytest.mark.parametrize("block", [1_000, 7])
def test_correlations_in_blocks(spark, monkeypatch, block):
    """Any cut of the columns gives numpy's values; constants and all-null columns have none."""
    monkeypatch.setattr(screening, "GRAM_COLUMNS", block)
    dice = np.random.default_rng(3)
    x = dice.normal(size=(300, 20)) + 1e6
    x[:, 3] = x[:, 2] * 2 + dice.normal(size=300) * 0.1
    x[:, 5] = 0.1
    names = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names).withColumn("none", F.lit(None).cast("double"))
    got = {(r["col_a"], r["col_b"]): r["abs_r"] for r in screening.correlation_pairs(df.repartition(3), [*names, "none"]).collect()}
    assert len(got) == 21 * 20 // 2
    expected = np.abs(np.corrcoef(x[:, [i for i in range(20) if i != 5]].T))
    kept = [n for n in names if n != "c5"]
    for (a, b), r in got.items():
        if "c5" in (a, b) or "none" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(expected[kept.index(a), kept.index(b)], abs=1e-9)


def test_correlations_of_a_thousand_columns(spark):
    wide = spark.range(400).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(1_000)])
    out = screening.correlation_pairs(wide, wide.columns)
    n, low, high = out.agg(F.count("*"), F.min("abs_r"), F.max("abs_r")).first()
    assert n == 1_000 * 999 // 2 and 0 <= low and high <= 1


def test_decisions_and_importances_drop_columns(spark):
    """What a search has rejected and a model doesn't use goes, whatever the other rules say."""
    dice = np.random.default_rng(6)
    y = dice.integers(0, 2, 600)
    df = spark.createDataFrame(
        [(i, int(t), float(t + dice.normal()), float(t + dice.normal()), float(t + dice.normal())) for i, t in enumerate(y)],
        "id int, y int, a double, b double, c double")
    relevant = spark.createDataFrame([("a", "rejected"), ("b", "confirmed"), ("c", "confirmed")], "variable string, decision string")
    importance = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 0.5)], "variable string, importance double")
    out = flows.screen(df, "y", ["a", "b", "c"], [], ["id"], relevant=relevant, importance=importance)
    assert {tuple(r) for r in out.collect()} == {("a", "all_relevant"), ("b", "low_importance")}


def test_rounds_take_the_statistics_once(spark, monkeypatch):
    """Rounds over kept statistics drop what a screening of the columns left drops, in one pass over the pairs."""
    dice = np.random.default_rng(9)
    n = 800
    y = dice.integers(0, 2, n)
    strong = y + dice.normal(size=n)
    rows = [
        (i, int(y[i]), float(strong[i]), float(strong[i] + 0.01 * dice.normal()), float(dice.normal()), "pq"[i % 2])
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id int, y int, strong double, twin double, noise double, kind string")
    numeric, categorical, expected = ["strong", "twin", "noise"], ["kind"], set()
    for number in range(1, 5):
        gone = {tuple(r) for r in flows.screen(df, "y", numeric, categorical, ["id"]).collect()}
        expected |= {(number, *r) for r in gone}
        numeric = [c for c in numeric if c not in {v for v, _ in gone}]
        categorical = [c for c in categorical if c not in {v for v, _ in gone}]
        if not gone:
            break
    made, calls = screening.correlation_pairs, []
    monkeypatch.setattr(screening, "correlation_pairs", lambda *args: calls.append(args) or made(*args))
    out = flows.rounds(df, "y", ["strong", "twin", "noise"], ["kind"], ["id"])
    assert {tuple(r) for r in out.collect()} == expected and len(calls) == 1


def test_the_registered_search_is_fitted_on_all_rows(spark, monkeypatch):
    from bandwright.plans import catalogue

    n = 9_000
    x = {c: ((F.col("id") * (i + 3)) % 97).cast("double").alias(c) for i, c in enumerate(catalogue.FEATURES)}
    kinds = [(F.col("id") % 5).cast("string").alias(c) for c in catalogue.CATEGORICAL]
    dev = spark.range(n).select(F.col("id").alias("order_id"), (F.col("id") % 3 == 0).cast("int").alias("bad"), *x.values(), *kinds)
    seen = []

    def rounds(frame, target, names, *rest):
        seen.append(frame.agg(F.sum(F.size(target)).alias("n")).first()["n"])
        return spark.createDataFrame([(c, 0, 1, "tentative") for c in names], "variable string, hits int, trials int, decision string")

    monkeypatch.setattr(allrelevant, "_rounds", rounds)
    monkeypatch.setattr(catalogue, "_dev", lambda *where: dev)
    monkeypatch.setattr(catalogue, "_searches", {})
    assert catalogue.REGISTRY["boruta"](spark, "own rows").count() == len(x) + len(kinds) and seen == [n]


def test_rounds_of_the_search_get_small_tasks():
    assert [allrelevant._tasks(n) for n in (1, 4, 44, 109, 656, 4_500, 39_000)] == [2, 2, 2, 7, 8, 9, 78]
